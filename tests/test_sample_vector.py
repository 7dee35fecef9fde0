"""T9 offsets vs Python, T13 padding, T14 splice, V2 orthogonality, E5."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.functions.tokenize import token_count, token_spans
from trellis.operators import codebook as cbk
from trellis.operators import graph as gr
from trellis.operators import sample as sm
from trellis.operators import vector as vq


def test_token_spans_match_python(spark):
    texts = ["user: héllo, world!\nassistant: Customer#000000001 <KG_EMBEDDING>", "", "a  b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [[(s["tok"], s["start"], s["end"]) for s in r["sp"]] for r in df.select(token_spans("text").alias("sp")).collect()]
    want = [[(m.group(0), m.start(), m.end()) for m in re.finditer(r"<KG_EMBEDDING>|\w+|[^\w\s]", t)] for t in texts]
    assert got == want


def test_padding_labels_use_ignore_index(spark):
    df = spark.createDataFrame([([1, 2],), ([3, 4, 5, 6],)], "ids array<bigint>")
    r = df.select(sm.pad_right("ids", F.lit(4), sm.IGNORE).alias("lab"),
                  sm.pad_right("ids", F.lit(4), 0).alias("ids4")).collect()
    assert r[0]["lab"] == [1, 2, -100, -100] and r[0]["ids4"] == [1, 2, 0, 0]
    assert r[1]["lab"] == [3, 4, 5, 6]


def test_left_position_ids(spark):
    df = spark.createDataFrame([([0, 0, 1, 1, 1],)], "m array<int>")
    assert df.select(sm.position_ids("m", left=True)).first()[0] == [0, 0, 0, 1, 2]


def test_kg_splice(spark):
    df = spark.createDataFrame([([("a", 5), (sm.KG_MARK, 9), ("b", 6)],)],
                               "p array<struct<tok:string,id:bigint>>")
    ids, labels = sm.splice_kg("p", sm.KG_MARK, 2, 1000)
    r = df.select(ids.alias("i"), labels.alias("l")).first()
    assert r["i"] == [5, 1000, 1001, 6] and r["l"] == [5, -100, -100, 6]


def test_rvq_residual_orthogonal_and_codes(spark):
    rng = np.random.default_rng(0)
    cb = rng.normal(size=(3, 5, 8))
    cb /= np.linalg.norm(cb, axis=2, keepdims=True)
    x = rng.normal(size=(20, 8))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(20)], "id long, vec array<double>")
    rows = sorted(vq.rvq_encode(df, cb).collect(), key=lambda r: (r["id"], r["step"]))
    for i in range(20):
        r = x[i].copy()
        for s in range(3):
            row = rows[i * 3 + s]
            cos = (r @ cb[s].T) / np.linalg.norm(r)
            assert row["code"] == int(np.argmax(cos))
            c = cb[s][row["code"]]
            r = r - (r @ c) * c
            assert abs(r @ c) < 1e-9
            assert abs(row["leftover"] - (r ** 2).mean()) < 1e-12


def test_hashed_label_embedding_brute_force(spark):
    labels = ["red widget", "NATION_1", ""]
    df = spark.createDataFrame([(t,) for t in labels], "label string")
    got = [r["vec"] for r in vq.hashed_ngram_embedding(df, "label", dim=16).collect()]
    for t, v in zip(labels, got):
        want = np.zeros(16)
        s = f"  {t}  "
        for i in range(len(s) - 2):
            want[int(hashlib.md5(s[i:i + 3].encode()).hexdigest()[:8], 16) % 16] += 1
        want /= np.linalg.norm(want)
        assert np.allclose(v, want)


def test_splice_graph_codes_takes_graphs_in_order(spark):
    df = spark.createDataFrame([([("a", 1), (sm.KG_MARK, 2), (sm.KG_MARK, 2), ("b", 3)], [[10, 11], [20]]),
                                ([(sm.KG_MARK, 2), ("b", 3)], None)],
                               "p array<struct<tok:string,id:bigint>>, c array<array<bigint>>")
    ids, labels = sm.splice_graph_codes("p", sm.KG_MARK, "c")
    rows = [tuple(r) for r in df.select(ids, labels).collect()]
    assert rows == [([1, 10, 11, 20, 3], [1, -100, -100, -100, 3]), ([3], [3])]


def test_tokens_of_other_scripts(spark):
    text = "Müller weiß_2 <KG_EMBEDDING>, Ωμέγα!"
    spans = spark.createDataFrame([(text,)], "t string").select(token_spans("t")).first()[0]
    assert [s["tok"] for s in spans] == ["Müller", "weiß_2", "<KG_EMBEDDING>", ",", "Ωμέγα", "!"]
    assert all(text[s["start"]:s["end"]] == s["tok"] for s in spans)
    assert spark.createDataFrame([(text,)], "t string").select(token_count("t")).first()[0] == 6


def test_negative_samples_lose_their_object_edge(spark):
    edges = spark.createDataFrame([("c", "a", "p"), ("c", "b", "p"), ("d", "a", "p")],
                                  "center_id string, nbr_id string, rel_id string")
    samples = spark.createDataFrame([(1, "c", "a", True), (2, "c", "a", False), (3, "d", "a", True), (4, "c", None, True)],
                                    "sample_id int, subject_id string, object_id string, neg boolean")
    got = sorted((r["sample_id"], r["nbr_id"]) for r in gr.sample_edges(edges, samples, F.col("neg")).collect())
    assert got == [(1, "b"), (2, "a"), (2, "b"), (4, "a"), (4, "b")]


def plain_fit(x, order, steps, k, rounds, decay, dead, shared):
    """The fit on whole arrays; ``order(residuals, seed)``: row numbers in hash order."""
    def unit(r):
        return r / np.linalg.norm(r, axis=1, keepdims=True)

    def alive(r):
        return np.linalg.norm(r, axis=1) >= 1e-9

    def first(seed, n):
        ok = alive(now)
        return unit(now[[i for i in order(seed) if ok[i]][:n]])

    codes, sizes, now = [], [], x.copy()
    for s in range(1 if shared else steps):
        c = first(1000 * s, k)
        n, total = np.ones(k), c.copy()
        for i in range(rounds + 1):
            r, count, direction, per = now, np.zeros(k), np.zeros_like(c), []
            for _ in range(steps if shared else 1):
                best = np.where(alive(r), np.argmax(r @ c.T, axis=1), -1)
                per.append(np.bincount(np.maximum(best, 0), minlength=k))
                count += per[-1]
                for j in range(k):
                    direction[j] += unit(r[best == j]).sum(axis=0)
                r = np.where((best >= 0)[:, None], r - (r * c[best]).sum(axis=1, keepdims=True) * c[best], r)
            if i == rounds:
                break
            n, total = decay * n + (1 - decay) * count, decay * total + (1 - decay) * direction
            gone = np.flatnonzero(n < dead)
            if len(gone):
                total[gone], n[gone] = first(1000 * s + i + 1, len(gone)) * dead, dead
            c = unit(total)
        codes.append(c)
        sizes += per
        now = r
    return np.array(codes), np.array(sizes)


@pytest.mark.parametrize("shared", [False, True])
def test_codebook_fit_equals_plain_version(spark, shared):
    rnd = np.random.default_rng(5)
    x = np.concatenate([rnd.normal(size=(3, 6))[rnd.integers(0, 3, 200)] + 0.1 * rnd.normal(size=(200, 6)), rnd.normal(size=(40, 6))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, [1.0]), (902, [float("nan")] * 6), (903, [None] * 6)]
    df = spark.createDataFrame(rows + bad, "id long, vec array<double>").repartition(5)
    ids = spark.createDataFrame([(i,) for i in range(len(x))], "id long")

    def order(seed):
        return [r["id"] for r in ids.orderBy(F.xxhash64("id", F.lit(seed)), "id").collect()]

    options = {"rounds": 4, "decay": 0.5, "dead": 12.0}  # codes die and start anew
    fit = cbk.fit_codebook(df, 3, 8, 6, shared=shared, **options)
    codes, sizes = plain_fit(x, order, 3, 8, shared=shared, **options)
    assert np.allclose(fit.codes, codes) and (fit.sizes == sizes).all()
    assert fit.sizes.sum(axis=1).tolist() == [240] * 3


def test_codebook_fit_of_few_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "id long, vec array<double>")
    fit = cbk.fit_codebook(df, 2, 4, 2, rounds=1)
    assert fit.codes.shape == (2, 4, 2) and np.allclose(np.linalg.norm(fit.codes, axis=2), 1)
    with pytest.raises(ValueError):
        cbk.fit_codebook(df.limit(0), 2, 4, 2)
    with pytest.raises(ValueError):
        cbk.fit_codebook(df, 10**6, 10**6, 2)


def test_code_sets(spark):
    rows = [(s, c) for s, cs in enumerate([{0, 1, 40000}, {1, 2}, {65536}]) for c in cs for _ in range(3)]
    sets = cbk.code_sets(spark.createDataFrame(rows, "step int, code int"))
    assert {(r["step"], r["utilisation"]) for r in cbk.set_utilisation(sets, 10).collect()} == {(0, 0.3), (1, 0.2), (2, 0.1)}
    assert cbk.shared_utilisation(sets, 10).first()[0] == 0.5


def test_standardise_with_a_bias_vector(spark):
    rows = [(1, [1.0, 2.0, 4.0, 9.0]), (2, [3.0, 3.0, 3.0, 3.0]), (3, None), (4, [])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = {r["id"]: r["std_tokens"] for r in vq.standardise(df, "v", F.lit(2.0), [10.0, 20.0]).collect()}
    x = np.array(rows[0][1])
    assert np.allclose(got[1], (x - x.mean()) / x.std(ddof=1) * 2 + [10, 20, 10, 20])
    assert np.allclose(got[2], [10, 20, 10, 20]) and got[3] is None and got[4] == []


def test_padding_to_a_multiple(spark):
    df = spark.createDataFrame([(n, [7] * n) for n in (0, 1, 7, 8, 9)], "n int, ids array<bigint>")
    rows = df.select("n", sm.pad_right("ids", sm.padded_length("n", 8), 0).alias("p"), sm.padded_length("n").alias("same")).collect()
    assert [(r["n"], len(r["p"]), sum(r["p"]), r["same"]) for r in rows] == [(0, 0, 0, 0), (1, 8, 7, 1), (7, 8, 49, 7), (8, 8, 56, 8), (9, 16, 63, 9)]
    with pytest.raises(ValueError):
        sm.padded_length("n", 0)


def test_token_spans_beyond_one_slice(spark):
    """More texts than are tokens of Python objects at a time, with null and empty ones
    between (the spans are Arrow columns, not rows of dictionaries)."""
    from pyspark.util import PythonEvalType

    from trellis.functions import tokenize

    assert tokenize._spans.evalType != PythonEvalType.SQL_SCALAR_PANDAS_UDF
    texts = [(i, None if i % 7 == 3 else "" if i % 7 == 5 else f"Wörter {i}, 𝄞 x" * (i % 4)) for i in range(3 * tokenize.TEXTS_AT_ONCE + 5)]
    df = spark.createDataFrame(texts, "i int, text string").coalesce(1)
    for r in df.select("i", "text", token_spans("text").alias("sp")).collect():
        want = None if r["text"] is None else [(m.group(0), m.start(), m.end()) for m in tokenize._RX.finditer(r["text"])]
        assert want == (None if r["sp"] is None else [tuple(s) for s in r["sp"]])
