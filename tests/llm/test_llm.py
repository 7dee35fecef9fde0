"""The pipeline operators against plain versions, and their edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from trellis.llm import (bpe, fingerprint, knn, language_id, line_dedup, near_dup, packing, queries, repeats, toxicity,
                         url_filter)
from trellis.llm.components import components, spanning_links

WORDS = {"en": "the of and that house river with stone water green from little under bright".split(),
         "de": "der und nicht haus fluss stein wasser grün über straße schön klein für größe".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, key string, a int, extra string"


def sentence(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "", "s", "en", "ly"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents with copies, near copies, repeated passages and lines, nulls,
    empty and long texts; columns whose names clash with the operators' own."""
    rnd = random.Random(5)
    passage = sentence(rnd, "en", 40)
    line = sentence(rnd, "en", 18)
    texts = []
    for i in range(36):
        lang = "de" if i % 3 == 0 else "en"
        parts = [sentence(rnd, lang, rnd.randint(4, 60)) for _ in range(rnd.randint(1, 4))]
        if i % 5 == 0:
            parts.insert(1, passage)
        if i % 4 == 0:
            parts.append(line if i % 8 else line.replace("e", "a", 1))
        texts.append((lang, "\n".join(parts)))
    texts += [texts[3], texts[3], ("en", texts[7][1] + " one more"), ("en", texts[10][1].replace("the", "teh", 1)),
              ("en", None), ("en", ""), (None, "   \n\n "), ("en", "12 34 !!"), ("de", "kurz"), ("en", "x" * 3000),
              ("en", "ab " * 2000), ("en", (sentence(rnd, "en", 30) + "\n") * 40), ("en", "naïve €uro 日本語 " * 30)]
    return [(i, t, lang, "s", len(t or ""), 1, "k", 2, "e") for i, (lang, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 exact top-k

def plain_knn(rows, k):
    ok = {i: [math.floor(1024 * float(x)) for x in v] for i, v in rows
          if v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in (i for i in ok if i % 4 == 0):
        best = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_knn_equals_brute_force(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=6).tolist()) for i in range(150)]
    rows += [(i, rows[8][1]) for i in range(150, 190)]  # a hot vector: ties go to the smaller id
    rows += [(200, None), (204, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (208, [float("nan")] * 6), (212, [float("inf")] * 6), (216, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dist", F.lit("clash"))
    got = sorted(tuple(r) for r in knn.search(df, F.col("vec_id") % 4 == 0).collect())
    assert got == plain_knn(rows, 10)
    few = df.where("vec_id < 5")
    assert sorted(tuple(r) for r in knn.search(few, F.col("vec_id") % 4 == 0).collect()) == plain_knn(rows[:5], 10)
    assert knn.search(df.limit(0), F.col("vec_id") % 4 == 0).count() == 0


def test_knn_in_groups_and_blocks(spark, monkeypatch):
    """Queries come in several groups and blocks, data in several batches; no vector is shuffled
    with a query (each pair of a block and a chunk carried both matrices)."""
    monkeypatch.setattr(knn, "GROUP_BYTES", 900)
    monkeypatch.setattr(knn, "BLOCK", 3)
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(size=5).tolist()) for i in range(130)] + [(i, [0.5] * 5) for i in range(130, 170)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        found = knn.search(df, F.col("vec_id") % 4 == 0)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(tuple(r) for r in found.collect()) == plain_knn(rows, 10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert plan.count("MapInArrow") > 1 and "Join" not in plan


def test_knn_products_beyond_floating_point():
    a = np.array([[2 ** 30, 3]]), np.array([[2 ** 30 + 1, 5]])
    assert knn.products(*a)[0, 0] == 2 ** 30 * (2 ** 30 + 1) + 15


# 2 url filter

def test_url_rules(spark):
    urls = [None, "no scheme", "http://", "http://net", "http://a.NET/x", "https://notnet/x", "http://m.example.net/en/1?q#f",
            "http://example.net/EN/", "http://b.example.com/de/", "x://org/fr/", "http://e.org/fr?x", "http://e.org/fr/://y", "http://a.net?b/c"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls + urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, url_filter.RULES).collect()}
    for i, u in enumerate(urls + urls):
        host, path = url_filter.split_url(u)
        fits = [(len(r), r, v) for r, v in url_filter.RULES
                if ("." + host).endswith("." + r.split("/", 1)[0]) and host and path.startswith("/" + r.split("/", 1)[1])]
        best = max(fits, default=(0, None, "allow"))
        assert got[i] == (host, path, best[1], best[2])
    assert got[4][3] == "block" and got[6][2] == "example.net/en/" and got[3][2] is None
    assert url_filter.judge(df.limit(0), url_filter.RULES).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge(df, url_filter.RULES, max_rules=2)


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: len(b))
    url_filter.write_digests([("a.b/", "block"), ("c.d/", "allow"), ("a.b/", "allow")], str(tmp_path / "d"))
    d = url_filter.Digests(str(tmp_path / "d"))
    found = d.find([b"c.d/", b"a.b/", b"x.y/"])
    assert len(d.keys) == 2 and found[2] == -1
    assert [int(d.block[found[0]]), int(d.block[found[1]])] == [0, 1]


# 3 language ID

def test_language_id(docs, empty):
    contents = language_id.learn(docs)
    assert set(contents) == {"en", "de"}
    got = {r.doc_id: r for r in language_id.classify(docs, contents).collect()}
    want = {r.doc_id: r.lang for r in docs.collect() if r.doc_id < 36}
    assert sum(got[i].lang_pred == lang for i, lang in want.items()) >= 34
    for i in (40, 41, 42, 43):  # null, empty, blank, no letter
        assert (got[i].lang_pred, got[i].rejected) == ("und", True)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.classify(empty, contents).count() == 0
    assert language_id.learn(empty) == {}
    assert language_id.Classifier({}).predict("text") == ("und", 0.0, True)
    same = language_id.Classifier({"x": [b"some text"], "y": [b"some text"]})
    assert same.predict("some text")[::2] == ("x", True)
    assert language_id.accepted(docs, contents).columns == docs.columns


def test_number_characters_are_no_letters(spark, docs):
    model = language_id.Classifier(language_id.learn(docs))
    for text in ("½ ²", "① Ⅷ", "Ⅷ", "١٢", "_ 7"):
        assert model.predict(text) == ("und", 0.0, True)
    assert language_id.normalise("xⅧy 日本½語 é") == "x y 日本 語 é".encode()


def test_texts_in_no_learned_language_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.Classifier(language_id.learn(docs.where(language_id.training_rows())))
    held_out = docs.where(~language_id.training_rows() & F.col("text").rlike(r"\p{L}")).collect()
    assert sum(model.predict(r.text)[2] for r in held_out) <= 0.03 * len(held_out)
    rnd = random.Random(2)
    foreign = [" ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9)))
                        for _ in range(rnd.randint(60, 600))) for _ in range(100)]
    assert sum(model.predict(t)[2] for t in foreign) >= 95


# 4 suffix arrays

def plain_repeats(texts, length):
    seen, out = set(), []
    for text in texts:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if w in seen:
                gone[i:i + length] = True
            seen.add(w)
        edge = np.concatenate([[False], gone])
        out.append((len(b), int(gone.sum()), int((edge[1:] & ~edge[:-1]).sum()),
                    hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def digest(df):
    return [tuple(r) for r in df.select(
        "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("gone"), F.size("starts"), F.sha2("kept", 256),
        F.col("extra.doc_id")).orderBy("doc_id").collect()]


@pytest.mark.parametrize("hot, block", [(8, 5000), (1, 40)])
def test_repeats_equal_brute_force(docs, empty, rows, monkeypatch, hot, block):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(repeats, "ARRAY_CONTEXTS", block)
    got = digest(repeats.remove_repeats(docs))
    assert [r[:4] for r in got] == plain_repeats([r[1] for r in rows], 100)
    assert sum(r[1] for r in got) > 5000
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_with_repeated_and_null_ids(spark, rows):
    text = rows[0][1] + rows[1][1]
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "short")], "doc_id long, text string")
    got = {(r[4], r[1] > 0) for r in digest(repeats.remove_repeats(df))}
    assert got == {(None, False), (1, True), (2, False)}  # the null id comes first


def test_long_texts_are_searched_in_segments(spark, rows, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT_BYTES", 700)
    texts = [rows[0][1] * 3, rows[5][1] + rows[0][1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r[:4] for r in digest(repeats.remove_repeats(df))] == plain_repeats(texts, 100)


def test_previous_factors():
    data = np.frombuffer(b"abababcab", np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(data, 2)
    order, previous = repeats.previous_factors(windows)
    assert sorted(order) == list(range(8)) and previous.tolist() == [-1, -1, 0, 1, 2, -1, -1, 4]


# 5 near duplicates

def shingles(text):
    words = [w.decode().translate({c: c + 32 for c in range(65, 91)}) for w in (text or "").encode().split()]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_groups(sets):
    top = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            a, b = sets[i], sets[j]
            if j < i and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = top[i], top[j]
                top = {k: min(x, y) if v in (x, y) else v for k, v in top.items()}
    return top


@pytest.mark.parametrize("region", [256, 2])
def test_near_duplicates_equal_brute_force(docs, empty, rows, monkeypatch, region):
    monkeypatch.setattr(near_dup, "REGION", region)
    sets = {r[0]: shingles(r[1]) for r in rows}
    want = plain_groups(sets)
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {
        i: (len(sets[i]), want[i], want[i] == i) for i in want}
    assert got[36].component_id == 3 and got[41].component_id == 41
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_duplicates_with_repeated_and_null_ids(spark, rows):
    t = rows[1][1]
    df = spark.createDataFrame([(5, t), (5, t), (7, t), (None, t), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()), key=str)
    assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True), (None, 5, True)] or got == [
        (5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True), (None, None, True)]


def template_family(n, twins, seed):
    """``n`` texts of pairwise similarity about 0.70; each of the first ``twins``
    has another, at about 0.78, among the last ones."""
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(1200)]
    changes = [{s: rnd.random() for s in rnd.sample(range(120), 24)} for _ in range(n - twins)]
    for c in changes[:twins]:
        kept = dict(rnd.sample(sorted(c.items()), 9))
        changes.append(kept | {s: rnd.random() for s in rnd.sample([s for s in range(120) if s not in c], 15)})
    return [" ".join(f"x{c[i // 10]}" if i % 10 == 5 and i // 10 in c else w for i, w in enumerate(base)) for c in changes]


def template_groups(texts):
    """Components by all pairs, from whole 0/1 matrices."""
    sets = [shingles(t) for t in texts]
    often = Counter(x for s in sets for x in s)
    number = {x: k for k, x in enumerate(x for x in often if often[x] > 1)}
    bits = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        bits[i, [number[x] for x in s if x in number]] = 1
    both, size = bits @ bits.T, np.array([len(s) for s in sets])
    top = np.arange(len(sets))
    for i, j in zip(*np.nonzero(100 * both >= 75 * (size[:, None] + size - both))):
        if top[i] != top[j]:
            top[top == max(top[i], top[j])] = min(top[i], top[j])
    return dict(enumerate(top.tolist()))


@pytest.mark.parametrize("n,twins", [(120, 25), (2000, 60)])
def test_true_links_in_a_family_below_the_threshold(spark, n, twins):
    texts = template_family(n, twins, 4)
    want = template_groups(texts)
    assert len(set(want.values())) > n / 4 and len(set(want.values())) < n
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()} == want


@pytest.mark.parametrize("size", [2, 7, 256])
def test_tiles_bring_all_labels_together(spark, size):
    rows = [(g, i, i if i % 3 or g else 0) for g in range(2) for i in range(20)] + [(2, 50, 5), (2, 51, 5)]
    tiled = near_dup.tiles(spark.createDataFrame(rows, "grp long, id long, label long"), size).collect()
    met = {(x.grp, x.id, y.id) for x in tiled for y in tiled
           if (x.grp, x.t, x.u) == (y.grp, y.t, y.u) and (x.t == x.u or x.own and not y.own)}
    met |= {(g, y, x) for g, x, y in met}
    assert {(g, i, j) for g, i, x in rows for h, j, y in rows if g == h and x != y} <= met
    assert 2 not in {r.grp for r in tiled}


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [
        (rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(30)]
    top = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = top[a], top[b]
        top = {k: min(x, y) if v in (x, y) else v for k, v in top.items()}
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: v for k, v in top.items() if k in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("part", [10**6, 40])
def test_links_are_thinned_to_trees(spark, part):
    rnd = random.Random(4)
    dense = [(a, b) for a in range(60) for b in range(60) if rnd.random() < 0.3] + [(7, 7), (100, 99), (99, 100)]
    kept = [tuple(r) for r in spanning_links(spark.createDataFrame(dense, "a long, b long"), part).collect()]
    assert all(a < b and (b < 60 or a == 99) for a, b in kept)
    found = dict(tuple(r) for r in components(spark.createDataFrame(kept, "a long, b long")).collect())
    assert found == {x: 0 for x in range(60)} | {99: 99, 100: 99}
    assert spanning_links(spark.createDataFrame([], "a long, b long")).count() == 0
    assert len(kept) < 500 if part == 40 else len(kept) < 250  # of some 900


# 6 line dedup

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_edit_distance(spark):
    rnd = random.Random(2)
    pairs = []
    for _ in range(400):
        x = [rnd.choice("abc") for _ in range(rnd.randint(3, 30))]
        y = list(x)
        for _ in range(rnd.randint(0, 4)):
            p, what = rnd.randrange(len(y) + 1), rnd.randrange(3)
            y[p:p + (what > 0)] = [rnd.choice("abc")] if what < 2 else []
        x, y = sorted(("".join(x), "".join(y)), key=len)
        if len(x) > 2:
            pairs.append((x, y))
    df = spark.createDataFrame(pairs, "x string, y string")
    for edits in (1, 2):
        got = df.where(F.length("y") - F.length("x") <= edits).select(
            "x", "y", line_dedup.edit_distance(F.split("x", ""), F.split("y", ""), edits).alias("d")).collect()
        for r in got:
            want = distance(r.x, r.y)
            assert (r.d == want) if want <= edits else r.d > edits


def test_lines_equal_brute_force(spark, docs, empty, rows):
    rnd = random.Random(8)
    base = [sentence(rnd, "en", 25), sentence(rnd, "de", 14)]
    extra = []
    for i in range(30):
        own = []
        for b in base:
            for _ in range(rnd.randint(0, 3)):
                p = rnd.randrange(len(b))
                b = b[:p] + rnd.choice(["", "q", "zü"]) + b[p + rnd.randint(0, 1):]
            own.append(b)
        extra.append((100 + i, "\n".join([*own, "", "short", "short"])))
    every = [(r[0], r[1]) for r in rows] + extra
    df = spark.createDataFrame(every, "doc_id long, text string")
    lines = [(d, p, s) for d, t in every for p, s in enumerate((t or "").split("\n")) if s.strip()]
    first = {}
    for d, p, s in lines:
        first.setdefault(s, (d, p))
    limit = lambda s: min(2, len(s) // 64)
    top, links = {v: v for v in first.values()}, {v: 0 for v in first.values()}
    texts = sorted(first, key=len)
    for i, x in enumerate(texts):
        for y in texts[i + 1:]:
            if len(y) - len(x) <= limit(x) and limit(x) and distance(x, y) <= limit(x):
                a, b = top[first[x]], top[first[y]]
                top = {k: min(a, b) if v in (a, b) else v for k, v in top.items()}
                links[first[x]] += 1
                links[first[y]] += 1
    _, got = line_dedup.line_classes(df)
    got = {(r.uid, r.pos): ((r.class_uid, r.class_pos), r.n_links, r.kept) for r in got.collect()}
    assert got == {(d, p): (top[first[s]], links[first[s]], top[first[s]] == (d, p)) for d, p, s in lines}
    assert sum(links.values()) > 50
    texts = {r.extra.doc_id: r.text for r in line_dedup.remove_lines(df).collect()}
    for d, t in every:
        kept = [s for p, s in enumerate((t or "").split("\n")) if not s.strip() or got[d, p][2]]
        assert texts[d] == "\n".join(kept)
    assert line_dedup.remove_lines(empty).count() == 0


def test_line_plan_has_no_python(spark, docs, capsys):
    _, lines = line_dedup.line_classes(docs)
    lines.explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Pandas", "Arrow"))


# 7 fingerprints

def prints(*texts):
    raw = [t.encode() for t in texts]
    return fingerprint.fingerprints(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def test_parsing_is_locally_consistent():
    rnd = random.Random(4)
    a, b = sentence(rnd, "en", 300), sentence(rnd, "de", 300)
    p = prints(a, "shifted by this " + a, a, b, "", "z", "aaaa" * 500)
    assert (p[0] == p[2]).all()
    near = fingerprint.likeness(p[[0, 0, 4, 4]], p[[1, 3, 4, 5]])
    assert near[0] > 0.8 and near[1] < 0.1 and near[2] == 1 and near[3] == 0
    assert (prints(a)[0] == p[0]).all()  # whatever stands beside it


def test_compare_with_next(docs, empty, spark, rows):
    got = {r.doc_id: r for r in fingerprint.compare_with_next(docs).collect()}
    texts = [r[1] or "" for r in rows]
    assert len(got) == len(rows)
    for i, t in enumerate(texts):
        new = fingerprint.edited(t, texts[(i + 1) % len(texts)])
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and got[i].n_chars == len(t)
        p = prints(t, new, texts[(i + 1) % len(texts)])
        assert got[i].fingerprint == p[0].astype(">u2").tobytes().hex()
        assert [got[i].near_edited, got[i].near_next] == fingerprint.likeness(p[[0, 0]], p[[1, 2]]).tolist()
    assert fingerprint.compare_with_next(empty).count() == 0
    odd = spark.createDataFrame([(None, "abc"), (3, "abcdefgh"), (3, "abcdefgh"), (9, None)], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in fingerprint.compare_with_next(odd).collect()) == ["3", "3", "9", "None"]
    one = fingerprint.compare_with_next(odd.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1


# 8 packing

def test_best_fit_keeps_every_capacity():
    rnd = np.random.default_rng(2)
    lengths = rnd.integers(1, 2049, 700)
    for cap in (packing.Capacity(), packing.Capacity(rule="dot"), packing.Capacity(documents=3), packing.Capacity(attention=2048 * 2048 // 1)):
        bins, offsets = packing.best_fit(lengths, cap)
        for b in np.unique(bins):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(offsets[own])]
            assert lengths[own].sum() <= cap.tokens and len(own) <= cap.documents
            assert (lengths[own] ** 2).sum() <= cap.attention
            assert offsets[own].tolist() == np.concatenate([[0], np.cumsum(lengths[own])[:-1]]).tolist()
        if cap.documents > 3:
            assert bins.max() + 1 <= math.ceil(lengths.sum() / 2048) * 1.02 + 1
    assert len(packing.best_fit(np.zeros(0, np.int64), packing.Capacity())[0]) == 0
    with pytest.raises(ValueError):
        packing.best_fit(np.array([3000]), packing.Capacity())


def test_packing_round_trip(docs, empty, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) == len(ids) and all(r.length == 2048 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
        assert len(own) == math.ceil(len(ids) / 2048)
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) <= 2048
    assert packing.pack_documents(empty).count() == 0


# 9 BPE

def test_bpe_equals_the_library(docs, empty, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(1)
    odd = ["", "  ", "a" * 300, "ΑΣ Σ ΣΑΣ", "İstanbul ſ K", "x<|endoftext|>y <|startoftext|>", "\x1c\x1d a\x85b\u3000c",
           "é é 'S IT'S I'LL ''re", "👍🏽 日本語 123 ½Ⅷ", "ab\x00c", "the" * 1000, "".join(rnd.choice("abcd") for _ in range(2000))]
    odd += ["".join(rnd.choice(["a", "th", "É", "Σ", " ", "\n", "'s", "7", "%", "\u0301", "<|endoftext|>"])
                    for _ in range(rnd.randint(0, 50))) for _ in range(300)]
    own = bpe.WordBpe()
    for text, (ids, decoded) in zip(odd, own.encode_batch(odd)):
        want = tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded == own.decode(ids) == tok.decode(want, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.encode(docs).collect()}
    for i, t, *_ in rows:
        assert got[i].ids == tok.encode(t or "", add_special_tokens=False).ids and got[i].n_tokens == len(got[i].ids)
    assert bpe.encode(empty, digests=True).count() == 0


def test_bpe_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    own = bpe.WordBpe()
    a = own.encode_batch(["one two three"]), own.encode_batch(["four five one"])
    monkeypatch.setattr(bpe, "CACHE_WORDS", 1000)
    assert a == (bpe.WordBpe().encode_batch(["one two three"]), bpe.WordBpe().encode_batch(["four five one"]))


# 10 toxicity

def test_grammar_states():
    m = toxicity.Grammar({"fool": 2.0, "blargh*": 3.0}).matcher()
    at = lambda text: {c: v for c, v in zip(toxicity.CHANNELS, m.channels(text)) if v}
    assert list(at("What a fool.")) == ["plain"]
    assert list(at("You are a fool.")) == ["aimed"]
    assert list(at("That is not a fool.")) == ["negated"]
    assert list(at("It was said a fool left.")) == ["reported"]
    assert list(at("I will kill you")) == ["threat_aimed"]
    assert list(at("I will never kill")) == ["threat_negated"]
    assert at("blarghing around")["plain"] == pytest.approx(math.log1p(3))
    assert at("unfoolish, foolish") == {} and at("") == {}
    assert list(at("They said. A fool!")) == ["plain"]  # a new clause


def test_toxicity_learns_terms(spark, empty):
    rnd = random.Random(6)
    rows = []
    for i in range(300):
        bad = i % 5 == 0
        words = sentence(rnd, "en", 30).split()
        if bad:
            words[rnd.randrange(30)] = rnd.choice(["snarf", "blixter"]) + rnd.choice(["", "o", "um"])
        rows.append((i, " ".join(words), int(bad)))
    rows += [(300, None, 1), (301, "", 0), (302, "fine words", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = toxicity.learn(df.select("doc_id", "text"), df.where("doc_id % 3 > 0").select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.score(df.select("doc_id", "text", F.lit(1).alias("score")), grammar).collect()}
    held = [r for r in rows[:300] if r[0] % 3 == 0]
    assert sum(got[i].predicted == y for i, _, y in held) >= len(held) - 2
    assert got[300].predicted == got[301].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    none = toxicity.learn(empty, empty.select("doc_id", F.lit(1).alias("toxic")))
    assert none.terms == {} and toxicity.score(empty, none).count() == 0


# pipeline and registry

def test_pipeline(spark, docs, rows, tmp_path):
    columns = "doc_id text lang source n_chars".split()
    docs.select(*columns).write.parquet(str(tmp_path / "documents.parquet"))
    stages = {}
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        stages[name] = {r.doc_id: r for r in frame.collect()}
        if name != "best_fit_packing":
            assert frame.columns == columns
            assert all(r.n_chars == len(r.text) for r in stages[name].values())
    texts = {r[0]: r[1] for r in rows}
    ids = stages["language_id"]
    assert not {40, 41, 42, 43} & set(ids) and len(ids) >= len(rows) - 7
    assert all(r.text == texts[i] for i, r in ids.items())
    lines = stages["line_dedup"]
    assert 36 not in lines and 37 not in lines  # copies lose all their lines
    groups = plain_groups({i: shingles(r.text) for i, r in lines.items()})
    assert set(stages["minhash_near_dup"]) == {i for i, top in groups.items() if i == top}
    kept = stages["minhash_near_dup"]
    for (i, r), (_, n, _, _) in zip(sorted(kept.items()), plain_repeats([kept[i].text for i in sorted(kept)], 100)):
        own = stages["suffix_array_dedup"].get(i)
        assert len(own.text.encode()) <= len(r.text.encode()) - n if own else n > 0
    assert set(stages["best_fit_packing"]) == set(stages["suffix_array_dedup"])
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.count() == frame.count()


def test_pipeline_on_an_empty_table(spark, empty, tmp_path):
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
