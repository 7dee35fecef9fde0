"""N1 first-graph-wins, N6 fuzzy linking against brute force over all pairs,
LCS, N10 tool-call parsing."""

import random

import pytest
from pyspark.sql import functions as F

from trellis.operators import gazetteer
from trellis.operators import link as lk


def _dp_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for ch in a:
        cur = [0] * (len(b) + 1)
        for j in range(len(b)):
            cur[j + 1] = prev[j] + 1 if ch == b[j] else max(prev[j + 1], cur[j])
        prev = cur
    return prev[-1]


def test_lcs_matches_dynamic_programming():
    rnd = random.Random(3)
    for _ in range(3000):
        a = "".join(rnd.choice("ab#é0") for _ in range(rnd.randint(0, 15)))
        b = "".join(rnd.choice("ab#é0") for _ in range(rnd.randint(0, 15)))
        assert lk.lcs_length(a, b) == _dp_lcs(a, b)


def test_label_index_first_graph_wins(spark):
    g = spark.createDataFrame([("Q2", "Q2", "Blue Bolt"), ("Q10", "Q10", "blue bolt ")],
                              "graph_id string, node_id string, label string")
    r = lk.label_index(g).collect()
    assert [(x["key"], x["entity_id"]) for x in r] == [("blue bolt", "Q2")]


def test_fuzzy_example(spark):
    idx = spark.createDataFrame([("red widget", "Q1"), ("blue bolt", "Q2")], "key string, entity_id string")
    m = spark.createDataFrame([("red widgt",)], "mention string")
    r = lk.link_mentions(m, idx).first()
    assert r["entity_id"] == "Q1" and abs(r["confidence"] - 2 * 9 / 19) < 1e-12


@pytest.mark.parametrize("hot", [64, 2, 0])
def test_fuzzy_blocking_loses_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(lk, "HOT_SEGMENT", hot)
    rnd = random.Random(11)
    alpha = "abcde "
    labels = sorted({"".join(rnd.choice(alpha) for _ in range(rnd.randint(3, 16))).strip() or "x"
                     for _ in range(300)})
    mentions = set()
    for lab in labels[:120]:
        s = list(lab)
        for _ in range(rnd.randint(0, 2)):
            op = rnd.random()
            i = rnd.randrange(len(s) + 1)
            if op < 0.4:
                s.insert(i, rnd.choice(alpha))
            elif s and op < 0.8:
                del s[min(i, len(s) - 1)]
            elif s:
                s[min(i, len(s) - 1)] = rnd.choice(alpha)
        mentions.add("".join(s) or "y")
    idx_rows = [(lab, f"Q{i}") for i, lab in enumerate(labels)]
    idx = spark.createDataFrame(idx_rows, "key string, entity_id string")
    got = {r["mention"]: (r["entity_id"], round(r["confidence"], 9)) for r in
           lk.link_mentions(spark.createDataFrame([(m,) for m in mentions], "mention string"), idx).collect()}
    # brute force: exact first, else best ratio >= 90, ties by index order (numeric id)
    want = {}
    keys = {lab: i for i, lab in enumerate(labels)}
    for m in mentions:
        if m in keys:
            want[m] = (f"Q{keys[m]}", 1.0)
            continue
        best = None
        for i, lab in enumerate(labels):
            s = 100.0 * 2 * _dp_lcs(m, lab) / (len(m) + len(lab))
            if s >= 90 and (best is None or s > best[0]):
                best = (s, i)
        if best:
            want[m] = (f"Q{best[1]}", round(best[0] / 100, 9))
    assert got == want


def test_tool_call_parsing(spark):
    texts = spark.createDataFrame([(1, 'a {"name":"query_knowledge_graph","arguments":{"entity_name":"x y"}} '
                                       'b {"name":"query_knowledge_graph","arguments":{"entity_name":"z",}} '
                                       'c {"name":"other","arguments":{}}')], "id int, text string")
    r = lk.parse_tool_calls(texts).orderBy("call_pos").collect()
    assert [(x["call_pos"], x["name"], x["entity_name"]) for x in r] == [
        (0, "query_knowledge_graph", "x y"), (2, "other", None)]


def test_cumulative_entities_keep_repeats_and_stop(spark):
    turns = spark.createDataFrame([(1, 0, 10), (1, 1, 11), (1, 2, 12), (1, 3, 13), (2, 0, 20)],
                                  "chat_id int, round int, conv_id int")
    calls = spark.createDataFrame(
        [(10, 0, lk.TOOL_NAME, "x", "Q1", "ok"), (10, 1, lk.TOOL_NAME, "y", "Q2", "ok"),
         (11, 0, "lookup", "x", "Q1", "ok"), (11, 1, lk.TOOL_NAME, "x", "Q1", "ok"),
         (11, 2, lk.TOOL_NAME, "z", None, "not found"), (13, 0, lk.TOOL_NAME, "x", "Q1", "ok")],
        "conv_id int, call_pos int, name string, entity_name string, entity_id string, status string")
    got = {(r["chat_id"], r["round"]): r["entities"] for r in lk.cumulative_entities(turns, calls).collect()}
    assert got == {(1, 0): ["Q1", "Q2"], (1, 1): ["Q1", "Q2", "Q1"]}


def test_numbered_names_cost_what_they_match(spark, monkeypatch):
    """Names of one pattern share their segments: rows follow the matches, not the pairs."""
    rows = {}
    near = lk.near_names
    monkeypatch.setattr(lk, "near_names", lambda p, l: rows.setdefault("near", near(p, l)))
    made = {}
    for n in (300, 1500):
        rows.clear()
        idx = spark.createDataFrame([(f"customer#{i:09d}", f"Q{i}") for i in range(n)], "key string, entity_id string")
        typos = spark.createDataFrame([(f"customer#{i:09d}"[:-1],) for i in range(0, n, 10)], "mention string")
        got = {r["mention"]: r["entity_id"] for r in lk.link_mentions(typos, idx).collect()}
        names = [f"{i:09d}" for i in range(n)]
        cut = {"customer#" + x[:j] + x[j + 1:]: f"Q{i}" for i, x in reversed(list(enumerate(names))) for j in range(9)}
        assert got == {f"customer#{x}"[:-1]: cut[f"customer#{x}"[:-1]] for x in names[::10]}  # the first of equal scores
        made[n] = rows["near"].count()
    assert made[1500] < 8 * made[300]


def test_shortened(spark):
    row = spark.createDataFrame([("abca", 2)], "s string, n int").select(lk.shortened("s", F.col("n"), 3).alias("v")).first()
    assert sorted(row["v"]) == sorted({"ab", "ac", "aa", "bc", "ba", "ca"})


def plain_mentions(text, keys):
    words = text.lower().split()
    out, at = [], 0
    while at < len(words):
        n = max((k for k in range(1, len(words) - at + 1) if " ".join(words[at:at + k]) in keys), default=0)
        if n:
            out.append((at, n, " ".join(words[at:at + n])))
        at += n or 1
    return out


@pytest.mark.parametrize("shard_chars", [gazetteer.SHARD_CHARS, 40])
def test_longest_mentions_from_the_left(spark, shard_chars):
    rnd = random.Random(8)
    vocabulary = "red Blue bolt of the ring été Ünder x".split()
    keys = {" ".join(rnd.choice(vocabulary).lower() for _ in range(rnd.randint(1, 7))) for _ in range(40)}
    texts = [(i, rnd.choice([" ", "  ", "\n"]).join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 8, 60])))) for i in range(60)]
    texts += [(100, None), (101, "   "), (102, " ".join(max(keys, key=len) for _ in range(200)))]
    labels = [(k,) for k in keys] + [("",), (None,), ("red  bolt",)]
    keys.add("red bolt")
    got = {}
    for r in gazetteer.mentions(spark.createDataFrame(texts, "text_id long, text string"),
                                spark.createDataFrame(labels, "key string"), shard_chars).collect():
        got.setdefault(r["text_id"], []).append((r["pos"], r["n_words"], r["mention"]))
    want = {i: m for i, t in texts if (m := plain_mentions(t or "", keys))}
    assert {i: sorted(m) for i, m in got.items()} == want


def test_gazetteer_without_labels_or_texts(spark):
    texts = spark.createDataFrame([("a", "some words")], "text_id string, text string")
    none = spark.createDataFrame([], "key string")
    assert gazetteer.mentions(texts, none).count() == 0
    assert gazetteer.mentions(texts.limit(0), spark.createDataFrame([("some",)], "key string")).count() == 0


def test_resolution_statuses(spark):
    idx = spark.createDataFrame([("red widget", "Q1"), ("big red widget", "Q2"), ("blue bolt", "Q3"), ("ceo", "Q4"), ("gadgetry", "Q5")],
                                "key string, entity_id string")
    names = ["Red Widget", "a BIG red widget here", "red widgt", "blue bolt and red widget", "the ceo", "gadgetri", "zzz qqq", "", None, " "]
    calls = spark.createDataFrame([(i, n, "t") for i, n in enumerate(names)], "call_pos int, entity_name string, name string")
    graphs = spark.createDataFrame([("Q1",), ("Q2",), ("Q4",), ("Q5",)], "entity_id string")
    got = {r["call_pos"]: (r["entity_id"], r["matched_name"], r["status"]) for r in lk.resolve_names(calls, idx, graphs).collect()}
    assert got == {0: ("Q1", "red widget", "ok"), 1: ("Q2", "big red widget", "ok"), 2: ("Q1", "red widget", "ok"),
                   3: ("Q3", "blue bolt", "no graph"), 4: ("Q4", "ceo", "ok"), 5: (None, None, "not found"),
                   6: (None, None, "not found"), 7: (None, None, "not found"), 8: (None, None, "not found"), 9: (None, None, "not found")}


def test_roles_and_tokens_are_linked(spark):
    """N2 and N3 yield rows: role words, and tokens of a text with neither span nor role."""
    idx = spark.createDataFrame([("ceo", "Q4"), ("gadgetries", "Q5"), ("red widget", "Q1")], "key string, entity_id string")
    texts = spark.createDataFrame([(1, "Our CEO spoke."), (2, "some gadgetriez here"), (3, "the CEO, gadgetriez")], "text_id int, text string")
    got = {(r["text_id"], r["mention"], r["entity_id"], r["rank"]) for r in lk.extract(texts, idx, 2).collect()}
    assert got == {(1, "ceo", "Q4", 1), (2, "gadgetriez", "Q5", 1), (3, "ceo", "Q4", 1)}


def test_gazetteer_reads_texts_once(spark):
    """However many labels there are, one pass over the texts (a pass a shard before)."""
    keys = [f"order {i}" for i in range(300)] + ["a b c d", "b", "c d"]
    labels = spark.createDataFrame([(k,) for k in keys], "key string")
    texts = spark.createDataFrame([(1, "see order 17 or order 299 or order 300"), (2, "a b c d"), (3, "x a b c  D"), (4, None)],
                                  "text_id long, text string")
    for bits in (40, gazetteer.MAX_BITS):
        found = gazetteer.mentions(texts, labels, bits)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        assert sorted(map(tuple, found.collect())) == [(1, 1, 2, "order 17"), (1, 4, 2, "order 299"), (2, 0, 4, "a b c d"),
                                                       (3, 1, 4, "a b c d")]


def test_label_map_holds_every_label(spark):
    from pyspark.sql import functions as F

    keys = spark.createDataFrame([(f"label {i}",) for i in range(5000)], "key string")
    bits = gazetteer.label_map(keys, 5000, 1 << 17)
    assert len(bits) * 8 == 1 << 17
    for (h,) in keys.select(F.xxhash64("key")).collect():
        assert all(bits[at >> 3] >> (at & 7) & 1 for at in (h & ((1 << 17) - 1), (h >> 32) & ((1 << 17) - 1)))
    assert 0.05 < sum(int(b).bit_count() for b in bits) / (len(bits) * 8) <= 10_000 / (1 << 17)
