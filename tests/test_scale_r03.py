"""Round 3: steps that were computed or shuffled more often than once."""

import json

from pyspark.sql import functions as F

from trellis.operators import corpus, graph, qa
from trellis.operators.ordinal import dense_ordinal
from trellis.sources import readers

EDGE = "center_id string, pos int, rel_id string, rel_label string, nbr_id string, nbr_label string, nbr_rank double"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ordinal_numbers_rows_without_a_window_over_them(spark):
    df = spark.createDataFrame([(3, "c"), (1, None), (2, "b"), (2, "b"), (None, "z")], "k int, v string")
    out = dense_ordinal(df.withColumn("h", F.col("k")), None, [F.col("h"), F.col("v")], helpers=("h",))
    assert plan(out).count("Window") == 1  # over the bucket table only
    rows = sorted(out.collect(), key=lambda r: r["ordinal"])
    assert out.columns == ["k", "v", "ordinal"]
    assert [(r["k"], r["ordinal"]) for r in rows] == [(None, 0), (1, 1), (2, 2), (2, 3), (3, 4)]


def test_edge_index_reads_the_stars_once(spark):
    e = spark.createDataFrame([("Q1", 0, "P1", "p", "Q2", "b", 1.0), ("Q1", 4, "P2", "p", "Q3", "c", 1.0),
                               (None, 0, "P1", "p", "Q4", "d", 1.0)], EDGE).repartition(2)
    b = graph.bidirectional_edges(e)
    assert "Join" not in plan(b) and "Union" not in plan(b)
    assert sorted((r["edge_pos"], r["src_pos"], r["dst_pos"], r["rel_id"]) for r in b.collect()) == [
        (0, 1, 0, "P1"), (1, 2, 0, "P2"), (2, 0, 1, "P1"), (3, 0, 2, "P2")]


def doc(centre, nodes, links, key="links"):
    return json.dumps({"directed": True, "multigraph": False, "graph": {"central_node": centre},
                       "nodes": [{"id": i, "label": lb, "rank": 1.0} for i, lb in nodes],
                       key: [{"source": centre, "target": t, "id": "P1", "label": "p"} for t in links]})


def test_node_link_documents_are_parsed_once(spark):
    docs = spark.createDataFrame([
        ("A", doc("A", [("A", "a"), ("B", "b"), ("C", "c")], ["B", "C"])),
        ("D", doc("D", [("E", "e"), ("D", "d"), ("F", "f")], ["F", "E", "X"], "edges")),
        ("G", doc("G", [("G", "g"), ("H", "h1"), ("H", "h2")], ["H"])),
        ("T", doc("T", [("T", "t"), ("U", "u1")], ["U"])), ("T", doc("T", [("T", "t"), ("U", "u2")], ["U"]))],
        "entity string, json string")
    out = graph.parse_node_link(docs)
    got = sorted((r["entity"], r["pos"], r["nbr_id"], r["nbr_label"] or "") for r in out.collect())
    assert got == [("A", 0, "B", "b"), ("A", 1, "C", "c"), ("D", 0, "F", "f"), ("D", 1, "E", "e"), ("D", 2, "X", ""),
                   ("G", 0, "H", "h1"), ("G", 0, "H", "h2"),
                   ("T", 0, "U", "u1"), ("T", 0, "U", "u1"), ("T", 0, "U", "u2"), ("T", 0, "U", "u2")]
    # one scan of the entities' own documents; the join is for entities met twice
    single = out.where(F.col("entity") == "A")
    assert plan(single).count("LeftAnti") == 1


def test_aligned_corpus_is_compressed_and_read_back(spark, tmp_path):
    ent = "named_struct('boundaries', array(0, 1), 'surfaceform', 's', 'uri', 'Q1', 'annotator', 'r')"
    docs = spark.range(50).selectExpr(
        "cast(id as string) docid", "'t' title", "'x }{ y' text", "'u' uri", "cast(array() as array<array<int>>) words_boundaries",
        "array(array(0, 7)) sentences_boundaries",
        f"array(named_struct('sentence_id', 0, 'subject', {ent}, 'predicate', {ent}, 'object', {ent}, "
        "'dependency_path', cast(null as string), 'confidence', cast(1 as float), 'annotator', 'r')) triples",
        f"array({ent}) entities", "id _docno").repartition(3)
    path = str(tmp_path / "corpus")
    corpus.write_aligned_corpus(docs, path)
    files = list((tmp_path / "corpus").glob("part-*"))
    assert files and all(f.name.endswith(".gz") for f in files)
    back = readers.read_aligned_corpus(spark, path)
    assert sorted(int(r["docid"]) for r in back.collect()) == list(range(50))


def test_question_texts_join_behind_star_and_labels(spark):
    qs = spark.createDataFrame([("g1", "Q1", "who?"), ("g1", "Q1", "again?"), ("g2", "Q9", "no star?")],
                               "qid string, subject_id string, question string")
    ans = spark.createDataFrame([("g1", 1, "Q2"), ("g1", 2, None), ("g1", 3, "Q3"), ("g2", 1, "Q2"), ("g2", 2, "Q8")],
                                "qid string, answer_pos int, object_id string")
    e = spark.createDataFrame([("Q1", 0, "P1", "p", "Q2", "star b", 2.0)], EDGE)
    nodes = spark.createDataFrame([("Q2", "b", 1.0), ("Q3", "c", 1.5)], "id string, label string, rank double")
    out = qa.answer_rows(qs, ans, e, nodes, count_unresolved=False)
    got = sorted((r["qid"], r["question"], r["answer_pos"], r["object_label"], r["predicate_id"], r["k"]) for r in out.collect())
    assert got == [("g1", q, p, lb, rel, 2) for q in ("again?", "who?") for p, lb, rel in ((1, "star b", "P1"), (3, "c", "Unknown"))] + [
        ("g2", "no star?", 1, "b", "Unknown", 2)]
    joins = [ln for ln in plan(out).splitlines() if "Join" in ln]
    assert "_subject" in joins[0]  # the outermost join is the one with the texts
