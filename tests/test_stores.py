"""K3/S12 graph store, E7 strict lookup, SP11 resume, M21e prefix scan."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trellis.operators import runlog
from trellis.operators import split as sp
from trellis.sources import graph_store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rnd = random.Random(1)
    ents = [f"Q{i}" for i in sorted(rnd.sample(range(1000), 60))]
    rels = ["P1", "P2", "P10"]
    triples = {(rnd.choice(ents[:30]), rnd.choice(rels), rnd.choice(ents)) for _ in range(150)}
    triples |= {(ents[4], "P2", e) for e in ents}  # a hub over several blocks
    num = lambda x: int(x[1:])
    ordered = sorted(triples, key=lambda t: tuple(map(num, t)))
    path = str(tmp_path_factory.mktemp("store"))
    e = spark.createDataFrame([(x, f"label, \"{x}\"", i) for i, x in enumerate(ents)], "id string, label string, ordinal long")
    r = spark.createDataFrame([(x, f"rel {x}", i) for i, x in enumerate(rels)], "id string, label string, ordinal long")
    t = spark.createDataFrame([(*x, i) for i, x in enumerate(ordered)], "s string, p string, o string, ordinal long")
    graph_store.write_store(path, e, r, t, block=16, blocks_per_file=2)
    return path, e, r, t, ents, rels, ordered


def test_store_round_trip(spark, store):
    path, e, r, t, ents, rels, ordered = store
    for got, want in zip(graph_store.read_dictionaries(spark, path), (e, r, t)):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    edges = [(ents.index(a), rels.index(b), ents.index(c)) for a, b, c in ordered]
    assert sorted(map(tuple, graph_store.read_edges(spark, path).collect())) == sorted(edges)
    for first, last in ((4, 4), (0, 7), (29, 60), (59, 59), (7, 3)):
        got = sorted(map(tuple, graph_store.read_edges(spark, path, first, last).collect()))
        assert got == sorted(x for x in edges if first <= x[0] <= last)


def test_lookup_reads_one_range(spark, store, capsys):
    path = store[0]
    graph_store.read_edges(spark, path, 20, 20).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(last_subject,20)" in plan and "LessThanOrEqual(first_subject,20)" in plan
    blocks = spark.read.parquet(f"{path}/edge_blocks")
    assert blocks.agg(F.max(F.size("objects"))).first()[0] <= 16 and blocks.count() > 8


def test_strict_lookup(spark, tmp_path, capsys):
    vecs = spark.createDataFrame([(f"Q{i}", [float(i), 1.0]) for i in range(50)], "id string, vec array<double>")
    graph_store.write_vector_table(vecs, "strict_vectors", str(tmp_path / "v"), 4)
    stored = spark.table("strict_vectors")
    ids = spark.createDataFrame([("Q7",), ("Q3",), ("Q7",)], "id string")
    assert sorted((r["id"], r["vec"][0]) for r in graph_store.strict_lookup(ids, stored).collect()) == [("Q3", 3.0), ("Q7", 7.0), ("Q7", 7.0)]
    assert graph_store.strict_lookup(ids.limit(0), stored).count() == 0
    for missing in ("Q99", None):
        with pytest.raises(Exception, match=f"no vector for id {missing or 'null'}"):
            graph_store.strict_lookup(ids.union(spark.createDataFrame([(missing,)], "id string")), stored).collect()
    graph_store.strict_lookup(ids.hint("merge"), stored.hint("merge")).explain("formatted")
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and plan.count("hashpartitioning") == 1  # the ids move, the table does not


def test_resume_equals_the_tail_of_the_epoch(spark, tmp_path):
    rows = [(i, s, p, p // 4) for s, n in (("train", 90), ("validation", 10)) for i, p in zip(random.Random(2).sample(range(1000), n), range(n))]
    df = spark.createDataFrame(rows, "doc_id long, split string, pos long, batch_id long")
    path = str(tmp_path / "b")
    sp.write_batches(df, path, 3)
    n = 23  # batches of the train split, the last one short
    for step in (0, 1, 11, 22, 23, 1000):
        got = sp.resume_batches(spark, path, "train", step, 3)
        assert sorted(tuple(r) for r in got.select("doc_id", "split", "pos", "batch_id").collect()) == sorted(
            x for x in rows if x[1] == "train" and x[3] >= step % n)
        ranges = {f.split("batch_range=")[1].split("/")[0] for f in got.select(F.input_file_name().alias("f")).toPandas()["f"]}
        assert ranges == {str(i) for i in range(step % n // 3, 8)}
    plan = sp.resume_batches(spark, path, "train", 11, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "batch_range" in plan.split("PartitionFilters")[1]
    assert sp.resume_batches(spark, path, "test", 5, 3).count() == 0


@pytest.mark.parametrize("block", [1 << 16, 7, 1])
def test_moving_average_over_blocks(spark, block):
    rnd = random.Random(3)
    runs = {"a": [rnd.uniform(-5, 5) for _ in range(200)], "b": [1.0], None: [2.0, 4.0, 8.0],
            "inf": [1.0] * 20 + [math.inf] + [3.0] * 30, "both": [math.inf] + [0.0] * 12 + [-math.inf, 1.0],
            "nan": [5.0, math.nan] + [1.0] * 20}
    rows = [(k, i * 2, v, "x") for k, vs in runs.items() for i, v in enumerate(vs)]
    rnd.shuffle(rows)
    got = {}
    for r in runlog.ema(spark.createDataFrame(rows, "run string, step int, value double, ema string"), block=block).collect():
        got[r["run"], r["step"] // 2] = r["ema"]
    assert len(got) == len(rows)
    for k, vs in runs.items():
        now = None
        for i, v in enumerate(vs):
            now = v if now is None else 0.7 * now + 0.3 * v
            have = got[k, i]
            assert (math.isnan(have) and math.isnan(now)) or have == pytest.approx(now, rel=1e-12, abs=1e-15), (k, i)


def test_moving_average_of_nothing(spark):
    assert runlog.ema(spark.createDataFrame([], "run string, step int, value double")).count() == 0


def test_dictionary_reads_star_edges_once(spark, monkeypatch):
    """The stars behind the entity dictionary are computed once and stored: its branches and
    its callers read columns (each computed the stars anew before)."""
    from trellis.plans import dictionary

    edges = spark.createDataFrame([("Q1", 0, "P1", "in", "Q2", "two", 0.5), ("Q1", 1, "P1", "in", "Q3", "three", 0.5)],
                                  "center_id string, pos int, rel_id string, rel_label string, nbr_id string, nbr_label string, nbr_rank double")
    centers = spark.createDataFrame([("Q1", "one", 0.5), ("Q2", "two", 0.5)], "id string, label string, rank double")
    monkeypatch.setattr(dictionary, "star_tables", lambda spark, sf_dir: (edges, centers))
    d, kept = dictionary.entity_dict(spark, "")
    assert "parquet" in kept._jdf.queryExecution().optimizedPlan().toString() and kept.schema == edges.schema
    assert sorted(map(tuple, d.select("id", "label", "ordinal").collect())) == [("Q1", "one", 0), ("Q2", "two", 1), ("Q3", "three", 2)]
