"""Readers (S6, S7, S11), the query registry and the smoke entry point."""

import json
import os
import tempfile

from trellis.sources import readers

import __spark_entry__ as entry


def test_id_cache_object_and_lines(spark):
    d = tempfile.mkdtemp(prefix="trellis-test-cache-")
    with open(os.path.join(d, "cache.json"), "w") as f:
        json.dump({"m.1": "Q1", "m.2": None}, f)
    got = {r["mid"]: r["qid"] for r in readers.read_id_cache(spark, d, fmt="object").collect()}
    assert got == {"m.1": "Q1", "m.2": None}
    d2 = tempfile.mkdtemp(prefix="trellis-test-cache-")
    with open(os.path.join(d2, "part.json"), "w") as f:
        f.write('{"mid":"m.3","qid":"Q3"}\n{"mid":"m.4","qid":null}\nnot json\n')
    got2 = {r["mid"]: r["qid"] for r in readers.read_id_cache(spark, d2).collect()}
    assert got2 == {"m.3": "Q3", "m.4": None}


def test_star_documents_from_json_files(spark):
    d = tempfile.mkdtemp(prefix="trellis-test-stars-")
    with open(os.path.join(d, "Q42.json"), "w") as f:
        f.write('{"graph": {"central_node": "Q42"}, "nodes": [], "edges": []}')
    r = readers.read_star_documents(spark, d).first()
    assert r["entity"] == "Q42" and json.loads(r["json"])["graph"]["central_node"] == "Q42"


def test_simple_line_parse(spark):
    df = spark.createDataFrame([("s\tp\to\tq",), ("s\tp\to\tq\textra",), ("  s\tp\to\tq  ",)], "value string")
    assert readers.parse_simple_lines(df).count() == 2


def test_registry_contract():
    q = entry.queries()
    sql = entry.oracle_sql()
    assert len(q) >= 60
    assert set(sql) <= set(q)
    from trellis.plans.registry import load_all

    for name, query in load_all().items():
        assert query.ops, name


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.limit(5).collect()
    assert rows and set(df.columns) == {"center_id", "n_edges", "text"}


def test_no_cartesian_or_nested_loop_joins(spark):
    from trellis.plans.registry import load_all

    reg = load_all()
    for name in ["N6_fuzzy_links", "L7_link_losses", "V4_quantiser_stats", "M10e_hit_consistency",
                 "M24e_param_grid", "M25e_missing_eval_cells", "kg_star_text"]:
        plan = reg[name].fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_star_queries_use_whole_stars():
    from trellis.plans import dictionary, graph, linkpred, qa

    assert {dictionary.N_DICT, graph.N_WHOLE, linkpred.N_STAR, qa.N_STAR} == {10_000}


def test_qa_row_keys_are_unique(spark):
    from trellis.plans.qa import a8_qa_rows

    keys = a8_qa_rows(spark, "/root/testdata/sf0.001").select("row_key")
    assert keys.count() == keys.distinct().count()
