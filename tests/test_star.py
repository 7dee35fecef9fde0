"""G1, G2, G6/G7, G11 on hand-made stars; the top-n plan is a WindowGroupLimit."""

from pyspark.sql import functions as F

from trellis.operators import graph, star

EDGE = "center_id string, rel_id string, rel_label string, nbr_id string, nbr_label string, nbr_rank double, ord int"


def test_top_n_ties_and_default_rank(spark):
    # ranks 3, NULL (-> 0.5), 3, 0.1 with N = 3: the two 3s, then 0.5
    e = spark.createDataFrame([
        ("Q1", "P1", "r", "Q12", "a", 3.0, 0), ("Q1", "P1", "r", "Q13", "b", None, 1),
        ("Q1", "P1", "r", "Q11", "c", 3.0, 2), ("Q1", "P1", "r", "Q14", "d", 0.1, 3)], EDGE)
    e = e.withColumn("nbr_rank", F.coalesce("nbr_rank", F.lit(0.5)))
    got = [r["nbr_id"] for r in star.top_n(e, 3).orderBy("pos").collect()]
    assert got == ["Q11", "Q12", "Q13"]


def test_collapse_keeps_first_position_last_relation(spark):
    e = spark.createDataFrame([
        ("c", "P1", "p1", "x", "X", 1.0, 0), ("c", "P2", "p2", "y", "Y", 1.0, 1),
        ("c", "P3", "p3", "x", "X", 1.0, 2)], EDGE).withColumn("pos", F.col("ord"))
    rows = {r["nbr_id"]: r for r in star.collapse_multi_edges(e).collect()}
    assert rows["x"]["pos"] == 0 and rows["x"]["rel_id"] == "P3"
    assert rows["y"]["pos"] == 1


def test_cut_before_collapse(spark):
    e = spark.createDataFrame([
        ("Q1", "P1", "p1", "Q2", "x", 0.9, 0), ("Q1", "P2", "p2", "Q3", "y", 0.1, 1),
        ("Q1", "P3", "p3", "Q2", "x", 0.9, 2)], EDGE)
    out = star.collapse_multi_edges(star.top_n(e, 2)).collect()
    assert [(r["nbr_id"], r["rel_id"]) for r in out] == [("Q2", "P3")]


def test_textualise(spark):
    e = spark.createDataFrame([("A", 0, "knows", "B"), ("A", 1, "likes", "C")],
                              "center_id string, pos int, rel_label string, nbr_label string")
    c = spark.createDataFrame([("A", "A")], "id string, label string")
    t = star.textualise(e, c).first()["text"]
    assert t == " Information from the knowledge graph: A knows B. A likes C. \n"


def test_object_removal_keeps_centre(spark):
    e = spark.createDataFrame([("s", "o", 0)], "center_id string, nbr_id string, pos int")
    smp = spark.createDataFrame([(1, "s", "o")], "sample_id int, subject_id string, object_id string")
    r = graph.remove_object(e, smp).first()
    assert (r["n_edges_before"], r["n_edges_after"]) == (1, 0)


def test_top_n_plans_window_group_limit(spark):
    e = spark.range(100).select(F.concat(F.lit("Q"), (F.col("id") % 3).cast("string")).alias("center_id"),
                                F.lit("P1").alias("rel_id"), F.concat(F.lit("Q"), F.col("id").cast("string")).alias("nbr_id"),
                                F.rand(1).alias("nbr_rank"), F.lit(0).alias("ord"))
    plan = star.top_n(e, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
