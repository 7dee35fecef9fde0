"""E4 is a bijection onto 0..n-1 in sort order, also with a hot key range;
SP1 positional split sizes."""

from pyspark.sql import functions as F

from trellis.operators.ordinal import dense_ordinal
from trellis.operators.split import positional_split


def test_dense_ordinal_bijection_with_skew(spark):
    # a third of the keys fall in one narrow range
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 17).otherwise(F.col("id") * 7919 % 100003).alias("k"),
        F.col("id").alias("tie"))
    out = dense_ordinal(df, F.col("k"), [F.col("k"), F.col("tie")], n_buckets=8).collect()
    got = sorted(out, key=lambda r: r["ordinal"])
    assert [r["ordinal"] for r in got] == list(range(3000))
    keys = [(r["k"], r["tie"]) for r in got]
    assert keys == sorted(keys)


def test_dense_ordinal_per_group(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 5), ("a", 2), ("b", 4)], "g string, k int")
    out = {(r["g"], r["k"]): r["ordinal"] for r in
           dense_ordinal(df, F.col("k"), [F.col("k")], group=["g"]).collect()}
    assert out == {("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("b", 4): 0, ("b", 5): 1}


def test_positional_split_eleven_rows(spark):
    df = spark.range(11).select(F.col("id").alias("k"))
    sizes = {r["split"]: r["count"] for r in
             positional_split(df, F.col("k"), [F.col("k")]).groupBy("split").count().collect()}
    assert sizes == {"train": 8, "validation": 1, "test": 2}


def test_hot_leading_key_is_split_across_buckets(spark):
    # a third of the rows share leading key 0; the tie column splits them
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
                                  F.col("id").alias("tie"))
    sizes = [r["n"] for r in df.repartitionByRange(8, "k", "tie")
             .groupBy(F.spark_partition_id().alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 2 * (3000 / 8)
    out = dense_ordinal(df, None, [F.col("k"), F.col("tie")], n_buckets=8).collect()
    got = sorted(out, key=lambda r: r["ordinal"])
    assert [r["ordinal"] for r in got] == list(range(3000))
    assert [(r["k"], r["tie"]) for r in got] == sorted((r["k"], r["tie"]) for r in got)
