"""Dense 0-based ordinals in sort order without a single-partition window.

1. Range-partition the rows on the full sort tuple (Spark samples the
   boundaries and assigns buckets by binary search), sort within the buckets, tag
   each row with its bucket and its place there, and store them, which freezes both.
2. Count rows per bucket; a running sum over the few bucket rows gives each
   bucket's offset (a bounded table).
3. ordinal = offset + place within the bucket: the rows are not shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.session import stored


def dense_ordinal(df: DataFrame, bucket_key: Column | None, order: list[Column],
                  n_buckets: int | None = None, name: str = "ordinal",
                  with_total: bool = False, group: list[str] | None = None,
                  helpers: tuple[str, ...] = ()) -> DataFrame:
    """Add ``name`` = 0-based position of each row in ``order`` (restarting
    per ``group`` if given).

    Buckets are ranges of the full sort tuple chosen by Spark's range
    partitioner (sampled boundaries, binary search), so a hot leading key --
    say one subject holding a third of all triples -- is still split across
    buckets by the following sort columns. Bucket and place are frozen by
    storing them right after they are assigned, so the counting,
    offset and numbering passes agree even when a task is recomputed.
    ``bucket_key`` is accepted for callers that know a numeric leading key;
    the range partitioner does not need it. ``helpers`` are columns that only
    ``order`` needs; they are left out of the result.
    """
    group = list(group or [])
    spark = df.sparkSession
    n_buckets = n_buckets or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2)
    keys = [F.col(g) for g in group] + list(order)
    # the id's upper bits are the partition, its lower 33 the row's place there
    d = stored(df.repartitionByRange(n_buckets, *keys).sortWithinPartitions(*keys)
               .withColumn("_id", F.monotonically_increasing_id())
               .withColumn("_bucket", F.shiftright("_id", 33).cast("int"))
               .withColumn("_place", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", *helpers), "ordinal")
    counts = d.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    # windows over the bounded bucket table only (groups x <= n_buckets rows)
    w = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_bucket",
                            (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_off"),
                            F.sum("_n").over(Window.partitionBy(*group)).alias("_total"))
    # without groups there is one row a bucket
    out = d.join(offsets if group else F.broadcast(offsets), [*group, "_bucket"]) \
        .withColumn(name, (F.col("_off") + F.col("_place")).cast("bigint"))
    if with_total:
        out = out.withColumnRenamed("_total", f"{name}_total")
    else:
        out = out.drop("_total")
    return out.drop("_bucket", "_place", "_off")
