"""Splits, subsets and batches (SP1-SP11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators.ordinal import dense_ordinal

TRAIN, VALID, TEST = "train", "validation", "test"


def hash_unit(key: Column, seed: str = "") -> Column:
    """First 32 bits of md5(seed || key) as a non-negative BIGINT; order of
    this number = order of the md5 hex string's prefix."""
    h = F.md5(F.concat(F.lit(seed), key.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def positional_split(df: DataFrame, bucket_key: Column, order: list[Column],
                     train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """SP1: first ``int(.8n)`` rows train, next ``int(.1n)`` validation, rest
    test, in ``order`` (the dense position is E4)."""
    d = dense_ordinal(df, bucket_key, order, name="pos", with_total=True)
    n = F.col("pos_total")
    n_train = F.floor(n * F.lit(train))
    n_valid = F.floor(n * F.lit(valid))
    split = (F.when(F.col("pos") < n_train, F.lit(TRAIN))
             .when(F.col("pos") < n_train + n_valid, F.lit(VALID))
             .otherwise(F.lit(TEST)))
    return d.withColumn("split", split).drop("pos_total")


def hash_split(key: Column, train_buckets: int = 8, valid_buckets: int = 1) -> Column:
    """SP1 (order-free variant): md5 bucket 0-9; 0-7 train, 8 validation, 9 test."""
    b = F.pmod(hash_unit(key), F.lit(10))
    return (F.when(b < train_buckets, F.lit(TRAIN))
            .when(b < train_buckets + valid_buckets, F.lit(VALID)).otherwise(F.lit(TEST)))


def shuffled_batches(df: DataFrame, key: str, split_col: str, batch_size: int,
                     seed: str) -> DataFrame:
    """SP8 + SP9: train and validation rows in a seeded random order (md5 of
    seed || key), test rows in key order; ``pos`` per split, ``batch_id`` =
    pos div batch_size."""
    shuffled = F.col(split_col).isin(TRAIN, VALID)
    h = hash_unit(F.col(key), seed)
    d = df.withColumn("_sk", F.when(shuffled, h).otherwise(F.col(key).cast("bigint")))
    out = dense_ordinal(d, F.col("_sk"), [F.col("_sk"), F.col(key)], name="pos", group=[split_col])
    return out.withColumn("batch_id", F.floor(F.col("pos") / batch_size).cast("bigint")).drop("_sk")


def max_samples_cut(batch_id: Column, batch_size: int, max_samples: int) -> Column:
    """SP6: whole batches while batch_index * batch_size < max_samples."""
    return batch_id * F.lit(batch_size) < F.lit(max_samples)


def partial_eval(batch_id: Column, n_batches: Column, pct: float) -> Column:
    """SP7: the first ``max(1, int(n_batches * pct))`` batches."""
    return batch_id < F.greatest(F.lit(1), F.floor(n_batches * F.lit(pct)))


def split_sizes(df: DataFrame, split_col: str = "split") -> DataFrame:
    """SP10: rows per split."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows"))


def write_batches(batched: DataFrame, path: str, per_range: int, split_col: str = "split") -> None:
    """SP11: batches written by split and range of ``per_range`` batches, rows in order,
    so that a resume lists only the ranges that are left."""
    r = batched.withColumn("batch_range", F.floor(F.col("batch_id") / per_range).cast("long"))
    (r.repartitionByRange(split_col, "batch_range").sortWithinPartitions(split_col, "batch_range", "pos")
     .write.mode("overwrite").partitionBy(split_col, "batch_range").parquet(path))


def resume_batches(spark: SparkSession, path: str, split: str, global_step: int, per_range: int, split_col: str = "split") -> DataFrame:
    """SP11: the batches that are left of the epoch in which ``global_step`` batches have
    been seen: ``global_step % n_batches`` are skipped, their ranges not read. An empty
    split gives no rows. Reads the number of batches (one range)."""
    whole = spark.read.parquet(path).where(F.col(split_col) == split)
    last = whole.agg(F.max("batch_range")).first()[0]  # from partition names
    if last is None:
        return whole.drop("batch_range")
    n = whole.where(F.col("batch_range") == last).agg(F.max("batch_id") + 1).first()[0]
    skip = global_step % n
    return whole.where((F.col("batch_range") >= skip // per_range) & (F.col("batch_id") >= skip)).drop("batch_range")
