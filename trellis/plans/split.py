"""Split, subset and batch queries (SP1, SP6-SP10, E4) over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.operators import split as sp
from trellis.plans.registry import register
from trellis.session import scratch_path
from trellis.sources.tables import Tables

BATCH_SIZE = 8
SEED = "42"
MAX_SAMPLES = 50
EVAL_SHARE = 0.25

_SQL_HASH = "CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT)"

SQL_POSITIONAL = """
pos AS (
  SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS pos, count(*) OVER () AS n
  FROM documents
),
split AS (
  SELECT doc_id, pos,
         CASE WHEN pos < floor(n * 0.8) THEN 'train'
              WHEN pos < floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split
  FROM pos
)"""


def positional(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.select("doc_id")
    return sp.positional_split(docs, F.col("doc_id"), [F.col("doc_id")])


@register("SP1_positional_split", "SP1 E4", sql=f"""
WITH {SQL_POSITIONAL}
SELECT doc_id, pos, split FROM split
""")
def sp1_positional_split(spark, sf_dir):
    """80/10/10 by position in doc_id order; the position is a distributed
    dense ordinal (bucketed running offsets, no single-partition window)."""
    return positional(spark, sf_dir).select("doc_id", "pos", "split")


@register("SP1_hash_split", "SP1", sql=f"""
SELECT doc_id,
       CASE WHEN {_SQL_HASH.format(x="CAST(doc_id AS VARCHAR)")} % 10 < 8 THEN 'train'
            WHEN {_SQL_HASH.format(x="CAST(doc_id AS VARCHAR)")} % 10 < 9 THEN 'validation'
            ELSE 'test' END AS split
FROM documents
""")
def sp1_hash_split(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", sp.hash_split(F.col("doc_id")).alias("split"))


@register("SP10_split_sizes", "SP10 SP2", sql=f"""
WITH {SQL_POSITIONAL}
SELECT split, count(*) AS n_rows FROM split GROUP BY 1
""")
def sp10_split_sizes(spark, sf_dir):
    return sp.split_sizes(positional(spark, sf_dir))


SQL_BATCHES = SQL_POSITIONAL + f""",
keyed AS (
  SELECT doc_id, split,
         CASE WHEN split IN ('train', 'validation') THEN {_SQL_HASH.format(x=f"'{SEED}' || CAST(doc_id AS VARCHAR)")}
              ELSE doc_id END AS sk
  FROM split
),
batched AS (
  SELECT doc_id, split, CAST(row_number() OVER (PARTITION BY split ORDER BY sk, doc_id) - 1 AS BIGINT) AS pos
  FROM keyed
),
batches AS (SELECT doc_id, split, pos, CAST(pos // {BATCH_SIZE} AS BIGINT) AS batch_id FROM batched)"""


def batches(spark, sf_dir):
    return sp.shuffled_batches(positional(spark, sf_dir).drop("pos"), "doc_id", "split",
                               BATCH_SIZE, SEED)


@register("SP8_shuffled_batches", "SP8 SP9", sql=f"""
WITH {SQL_BATCHES}
SELECT doc_id, split, pos, batch_id FROM batches
""")
def sp8_shuffled_batches(spark, sf_dir):
    """Seeded shuffle for train/validation, key order for test; batches of 8."""
    return batches(spark, sf_dir).select("doc_id", "split", "pos", "batch_id")


@register("SP6_eval_subsets", "SP6 SP7", sql=f"""
WITH {SQL_BATCHES},
nb AS (SELECT split, max(batch_id) + 1 AS n_batches FROM batches GROUP BY 1)
SELECT b.doc_id, b.split, b.batch_id,
       b.batch_id * {BATCH_SIZE} < {MAX_SAMPLES} AS in_max_samples,
       b.batch_id < greatest(1, floor(nb.n_batches * {EVAL_SHARE})) AS in_partial_eval
FROM batches b JOIN nb USING (split)
WHERE b.split IN ('validation', 'test')
""")
def sp6_eval_subsets(spark, sf_dir):
    """Evaluation subsets as flags: whole batches up to ``max_samples`` (SP6)
    and the first quarter of the batches (SP7)."""
    b = batches(spark, sf_dir).filter(F.col("split").isin(sp.VALID, sp.TEST))
    nb = b.groupBy("split").agg((F.max("batch_id") + 1).alias("n_batches"))
    return (b.join(nb, "split")
            .select("doc_id", "split", "batch_id",
                    sp.max_samples_cut(F.col("batch_id"), BATCH_SIZE, MAX_SAMPLES).alias("in_max_samples"),
                    sp.partial_eval(F.col("batch_id"), F.col("n_batches"), EVAL_SHARE)
                    .alias("in_partial_eval")))


RESUME_STEPS, RANGE = 1_234_567, 5


@register("SP11_resume", "SP11 SP8 SP9", sql=f"""
WITH {SQL_BATCHES},
nb AS (SELECT split, max(batch_id) + 1 AS n FROM batches GROUP BY 1)
SELECT doc_id, split, pos, batch_id FROM batches JOIN nb USING (split) WHERE split = 'train' AND batch_id >= {RESUME_STEPS} % n
""")
def sp11_resume(spark, sf_dir):
    """The shuffled epoch written in ranges of batches; a resume at a global step reads
    the ranges that are left and gives the tail of the epoch."""
    path = scratch_path(spark, "batches")
    sp.write_batches(batches(spark, sf_dir).select("doc_id", "split", "pos", "batch_id"), path, RANGE)
    return sp.resume_batches(spark, path, "train", RESUME_STEPS, RANGE).select("doc_id", "split", "pos", "batch_id")
