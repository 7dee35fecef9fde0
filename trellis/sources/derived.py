"""Reference-shaped inputs derived from the driver tables (FIXTURES §B).

Each view has a Spark form and a DuckDB SQL twin (a CTE body) so oracle
queries can start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.sources.tables import Tables

# Fixed layout of the logits view: 4 positions per sample, 5 samples per
# question, 8 samples per evaluation batch.
POSITIONS = 4
SAMPLES_PER_QUESTION = 5
BATCH = 8


def logits_view(t: Tables) -> DataFrame:
    """``logits(sample_id, question_id, batch_id, pos, logits, true_id,
    obj_start, obj_end)`` from ``embeddings``: the 64 floats are one logits
    row over a 64-token vocabulary, ``label`` is the true token id."""
    e = t.embeddings
    sample = F.expr(f"vec_id div {POSITIONS}")
    no_obj = F.pmod(sample, F.lit(7)) == 6
    start = (F.lit(1) + F.pmod(sample, F.lit(2))).cast("int")
    return e.select(
        sample.cast("bigint").alias("sample_id"),
        F.expr(f"vec_id div {POSITIONS * SAMPLES_PER_QUESTION}").cast("bigint").alias("question_id"),
        F.expr(f"vec_id div {POSITIONS * BATCH}").cast("bigint").alias("batch_id"),
        F.pmod("vec_id", F.lit(POSITIONS)).cast("int").alias("pos"),
        F.col("embedding").alias("logits"),
        F.col("label").cast("int").alias("true_id"),
        F.when(no_obj, F.lit(None)).otherwise(start).cast("int").alias("obj_start"),
        F.when(no_obj, F.lit(None)).otherwise(start + F.pmod(sample, F.lit(3))).cast("int")
        .alias("obj_end"))


SQL_LOGITS = f"""
logits_v AS (
  SELECT CAST(vec_id // {POSITIONS} AS BIGINT) AS sample_id,
         CAST(vec_id // {POSITIONS * SAMPLES_PER_QUESTION} AS BIGINT) AS question_id,
         CAST(vec_id // {POSITIONS * BATCH} AS BIGINT) AS batch_id,
         CAST(vec_id % {POSITIONS} AS INTEGER) AS pos, embedding AS logits,
         CAST(label AS INTEGER) AS true_id,
         CASE WHEN (vec_id // {POSITIONS}) % 7 = 6 THEN NULL
              ELSE CAST(1 + (vec_id // {POSITIONS}) % 2 AS INTEGER) END AS obj_start,
         CASE WHEN (vec_id // {POSITIONS}) % 7 = 6 THEN NULL
              ELSE CAST(1 + (vec_id // {POSITIONS}) % 2 + (vec_id // {POSITIONS}) % 3 AS INTEGER) END AS obj_end
  FROM embeddings
)"""


def eval_log_view(t: Tables) -> DataFrame:
    """``eval_log(run, step, metric, value, weight)`` from ``events``:
    run = event_type, step = day number, value = avg(value), weight = count."""
    ev = t.events
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).cast("int")
    return (ev.groupBy(F.col("event_type").alias("run"), day.alias("step"))
            .agg(F.round(F.avg("value"), 6).alias("value"), F.count(F.lit(1)).alias("weight"))
            .select("run", "step", F.lit("metric").alias("metric"), "value", "weight"))


SQL_EVAL_LOG = """
eval_log AS (
  SELECT event_type AS run, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS step,
         'metric' AS metric, round(avg(value), 6) AS value, count(*) AS weight
  FROM events GROUP BY 1, 2
)"""


def sentence_samples(t: Tables) -> DataFrame:
    """Sentence samples (aligned-sentence corpus form), one per ``placed`` triple (customer ->
    order): ``sentence = "<customer> placed Order <n>."`` with subject and
    object character boundaries; QA twin: ``question``/``answer``."""
    o, c = t.orders, t.customer
    from trellis.sources.kg_view import qid

    j = o.join(c, o.o_custkey == c.c_custkey)
    obj_label = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))
    obj_start = F.length("c_name") + F.lit(len(" placed "))
    return j.select(
        F.col("o_orderkey").cast("bigint").alias("sample_id"),
        qid("customer", "c_custkey").alias("subject_id"), F.col("c_name").alias("subject_label"),
        F.lit("P4").alias("predicate_id"), F.lit("placed").alias("predicate_label"),
        qid("order", "o_orderkey").alias("object_id"), obj_label.alias("object_label"),
        F.concat(F.col("c_name"), F.lit(" placed "), obj_label, F.lit(".")).alias("sentence"),
        F.lit(0).alias("subj_start"), F.length("c_name").cast("int").alias("subj_end"),
        obj_start.cast("int").alias("obj_start"),
        (obj_start + F.length(obj_label)).cast("int").alias("obj_end"),
        F.concat(F.lit("What did "), F.col("c_name"), F.lit(" place?")).alias("question"),
        obj_label.alias("answer"))


SQL_SAMPLES = """
samples AS (
  SELECT CAST(o.o_orderkey AS BIGINT) AS sample_id,
         'Q' || CAST(CAST(c.c_custkey AS BIGINT) + 300000000 AS VARCHAR) AS subject_id, c.c_name AS subject_label,
         'P4' AS predicate_id, 'placed' AS predicate_label,
         'Q' || CAST(CAST(o.o_orderkey AS BIGINT) + 600000000 AS VARCHAR) AS object_id,
         'Order ' || CAST(o.o_orderkey AS VARCHAR) AS object_label,
         c.c_name || ' placed Order ' || CAST(o.o_orderkey AS VARCHAR) || '.' AS sentence,
         0 AS subj_start, CAST(length(c.c_name) AS INTEGER) AS subj_end,
         CAST(length(c.c_name) + 8 AS INTEGER) AS obj_start,
         CAST(length(c.c_name) + 8 + length('Order ' || CAST(o.o_orderkey AS VARCHAR)) AS INTEGER) AS obj_end,
         'What did ' || c.c_name || ' place?' AS question,
         'Order ' || CAST(o.o_orderkey AS VARCHAR) AS answer
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
)"""
