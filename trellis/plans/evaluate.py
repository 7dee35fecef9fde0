"""Evaluation queries (M1e-M14e) over the logits view of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.operators import evaluate as ev
from trellis.plans.registry import register
from trellis.sources.derived import SQL_EVAL_LOG, SQL_LOGITS, eval_log_view, logits_view
from trellis.sources.tables import Tables

KG_TOKEN_ID = 0   # vocabulary id standing for the KG token in the logits view
N_QUANTIZERS = 20

SQL_RANKS = SQL_LOGITS + """,
seq AS (SELECT sample_id, count(*) AS seq_len FROM logits_v GROUP BY 1),
shifted AS (
  SELECT a.sample_id, a.pos, a.logits, a.obj_start, a.obj_end, b.true_id AS target_id, s.seq_len
  FROM logits_v a JOIN logits_v b ON a.sample_id = b.sample_id AND b.pos = a.pos + 1
  JOIN seq s ON s.sample_id = a.sample_id
),
masked AS (
  SELECT * FROM shifted
  WHERE obj_start IS NOT NULL AND obj_end IS NOT NULL AND pos >= greatest(0, obj_start - 1)
    AND pos < least(seq_len - 1, greatest(obj_start, obj_end - 1))
),
tok AS (
  SELECT sample_id, pos, target_id, logits,
         CAST(len(list_filter(logits, lambda x: NOT isnan(x) AND x > logits[target_id + 1])) + 1 AS INTEGER) AS tok_rank
  FROM masked
),
per AS (SELECT sample_id, max(tok_rank) AS rank FROM tok GROUP BY 1),
ranks AS (
  SELECT s.sample_id, s.question_id, s.batch_id, p.rank
  FROM (SELECT DISTINCT sample_id, question_id, batch_id FROM logits_v) s LEFT JOIN per p USING (sample_id)
)"""


def _hits_sql(src: str, by: str = "") -> str:
    sel = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    ks = (1, 3, 5, 10)
    hits = ", ".join(f"CAST(sum(CASE WHEN rank <= {k} THEN 1 ELSE 0 END) AS BIGINT) AS hits_{k}" for k in ks)
    return f"""SELECT {sel}n_objects, {", ".join(f"hits_{k}" for k in ks)},
       {", ".join(f"COALESCE(hits_{k} / CASE WHEN n_objects > 0 THEN n_objects END, 0.0) AS hit_at_{k}" for k in ks)}
FROM (SELECT {sel}count(rank) AS n_objects, {hits} FROM {src}{grp}) h"""


def ranks_df(spark, sf_dir):
    return ev.sequence_ranks(logits_view(Tables(spark, sf_dir)))


@register("M4e_sequence_ranks", "M1e M2e M3e M4e", sql=f"""
WITH {SQL_RANKS}
SELECT sample_id, question_id, rank FROM ranks
""")
def m4e_sequence_ranks(spark, sf_dir):
    return ranks_df(spark, sf_dir).select("sample_id", "question_id", "rank")


@register("M6e_hit_at_k", "M5e M6e M8e", sql=f"""
WITH {SQL_RANKS}
{_hits_sql("ranks")}
""")
def m6e_hit_at_k(spark, sf_dir):
    return ev.hit_counts(ranks_df(spark, sf_dir))


@register("M7e_question_hit_at_k", "M7e M9e", sql=f"""
WITH {SQL_RANKS},
qr AS (SELECT question_id, min(rank) AS rank, count(*) AS n_answers FROM ranks GROUP BY 1)
{_hits_sql("qr")}
""")
def m7e_question_hit_at_k(spark, sf_dir):
    return ev.hit_counts(ev.per_question_ranks(ranks_df(spark, sf_dir)))


@register("M10e_hit_consistency", "M10e", sql=f"""
WITH {SQL_RANKS},
kk AS (SELECT * FROM (VALUES (1), (3), (5), (10)) v(k)),
batch_hits AS (
  SELECT k, CAST(sum(h) AS BIGINT) AS batch_hits FROM (
    SELECT kk.k, r.batch_id, sum(CASE WHEN r.rank <= kk.k THEN 1 ELSE 0 END) AS h
    FROM ranks r CROSS JOIN kk GROUP BY 1, 2) b GROUP BY k
),
single_hits AS (
  SELECT kk.k, CAST(count(*) AS BIGINT) AS single_hits FROM ranks r JOIN kk ON r.rank <= kk.k GROUP BY 1
)
SELECT b.k, b.batch_hits, COALESCE(s.single_hits, 0) AS single_hits,
       b.batch_hits = COALESCE(s.single_hits, 0) AS consistent
FROM batch_hits b LEFT JOIN single_hits s USING (k)
""")
def m10e_hit_consistency(spark, sf_dir):
    """Hits summed from per-batch counts must equal hits recounted from the
    single ranks (the reference's run-time cross-check)."""
    r = ranks_df(spark, sf_dir)
    per_batch = ev.hit_counts(r, ["batch_id"])
    batch = per_batch.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"hits_{k}").alias("h")) for k in ev.HIT_KS])).alias("x")) \
        .groupBy(F.col("x.k").alias("k")).agg(F.sum("x.h").cast("bigint").alias("batch_hits"))
    single = (r.select("rank", F.explode(F.array(*[F.lit(k) for k in ev.HIT_KS])).alias("k"))
              .filter(F.col("rank") <= F.col("k"))
              .groupBy("k").agg(F.count(F.lit(1)).alias("single_hits")))
    return (batch.join(single, "k", "left")
            .select("k", "batch_hits", F.coalesce("single_hits", F.lit(0)).cast("bigint").alias("single_hits"))
            .withColumn("consistent", F.col("batch_hits") == F.col("single_hits")))


@register("M11e_average_tokens", "M11e T19", sql=f"""
WITH {SQL_RANKS},
cost AS (
  SELECT sample_id, CAST(sum(CASE WHEN true_id = {KG_TOKEN_ID} THEN 0 ELSE 1 END)
         + {N_QUANTIZERS} * sum(CASE WHEN true_id = {KG_TOKEN_ID} THEN 1 ELSE 0 END) AS BIGINT) AS tokens
  FROM logits_v GROUP BY 1
)
SELECT CAST(sum(c.tokens) AS BIGINT) AS total_tokens, count(*) AS n_samples,
       sum(c.tokens) / count(*) AS avg_tokens
FROM cost c JOIN ranks r USING (sample_id) WHERE r.rank IS NOT NULL
""")
def m11e_average_tokens(spark, sf_dir):
    """T19 token cost per sample (text tokens + KG tokens x Q), averaged over
    the samples that have an object (M11e)."""
    lv = logits_view(Tables(spark, sf_dir))
    is_kg = F.col("true_id") == KG_TOKEN_ID
    cost = lv.groupBy("sample_id").agg(
        (F.sum(F.when(is_kg, 0).otherwise(1)) + F.lit(N_QUANTIZERS) * F.sum(F.when(is_kg, 1).otherwise(0)))
        .cast("bigint").alias("tokens"))
    r = ev.sequence_ranks(lv).filter(F.col("rank").isNotNull())
    return cost.join(r, "sample_id").agg(
        F.sum("tokens").cast("bigint").alias("total_tokens"), F.count(F.lit(1)).alias("n_samples"),
        (F.sum("tokens") / F.count(F.lit(1))).alias("avg_tokens"))


SQL_LOSS = SQL_RANKS + """,
loss_log AS (
  SELECT r.question_id, t.sample_id,
         avg(list_max(t.logits) + ln(list_sum(list_transform(t.logits, lambda x: exp(CAST(x AS DOUBLE) - list_max(t.logits)))))
             - CAST(t.logits[t.target_id + 1] AS DOUBLE)) AS loss,
         count(*) AS n_valid
  FROM tok t JOIN ranks r USING (sample_id) GROUP BY 1, 2
)"""


def loss_log_df(spark, sf_dir):
    """``loss_log(question_id, sample_id, loss, n_valid)``: mean token
    cross-entropy over each sample's object positions."""
    lv = logits_view(Tables(spark, sf_dir))
    seq = lv.groupBy("sample_id").agg(F.count(F.lit(1)).alias("seq_len"))
    m = ev.object_mask(ev.causal_shift(lv).join(seq, "sample_id"))
    tok = m.withColumn("top", F.array_max("logits").cast("double"))
    tok = tok.withColumn("ce", ev.log_sum_exp("logits", "top")
                         - F.element_at("logits", F.col("target_id") + 1).cast("double"))
    return tok.groupBy("question_id", "sample_id").agg(F.avg("ce").alias("loss"),
                                                       F.count(F.lit(1)).alias("n_valid"))


@register("M12e_perplexity", "M12e", sql=f"""
WITH {SQL_LOSS},
qs AS (SELECT DISTINCT question_id FROM logits_v),
g AS (SELECT question_id, sum(loss * n_valid) AS ln_sum, CAST(sum(n_valid) AS BIGINT) AS n_tokens
      FROM loss_log GROUP BY 1)
SELECT qs.question_id, COALESCE(g.n_tokens, 0) AS n_tokens,
       CASE WHEN COALESCE(g.n_tokens, 0) > 0 THEN round(exp(g.ln_sum / g.n_tokens), 6)
            ELSE CAST('inf' AS DOUBLE) END AS perplexity
FROM qs LEFT JOIN g USING (question_id)
""")
def m12e_perplexity(spark, sf_dir):
    """Per question: exp of the token-weighted mean loss; infinity when a
    question has no object tokens."""
    lv = logits_view(Tables(spark, sf_dir))
    qs = lv.select("question_id").distinct()
    ll = loss_log_df(spark, sf_dir)
    p = ev.perplexity(ll, ["question_id"])
    return (qs.join(p, "question_id", "left")
            .select("question_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"),
                    F.when(F.coalesce("n_tokens", F.lit(0)) > 0, F.round("perplexity", 6))
                    .otherwise(F.lit(float("inf"))).alias("perplexity")))


@register("M13e_weighted_mean", "M13e", sql=f"""
WITH {SQL_EVAL_LOG}
SELECT run, metric, CAST(sum(weight) AS BIGINT) AS weight_sum,
       round(COALESCE(sum(value * weight) / CASE WHEN sum(weight) <> 0 THEN sum(weight) END, 0.0), 6) AS mean
FROM eval_log GROUP BY 1, 2
""")
def m13e_weighted_mean(spark, sf_dir):
    w = ev.weighted_mean(eval_log_view(Tables(spark, sf_dir)), ["run", "metric"])
    return w.select("run", "metric", F.col("weight_sum").cast("bigint").alias("weight_sum"),
                    F.round("mean", 6).alias("mean"))


@register("M14e_validation_hit_at_k", "M14e", sql=f"""
WITH {SQL_RANKS},
pb AS (
  SELECT batch_id, count(*) AS batch_size, count(rank) AS n_obj,
         {", ".join(f"sum(CASE WHEN rank <= {k} THEN 1 ELSE 0 END) AS h{k}" for k in (1, 3, 5, 10))}
  FROM ranks GROUP BY 1
)
SELECT CAST(sum(batch_size) AS BIGINT) AS n_samples,
       {", ".join(f"round(sum(COALESCE(h{k} / CASE WHEN n_obj > 0 THEN n_obj END, 0.0) * batch_size) / sum(batch_size), 9) AS val_hit_at_{k}" for k in (1, 3, 5, 10))}
FROM pb
""")
def m14e_validation_hit_at_k(spark, sf_dir):
    r = ev.batch_weighted_hits(ranks_df(spark, sf_dir))
    return r.select(F.col("n_samples").cast("bigint").alias("n_samples"),
                    *[F.round(f"val_hit_at_{k}", 9).alias(f"val_hit_at_{k}") for k in ev.HIT_KS])


ALIGN_ROWS, ALIGN_CODES, ALIGN_KG = 10, 3, (0, 5)


@register("T18_aligned_logits", "T18 M1e M3e", sql=f"""
WITH lg AS (
  SELECT CAST(vec_id // {ALIGN_ROWS} AS BIGINT) AS sample_id, CAST(vec_id % {ALIGN_ROWS} AS BIGINT) AS pos, label,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
  FROM embeddings
),
lab AS (SELECT sample_id, pos AS label_pos, label IN {ALIGN_KG} AS is_kg, CAST(label AS INTEGER) AS true_id
        FROM lg WHERE pos < 5 + sample_id % 6),
n AS (SELECT sample_id, count(*) AS n_log FROM lg GROUP BY 1),
wd AS (
  SELECT *, CASE WHEN is_kg AND n_log <> count(*) OVER (PARTITION BY sample_id) THEN {ALIGN_CODES} ELSE 1 END AS w
  FROM lab JOIN n USING (sample_id)
),
st AS (SELECT *, COALESCE(sum(w) OVER (PARTITION BY sample_id ORDER BY label_pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM wd),
rg AS (
  SELECT *, CASE WHEN s < n_log THEN s ELSE max(s) FILTER (WHERE s < n_log) OVER (PARTITION BY sample_id) END AS f,
         CASE WHEN s < n_log THEN least(s + w, n_log)
              ELSE max(least(s + w, n_log)) FILTER (WHERE s < n_log) OVER (PARTITION BY sample_id) END AS e
  FROM st
),
bl AS (
  SELECT r.sample_id, r.label_pos, r.is_kg, r.true_id, count(*) AS n_rows,
         list_reduce(list(l.v ORDER BY l.pos), lambda a, b: list_transform(range(len(a)), lambda i: a[i + 1] + b[i + 1])) AS total
  FROM rg r JOIN lg l ON l.sample_id = r.sample_id AND l.pos >= r.f AND l.pos < r.e GROUP BY 1, 2, 3, 4
),
al AS (SELECT *, list_transform(total, lambda x: x / n_rows) AS logits FROM bl)
SELECT a.sample_id, a.label_pos, a.is_kg, CAST(a.n_rows AS INTEGER) AS n_rows, round(list_sum(a.logits), 6) AS logit_sum,
       CASE WHEN b.true_id IS NOT NULL THEN
         CAST(len(list_filter(a.logits, lambda x: x > a.logits[b.true_id + 1])) + 1 AS INTEGER) END AS next_rank
FROM al a LEFT JOIN al b ON b.sample_id = a.sample_id AND b.label_pos = a.label_pos + 1
""")
def t18_aligned_logits(spark, sf_dir):
    """Runs of ten ``embeddings`` rows as the logits of label sequences of 5
    to 10 tokens with any number of KG tokens (labels 0 and 5): blocks are
    averaged, ragged tails repeat the last row (T18); the next label is then
    ranked in each aligned row (M1e, M3e)."""
    lg = Tables(spark, sf_dir).embeddings.select(
        F.expr(f"vec_id div {ALIGN_ROWS}").alias("sample_id"),
        F.pmod("vec_id", F.lit(ALIGN_ROWS)).cast("bigint").alias("pos"),
        F.col("embedding").alias("logits"), F.col("label").cast("int").alias("true_id"))
    labels = lg.where(F.col("pos") < 5 + F.pmod("sample_id", F.lit(6))).select(
        "sample_id", F.col("pos").alias("label_pos"), F.col("true_id").isin(*ALIGN_KG).alias("is_kg"), "true_id")
    a = ev.align_logits(labels, lg.select("sample_id", "pos", "logits"), ALIGN_CODES)
    shifted = ev.causal_shift(a.select("sample_id", F.col("label_pos").alias("pos"), "logits", "true_id"))
    ranks = shifted.select("sample_id", F.col("pos").alias("label_pos"), ev.token_rank().alias("next_rank"))
    total = F.aggregate("logits", F.lit(0.0), lambda s, x: s + x)
    return a.join(ranks, ["sample_id", "label_pos"], "left").select(
        "sample_id", "label_pos", "is_kg", "n_rows", F.round(total, 6).alias("logit_sum"), "next_rank")
