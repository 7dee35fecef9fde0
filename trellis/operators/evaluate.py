"""Evaluation metrics over logits / rank tables (M1e-M15e).

Input ``logits(sample_id, question_id, pos, logits ARRAY<FLOAT>, true_id,
obj_start, obj_end)``. Everything is a partial + final aggregate, so the
per-process gathers of the reference become ordinary shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions.text import col_

HIT_KS = (1, 3, 5, 10)


def align_logits(labels: DataFrame, logits: DataFrame, n_codes: int) -> DataFrame:
    """One logits row per label position; the inverse of the KG splice.

    ``labels(sample_id, label_pos, is_kg, ...)`` with positions 0, 1, ...;
    ``logits(sample_id, pos, logits)``. A KG position takes the mean of its
    ``n_codes`` rows (fewer at the end of the sequence); positions beyond the
    last row repeat the last aligned row; samples whose two lengths agree are
    aligned already. A sample without logits yields no row. Adds ``logits``
    (doubles) and ``n_rows``, the rows averaged.
    """
    n_log = logits.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n_log"))
    whole = Window.partitionBy("sample_id")
    before = whole.orderBy("label_pos").rowsBetween(Window.unboundedPreceding, -1)
    spliced = F.col("_n_log") != F.count(F.lit(1)).over(whole)
    d = labels.join(n_log, "sample_id").withColumn(
        "_width", F.when(spliced & F.col("is_kg"), n_codes).otherwise(1))
    d = d.withColumn("_from", F.coalesce(F.sum("_width").over(before), F.lit(0)))
    inside = F.col("_from") < F.col("_n_log")
    d = d.withColumn("_to", F.least(F.col("_from") + F.col("_width"), "_n_log"))
    last = {c: F.max(F.when(inside, F.col(c))).over(whole) for c in ("_from", "_to")}
    d = d.select(*labels.columns, *[F.when(inside, F.col(c)).otherwise(v).alias(c) for c, v in last.items()])
    rows = d.select("sample_id", "label_pos", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)).alias("pos")) \
        .join(logits.select("sample_id", F.col("pos").cast("bigint").alias("pos"),
                            F.transform("logits", lambda x: x.cast("double")).alias("_v")), ["sample_id", "pos"])
    # at most n_codes rows meet in a block
    block = rows.groupBy("sample_id", "label_pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "_v"))), lambda r: r["_v"]).alias("_b"))
    total = F.aggregate(F.slice("_b", 2, n_codes), F.element_at("_b", 1),
                        lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    block = block.select("sample_id", "label_pos", F.size("_b").alias("n_rows"), total.alias("_sum"))
    block = block.select("sample_id", "label_pos", "n_rows",
                         F.transform("_sum", lambda x: x / F.col("n_rows")).alias("logits"))
    return labels.join(block, ["sample_id", "label_pos"])


def causal_shift(logits: DataFrame) -> DataFrame:
    """M1e: logits at ``pos`` are scored against the label at ``pos + 1``;
    the last position has no target and is dropped. A self-join on
    (sample, pos) keeps this a co-partitioned equi-join (no per-sample
    window over a possibly huge sequence)."""
    nxt = logits.select("sample_id", (F.col("pos") - 1).alias("pos"),
                        F.col("true_id").alias("target_id"))
    return logits.drop("true_id").join(nxt, ["sample_id", "pos"])


def object_mask(shifted: DataFrame, seq_len: str = "seq_len") -> DataFrame:
    """M2e: keep positions in ``[max(0, start-1), min(L-1, max(start, end-1)))``;
    ``start == end`` still keeps one position, NULL bounds keep none."""
    s = F.greatest(F.lit(0), F.col("obj_start") - 1)
    e = F.least(F.col(seq_len) - 1, F.greatest(F.col("obj_start"), F.col("obj_end") - 1))
    return shifted.filter(F.col("obj_start").isNotNull() & F.col("obj_end").isNotNull()
                          & (F.col("pos") >= s) & (F.col("pos") < e))


def token_rank(logits_col: str = "logits", target_col: str = "target_id") -> F.Column:
    """M3e: ``1 + #(logit > logit[target])``; strict, so ties share the best
    rank. NaN logits are ignored (Spark orders NaN above every number)."""
    tgt = F.element_at(F.col(logits_col), F.col(target_col) + 1)
    return (F.size(F.filter(F.col(logits_col), lambda x: ~F.isnan(x) & (x > tgt))) + 1).cast("int")


def sequence_ranks(logits: DataFrame) -> DataFrame:
    """M4e: per sample, the worst (max) token rank over the object positions.
    Samples without object positions get rank NULL (= infinity)."""
    seq = logits.groupBy("sample_id").agg(F.count(F.lit(1)).alias("seq_len"))
    shifted = causal_shift(logits).join(seq, "sample_id")
    ranked = object_mask(shifted).withColumn("tok_rank", token_rank())
    per = ranked.groupBy("sample_id").agg(F.max("tok_rank").alias("rank"))
    extra = [c for c in ("question_id", "batch_id") if c in logits.columns]
    samples = logits.select("sample_id", *extra).distinct()
    return samples.join(per, "sample_id", "left")


def hit_counts(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """M5e + M6e: hits for k in {1,3,5,10}, objects, and the ratios
    (0.0 when there are no objects)."""
    aggs = [F.count("rank").alias("n_objects")]
    aggs += [F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).cast("bigint").alias(f"hits_{k}")
             for k in HIT_KS]
    g = ranks.groupBy(*(by or [])).agg(*aggs)
    for k in HIT_KS:
        g = g.withColumn(f"hit_at_{k}", F.coalesce(
            F.col(f"hits_{k}") / F.when(F.col("n_objects") > 0, F.col("n_objects")), F.lit(0.0)))
    return g


def per_question_ranks(ranks: DataFrame) -> DataFrame:
    """M7e first level (and M9e): best rank over each question's answers."""
    return ranks.groupBy("question_id").agg(F.min("rank").alias("rank"),
                                            F.count(F.lit(1)).alias("n_answers"))


def perplexity(loss_log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """M12e: ``exp(sum(loss*n)/sum(n))``; infinity when no token counts."""
    g = loss_log.groupBy(*(by or [])).agg(
        F.sum(F.col("loss") * F.col("n_valid")).alias("_ln"), F.sum("n_valid").alias("n_tokens"))
    return g.select(*(by or []), "n_tokens",
                    F.when(F.col("n_tokens") > 0, F.exp(F.col("_ln") / F.col("n_tokens")))
                    .otherwise(F.lit(float("inf"))).alias("perplexity"))


def weighted_mean(log: DataFrame, by: list[str], value: str = "value",
                  weight: str = "weight") -> DataFrame:
    """M13e: ``sum(v*w) / sum(w)`` per key, 0.0 when the weight sum is 0."""
    g = log.groupBy(*by).agg(F.sum(F.col(value) * F.col(weight)).alias("_vw"),
                             F.sum(weight).alias("weight_sum"))
    return g.select(*by, "weight_sum", F.coalesce(
        F.col("_vw") / F.when(F.col("weight_sum") != 0, F.col("weight_sum")), F.lit(0.0))
        .alias("mean"))


def batch_weighted_hits(ranks: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """M14e: mean of per-batch hit ratios weighted by batch size; differs
    from the pooled ratio of M6e."""
    bsize = ranks.groupBy(batch_col).agg(F.count(F.lit(1)).alias("batch_size"))
    per = hit_counts(ranks, [batch_col]).join(bsize, batch_col)
    aggs = [F.sum("batch_size").alias("n_samples")]
    aggs += [(F.sum(F.col(f"hit_at_{k}") * F.col("batch_size")) / F.sum("batch_size"))
             .alias(f"val_hit_at_{k}") for k in HIT_KS]
    return per.agg(*aggs)


def log_sum_exp(logits, top) -> Column:
    """Log of the summed exponentials, shifted by the row's maximum ``top``."""
    shifted = F.transform(col_(logits), lambda x: F.exp(x.cast("double") - col_(top)))
    return col_(top) + F.log(F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))
