"""Training-log queries (M16e-M26e, SP11) over the eval log of ``events``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trellis.operators import runlog as rl
from trellis.plans.registry import register
from trellis.sources.derived import SQL_EVAL_LOG, eval_log_view
from trellis.sources.tables import Tables

PATIENCE = 3
SAVE_EVERY = 5
ACC_STEPS = 4
LR0 = 0.001
# The sweep's parameter choices. Dataset names of the evaluation matrix.
GRID = {"num_heads": [8, 16, 32], "num_quantizers": [5, 10, 20], "codebook_size": [64, 128, 256]}
EVAL_DATASETS = ["sentences", "webqsp", "simplequestions"]


def log_df(spark, sf_dir):
    return eval_log_view(Tables(spark, sf_dir))


@register("M16e_nonfinite_steps", "M16e", sql="""
WITH per AS (
  SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS step, event_type AS process,
         CASE WHEN min(value) = 0 THEN CAST('-inf' AS DOUBLE) ELSE ln(min(value)) END AS loss
  FROM events GROUP BY 1, 2
)
SELECT step, count(*) AS n_processes,
       bool_and(loss IS NOT NULL AND NOT isnan(loss) AND abs(loss) < CAST('inf' AS DOUBLE)) AS keep,
       round(avg(loss) FILTER (WHERE NOT isinf(loss)), 6) AS mean_finite_loss
FROM per GROUP BY 1
""")
def m16e_nonfinite_steps(spark, sf_dir):
    """Per step and process, loss = ln(min value) (-inf where a value is 0);
    a step is skipped when any process has a non-finite loss."""
    ev = Tables(spark, sf_dir).events
    step = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).cast("int")
    per = (ev.groupBy(step.alias("step"), F.col("event_type").alias("process"))
           .agg(F.min("value").alias("mv"))
           .withColumn("loss", F.when(F.col("mv") == 0, F.lit(float("-inf"))).otherwise(F.log("mv"))))
    keep = rl.nonfinite_steps(per)
    mean = per.groupBy("step").agg(F.round(F.avg(F.when(rl.finite("loss"), F.col("loss"))), 6)
                                   .alias("mean_finite_loss"))
    return keep.join(mean, "step")


@register("M17e_accumulated_loss", "M17e", sql=f"""
WITH {SQL_EVAL_LOG}
SELECT run, CAST(floor(step / {ACC_STEPS}) AS INTEGER) AS acc_step, round(sum(value), 6) / {ACC_STEPS} AS acc_loss
FROM eval_log GROUP BY 1, 2
""")
def m17e_accumulated_loss(spark, sf_dir):
    # the window sum is rounded before the exact division by a power of two
    a = rl.accumulate(log_df(spark, sf_dir), ACC_STEPS, ["run"], round_sum=6)
    return a.select("run", "acc_step", "acc_loss")


@register("M18e_best_and_patience", "M18e M19e M20e", sql=f"""
WITH {SQL_EVAL_LOG},
b AS (
  SELECT *, COALESCE(value < min(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS is_best,
         min(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best,
         max(step) OVER (PARTITION BY run) AS last_step
  FROM eval_log
),
g AS (SELECT *, sum(CAST(is_best AS INTEGER)) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM b),
c AS (SELECT *, CAST(row_number() OVER (PARTITION BY run, grp ORDER BY step) - 1 AS INTEGER) AS since_best FROM g)
SELECT run, step, value, is_best, since_best, best,
       is_best OR (step + 1) % {SAVE_EVERY} = 0 OR step = last_step OR since_best >= {PATIENCE} AS save,
       since_best > {PATIENCE} AS stop
FROM c
""")
def m18e_best_and_patience(spark, sf_dir):
    log = log_df(spark, sf_dir)
    b = rl.best_so_far(log, "min")
    last = F.max("step").over(Window.partitionBy("run"))
    d = rl.checkpoint_decision(b, PATIENCE, SAVE_EVERY, last)
    return d.select("run", "step", "value", "is_best", "since_best", "best", "save", "stop")


@register("M19e_early_stop", "M19e", sql=f"""
WITH {SQL_EVAL_LOG},
b AS (
  SELECT *, COALESCE(value < min(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS is_best
  FROM eval_log
),
g AS (SELECT *, sum(CAST(is_best AS INTEGER)) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM b),
c AS (SELECT *, row_number() OVER (PARTITION BY run, grp ORDER BY step) - 1 AS since_best FROM g)
SELECT run, min(step) FILTER (WHERE since_best > {PATIENCE}) AS stop_step, count(*) AS n_evals
FROM c GROUP BY run
""")
def m19e_early_stop(spark, sf_dir):
    """First evaluation at which the patience counter exceeds the patience."""
    b = rl.best_so_far(log_df(spark, sf_dir), "min")
    return b.groupBy("run").agg(
        F.min(F.when(F.col("since_best") > PATIENCE, F.col("step"))).alias("stop_step"),
        F.count(F.lit(1)).alias("n_evals"))


@register("M21e_ema", "M21e", sql=f"""
WITH {SQL_EVAL_LOG},
h AS (
  SELECT run, step, list(value ORDER BY step) OVER (PARTITION BY run ORDER BY step
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hist
  FROM eval_log
)
SELECT run, step, round(list_reduce(hist, lambda a, x: 0.7 * a + 0.3 * x), 6) AS ema FROM h
""")
def m21e_ema(spark, sf_dir):
    e = rl.ema(log_df(spark, sf_dir))
    return e.select("run", "step", F.round("ema", 6).alias("ema"))


@register("M22e_plateau_lr", "M22e", sql=f"""
WITH RECURSIVE {SQL_EVAL_LOG},
o AS (SELECT run, step, CAST(value AS DOUBLE) AS value, row_number() OVER (PARTITION BY run ORDER BY step) AS rn FROM eval_log),
r(run, rn, step, best, bad, lr) AS (
  SELECT run, rn, step,
         value, 0, CAST({LR0} AS DOUBLE)
  FROM o WHERE rn = 1
  UNION ALL
  SELECT o.run, o.rn, o.step,
         CASE WHEN o.value < r.best * (1 - 0.0001) THEN o.value ELSE r.best END,
         CASE WHEN o.value < r.best * (1 - 0.0001) THEN 0
              WHEN r.bad + 1 > {PATIENCE} THEN 0 ELSE r.bad + 1 END,
         CASE WHEN NOT (o.value < r.best * (1 - 0.0001)) AND r.bad + 1 > {PATIENCE} THEN r.lr * 0.5 ELSE r.lr END
  FROM r JOIN o ON o.run = r.run AND o.rn = r.rn + 1
)
SELECT run, CAST(step AS INTEGER) AS step, lr FROM r
""")
def m22e_plateau_lr(spark, sf_dir):
    return rl.plateau_schedule(log_df(spark, sf_dir), LR0, PATIENCE, "min")


_GRID_SQL = f"""
grid AS (
  SELECT h.num_heads, q.num_quantizers, c.codebook_size,
         CAST(row_number() OVER (ORDER BY h.num_heads, q.num_quantizers, c.codebook_size) - 1 AS BIGINT) AS trial_no
  FROM (SELECT unnest({GRID['num_heads']}) AS num_heads) h
  CROSS JOIN (SELECT unnest({GRID['num_quantizers']}) AS num_quantizers) q
  CROSS JOIN (SELECT unnest({GRID['codebook_size']}) AS codebook_size) c
),
res AS (
  SELECT CAST(user_id % 27 AS BIGINT) AS trial_no,
         CASE WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)
                   > sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) THEN NULL
              ELSE round(avg(value), 6) END AS value
  FROM events GROUP BY 1
),
trials AS (SELECT g.*, r.value FROM grid g LEFT JOIN res r USING (trial_no))"""


def trials_df(spark, sf_dir):
    """M24e grid (built by chained explode of the literal choice lists, no
    join) with one result per trial from ``events`` (trial = user_id mod 27;
    NULL = failed: more error than view events)."""
    ev = Tables(spark, sf_dir).events
    g = spark.range(1).select(F.explode(F.array(*map(F.lit, GRID["num_heads"]))).alias("num_heads"))
    g = g.select("*", F.explode(F.array(*map(F.lit, GRID["num_quantizers"]))).alias("num_quantizers"))
    g = g.select("*", F.explode(F.array(*map(F.lit, GRID["codebook_size"]))).alias("codebook_size"))
    n_q, n_c = len(GRID["num_quantizers"]), len(GRID["codebook_size"])
    idx = lambda name, v: F.array_position(F.array(*map(F.lit, GRID[name])), F.col(v)) - 1
    g = g.withColumn("trial_no", (idx("num_heads", "num_heads") * (n_q * n_c)
                                  + idx("num_quantizers", "num_quantizers") * n_c
                                  + idx("codebook_size", "codebook_size")).cast("bigint"))
    n_trials = len(GRID["num_heads"]) * n_q * n_c
    res = ev.groupBy(F.pmod("user_id", F.lit(n_trials)).cast("bigint").alias("trial_no")).agg(
        F.when(F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0))
               > F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)), F.lit(None))
        .otherwise(F.round(F.avg("value"), 6)).alias("value"))
    return g.join(res, "trial_no", "left")


@register("M24e_param_grid", "M24e", sql=f"""
WITH {_GRID_SQL}
SELECT num_heads, num_quantizers, codebook_size, trial_no, value FROM trials
""")
def m24e_param_grid(spark, sf_dir):
    return trials_df(spark, sf_dir).select("num_heads", "num_quantizers", "codebook_size",
                                           "trial_no", "value")


@register("M23e_best_trial", "M23e", sql=f"""
WITH {_GRID_SQL}
SELECT arg_min(num_heads, value) AS num_heads, arg_min(num_quantizers, value) AS num_quantizers,
       arg_min(codebook_size, value) AS codebook_size, min(value) AS best_value
FROM trials
""")
def m23e_best_trial(spark, sf_dir):
    return rl.best_trial(trials_df(spark, sf_dir), ["num_heads", "num_quantizers", "codebook_size"],
                         "value", "min")


@register("M25e_missing_eval_cells", "M25e", sql=f"""
WITH models AS (SELECT DISTINCT event_type AS model FROM events),
ds AS (SELECT unnest({EVAL_DATASETS}) AS dataset),
done AS (
  SELECT DISTINCT event_type AS model, {EVAL_DATASETS}[CAST(user_id % 3 AS INTEGER) + 1] AS dataset
  FROM events WHERE value > 300
)
SELECT m.model, d.dataset FROM models m CROSS JOIN ds d
WHERE NOT EXISTS (SELECT 1 FROM done x WHERE x.model = m.model AND x.dataset = d.dataset)
""")
def m25e_missing_eval_cells(spark, sf_dir):
    """Models (event types) x the evaluated datasets, minus the cells that
    already have a result (events above 300 count as finished runs)."""
    ev = Tables(spark, sf_dir).events
    ds = F.array(*map(F.lit, EVAL_DATASETS))
    matrix = ev.select(F.col("event_type").alias("model")).distinct() \
        .select("model", F.explode(ds).alias("dataset"))
    done = (ev.filter(F.col("value") > 300)
            .select(F.col("event_type").alias("model"),
                    F.element_at(ds, (F.pmod("user_id", F.lit(len(EVAL_DATASETS))) + 1).cast("int"))
                    .alias("dataset"))
            .distinct())
    return matrix.join(done, ["model", "dataset"], "left_anti")


@register("M26e_epoch_position", "M26e SP11", sql=f"""
WITH {SQL_EVAL_LOG},
n AS (SELECT run, count(*) AS n_batches FROM eval_log GROUP BY 1),
s AS (SELECT e.run, e.step, n.n_batches, greatest(1, CAST(floor(n.n_batches * 0.25 / 1) AS BIGINT)) AS steps_train
      FROM eval_log e JOIN n USING (run))
SELECT run, step, steps_train,
       CAST(n_batches // steps_train + CASE WHEN n_batches % steps_train <> 0 THEN 1 ELSE 0 END AS BIGINT) AS steps_per_epoch,
       CAST(step // (n_batches // steps_train + CASE WHEN n_batches % steps_train <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS epoch,
       CAST(step % (n_batches // steps_train + CASE WHEN n_batches % steps_train <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS step_in_epoch,
       CAST(step % n_batches AS BIGINT) AS resume_skip
FROM s
""")
def m26e_epoch_position(spark, sf_dir):
    """Each logged step placed in its epoch; the loader holds one batch per
    logged day and a train step takes a quarter of the loader."""
    log = log_df(spark, sf_dir)
    n = log.groupBy("run").agg(F.count(F.lit(1)).alias("n_batches"))
    cols = rl.epoch_position(F.col("step"), F.col("n_batches"), 0.25, 1)
    return log.join(n, "run").select("run", "step", *[c.alias(k) for k, c in cols.items()])
