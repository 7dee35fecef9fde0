"""Training-log analytics (M16e-M26e) over ``eval_log(run, step, value)``.

Running minima and counters are window expressions partitioned by run;
recurrences that no window expresses stream through sorted partitions, or
run as a prefix scan over blocks where their steps compose.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.session import materialize

# Fixed values of the reference's schedules.
EMA_OLD, EMA_NEW = 0.7, 0.3
# Rows of a block of the moving average's prefix scan.
EMA_BLOCK = 1 << 16
PLATEAU_FACTOR = 0.5
PLATEAU_THRESHOLD = 1e-4


def finite(c) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def nonfinite_steps(loss: DataFrame) -> DataFrame:
    """M16e: ``loss(step, process, loss)``; a step is kept only if the loss of
    every process is finite."""
    return loss.groupBy("step").agg(
        F.count(F.lit(1)).alias("n_processes"),
        F.bool_and(finite("loss")).alias("keep"))


def accumulate(log: DataFrame, acc_steps: int, by: list[str],
               round_sum: int | None = None) -> DataFrame:
    """M17e: sum of losses per accumulation window divided by its size
    (optionally rounding the sum, which makes results order-independent)."""
    total = F.sum("value")
    if round_sum is not None:
        total = F.round(total, round_sum)
    return (log.groupBy(*by, F.floor(F.col("step") / acc_steps).cast("int").alias("acc_step"))
            .agg((total / F.lit(acc_steps)).alias("acc_loss")))


def best_so_far(log: DataFrame, mode: str = "min", part: str = "run") -> DataFrame:
    """M18e + M19e: strict improvement against every earlier value; the
    patience counter is the number of evaluations since the last best
    (island grouping on the running count of bests)."""
    if mode not in ("min", "max"):
        raise ValueError("mode must be min or max")
    w_prev = Window.partitionBy(part).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    w_cum = Window.partitionBy(part).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    prev = (F.min if mode == "min" else F.max)("value").over(w_prev)
    better = (F.col("value") < F.col("prev_best")) if mode == "min" else (F.col("value") > F.col("prev_best"))
    # the reference starts from +inf (min) / -inf (max): the first value is a best
    out = (log.withColumn("prev_best", prev)
           .withColumn("is_best", F.coalesce(better, F.lit(True)))
           .withColumn("_grp", F.sum(F.col("is_best").cast("int")).over(w_cum)))
    w_isl = Window.partitionBy(part, "_grp").orderBy("step")
    return (out.withColumn("since_best", (F.row_number().over(w_isl) - 1).cast("int"))
            .withColumn("best", (F.min if mode == "min" else F.max)("value").over(w_cum))
            .drop("_grp", "prev_best"))


def checkpoint_decision(log: DataFrame, patience: int, every: int, last_step: Column) -> DataFrame:
    """M20e: save when best, every ``every`` evaluations, at the last step, or
    when the patience is used up; M19e stop flag = counter > patience."""
    return (log.withColumn("save", F.col("is_best")
                           | (F.pmod(F.col("step") + 1, F.lit(every)) == 0)
                           | (F.col("step") == last_step)
                           | (F.col("since_best") >= patience))
            .withColumn("stop", F.col("since_best") > patience))


def _fold_runs(log: DataFrame, part: str, value: str, out: str, start, advance) -> DataFrame:
    """``out`` = a recurrence over each run's values in step order.

    Runs are shuffled to partitions, sorted there, and streamed through in
    Arrow batches; only the state of the current run is held, so a run of any
    length needs constant memory. ``start()`` gives a fresh state and
    ``advance(state, x)`` the next state with the output as its first item.
    """
    data = log.repartition(part).sortWithinPartitions(part, "step")
    schema = T.StructType([f for f in log.schema.fields if f.name != out]
                          + [T.StructField(out, T.DoubleType())])
    names = schema.fieldNames()

    def run(batches):
        current, state = None, None
        fresh = True
        for pdf in batches:
            res = []
            for key, x in zip(pdf[part].tolist(), pdf[value].tolist()):
                if fresh or key != current:
                    current, state, fresh = key, start(), False
                state = advance(state, x)
                res.append(state[0])
            yield pdf.assign(**{out: pd.Series(res, index=pdf.index, dtype="float64")})[names]

    return data.mapInPandas(run, schema)


def ema(log: DataFrame, part: str = "run", value: str = "value", block: int = EMA_BLOCK) -> DataFrame:
    """M21e: ``ema = 0.7*ema + 0.3*x`` seeded by the first value; an infinite
    or NaN value stays in the average for the rest of its run.

    A parallel prefix scan: rows are sorted by run and step and cut into blocks. A
    block is an affine map of the average before it; the maps of a run are composed (a
    row a block), then the blocks run apart, each from its own start. Any run, however
    long, is spread over all tasks. Rows of equal run and step go in no fixed order."""
    rows = materialize(log.repartitionByRange(part, "step").sortWithinPartitions(part, "step")
                       .withColumn("_place", F.monotonically_increasing_id())
                       .withColumn("_block", F.floor(F.col("_place") / block).cast("long")))
    kind = dict(log.dtypes)[part]
    dealt = rows.select(part, "_block", "_place", F.col(value).cast("double").alias("_x")).repartition("_block")

    def pieces(batches, columns):
        """Runs of rows of one block and run, over batches in place order."""
        key, held = None, []
        for pdf in batches:
            same = (pdf["_block"].ne(pdf["_block"].shift()) | ~(pdf[part].eq(pdf[part].shift()) | (pdf[part].isna() & pdf[part].shift().isna()))).cumsum()
            for _, piece in pdf.groupby(same.to_numpy(), sort=False):
                at = (piece["_block"].iloc[0], _plain(piece[part].iloc[0]))
                if held and at != key:
                    yield pd.concat(held, ignore_index=True)
                    held = []
                key = at
                held.append(piece[columns])
        if held:
            yield pd.concat(held, ignore_index=True)

    def summed(batches):
        for piece in pieces(batches, [part, "_block", "_place", "_x"]):
            xs = piece["_x"].tolist()
            # the smallest factor is no zero: an infinite start stays infinite
            factor, shift, seeded = max(EMA_OLD ** len(xs), 5e-324), 0.0, None
            for x in xs:
                shift = EMA_OLD * shift + EMA_NEW * x
                seeded = x if seeded is None else EMA_OLD * seeded + EMA_NEW * x
            yield piece.iloc[:1][[part, "_block"]].assign(factor=factor, shift=shift, seeded=seeded)

    maps = dealt.sortWithinPartitions("_place").mapInPandas(
        summed, f"`{part}` {kind}, _block long, factor double, shift double, seeded double")

    def composed(batches):
        key, last, fresh = None, None, True
        for pdf in batches:
            starts = []
            for run, factor, shift, seeded in zip(pdf[part].tolist(), pdf["factor"], pdf["shift"], pdf["seeded"]):
                if fresh or _plain(run) != key:
                    key, last, fresh = _plain(run), None, False
                starts.append(last)
                last = seeded if last is None else factor * last + shift
            yield pdf[[part, "_block"]].assign(first=[s is None for s in starts], start=[float("nan") if s is None else s for s in starts])

    starts = maps.repartition(part).sortWithinPartitions(part, "_block").mapInPandas(
        composed, f"`{part}` {kind}, _block long, first boolean, start double")
    starts = starts.select(F.col(part).alias("_run"), F.col("_block").alias("_b"), "first", "start")
    ready = (dealt.join(starts, (F.col("_block") == F.col("_b")) & F.col(part).eqNullSafe(F.col("_run")))
             .select(part, "_block", "_place", "_x", "first", "start").repartition("_block").sortWithinPartitions("_place"))

    def averaged(batches):
        for piece in pieces(batches, ["_block", "_place", "_x", "first", "start"]):
            now, out = None if piece["first"].iloc[0] else piece["start"].iloc[0], []
            for x in piece["_x"].tolist():
                now = x if now is None else EMA_OLD * now + EMA_NEW * x
                out.append(now)
            yield pd.DataFrame({"_p": piece["_place"], "_ema": pd.Series(out, dtype="float64")})

    names = [c for c in log.columns if c != "ema"]
    done = ready.mapInPandas(averaged, "_p long, _ema double")
    return rows.drop("ema").join(done, F.col("_place") == F.col("_p")).select(
        *names, F.coalesce("_ema", F.lit(float("nan"))).alias("ema"))  # pandas hands NaN on as null


def _plain(key):
    """A run's key that equals itself, null included."""
    return None if pd.isna(key) else key


def plateau_schedule(log: DataFrame, lr0: float, patience: int, mode: str = "min",
                     part: str = "run") -> DataFrame:
    """M22e: learning rate after each evaluation under reduce-on-plateau
    (relative threshold 1e-4, factor 0.5, counter restarts after a cut)."""
    if mode not in ("min", "max"):
        raise ValueError("mode must be min or max")
    best0 = float("inf") if mode == "min" else float("-inf")

    def advance(state, x):
        lr, best, bad = state
        better = x < best * (1.0 - PLATEAU_THRESHOLD) if mode == "min" else x > best * (1.0 + PLATEAU_THRESHOLD)
        if better:
            return lr, x, 0
        return (lr * PLATEAU_FACTOR, best, 0) if bad + 1 > patience else (lr, best, bad + 1)

    lrs = _fold_runs(log, part, "value", "lr", lambda: (float(lr0), best0, 0), advance)
    return lrs.select(part, "step", "lr")


def best_trial(trials: DataFrame, params: list[str], metric: str = "value",
               mode: str = "min") -> DataFrame:
    """M23e: arg-min/arg-max of a metric over trials; failed trials (NULL
    metric) never win."""
    pick = F.min_by if mode == "min" else F.max_by
    agg = (F.min if mode == "min" else F.max)(metric)
    return trials.agg(pick(F.struct(*params), metric).alias("p"), agg.alias("best_value")) \
        .select(*[F.col(f"p.{c}").alias(c) for c in params], "best_value")


def epoch_position(step: Column, n_batches: Column, steps_train, n_processes: int = 1
                   ) -> dict[str, Column]:
    """M26e + SP11: batches per train step (a float ``steps_train`` is a share
    of the loader: ``int(n * share / processes)``, at least 1), steps per
    epoch = ceil(n / steps_train), epoch = step div spe, and the resume offset
    ``global_step % n_batches``; NULL positions in an empty loader."""
    if isinstance(steps_train, float):
        st = F.floor(n_batches * F.lit(steps_train) / F.lit(n_processes)).cast("bigint")
    else:
        st = F.lit(int(steps_train)).cast("bigint")
    st = F.greatest(st, F.lit(1).cast("bigint"))
    loaded = F.when(n_batches > 0, n_batches)
    spe = F.ceil(loaded / st).cast("bigint")
    return {
        "steps_train": st,
        "steps_per_epoch": spe,
        "epoch": F.floor(step / spe).cast("bigint"),
        "step_in_epoch": F.pmod(step, spe).cast("bigint"),
        "resume_skip": F.pmod(step, loaded).cast("bigint"),
    }
