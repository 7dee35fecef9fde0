"""M2e-M7e, M12e, M18e/M19e, M21e on the hand-made cases of FIXTURES §C."""

import math
import random

from pyspark.sql import functions as F

from trellis.operators import evaluate as ev
from trellis.operators import runlog as rl


def test_object_mask_start_equals_end(spark):
    df = spark.createDataFrame([(p, 3, 3, 10) for p in range(10)],
                               "pos int, obj_start int, obj_end int, seq_len int")
    assert [r["pos"] for r in ev.object_mask(df).collect()] == [2]


def test_token_rank_ties_share_best(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0], 1)], "logits array<float>, target_id int")
    assert df.select(ev.token_rank()).first()[0] == 1


def test_question_hits(spark):
    r = spark.createDataFrame([(1, 7), (1, 2)], "question_id int, rank int")
    h = ev.hit_counts(ev.per_question_ranks(r)).first()
    assert h["hits_3"] == 1 and h["hits_1"] == 0


def test_perplexity(spark):
    ll = spark.createDataFrame([("a", 1.0, 2), ("a", 2.0, 2), ("b", 1.0, 0)], "v string, loss double, n_valid long")
    out = {r["v"]: r["perplexity"] for r in ev.perplexity(ll, ["v"]).collect()}
    assert abs(out["a"] - math.exp(1.5)) < 1e-12 and math.isinf(out["b"])


def test_best_and_patience(spark):
    log = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate([5.0, 4.0, 4.0, 4.0, 4.0])],
                                "run string, step int, value double")
    rows = rl.best_so_far(log, "min").orderBy("step").collect()
    assert [r["is_best"] for r in rows] == [True, True, False, False, False]
    assert [r["since_best"] for r in rows] == [0, 0, 1, 2, 3]
    assert [r["since_best"] > 2 for r in rows].index(True) + 1 == 5


def test_ema(spark):
    log = spark.createDataFrame([("r", 1, 10.0), ("r", 2, 20.0), ("r", 3, 10.0)], "run string, step int, value double")
    got = [round(r["ema"], 9) for r in rl.ema(log).orderBy("step").collect()]
    assert got == [10.0, 13.0, 12.1]


def test_plateau_schedule(spark):
    vals = [5.0, 4.0, 4.0, 4.0, 4.0, 4.0, 3.0]
    log = spark.createDataFrame([("r", i, v) for i, v in enumerate(vals)], "run string, step int, value double")
    lrs = [r["lr"] for r in rl.plateau_schedule(log, 1.0, 2).orderBy("step").collect()]
    assert lrs == [1.0, 1.0, 1.0, 1.0, 0.5, 0.5, 0.5]


def test_ema_keeps_infinity(spark):
    log = spark.createDataFrame([("r", i, math.inf if i == 0 else 1.0) for i in range(300)]
                                + [("s", i, 2.0) for i in range(300)], "run string, step int, value double")
    rows = {(r["run"], r["step"]): r["ema"] for r in rl.ema(log).collect()}
    assert math.isinf(rows["r", 299]) and abs(rows["s", 299] - 2.0) < 1e-9


def test_plateau_schedule_over_many_batches(spark):
    n = 25_000  # three Arrow batches
    log = spark.createDataFrame([("r", i, 1.0) for i in range(n)], "run string, step int, value double")
    lrs = [r["lr"] for r in rl.plateau_schedule(log, 1.0, 9_999).orderBy("step").collect()]
    assert lrs[9_999] == 1.0 and lrs[10_000] == 0.5 and lrs[20_000] == 0.25 and lrs[-1] == 0.25


def test_epoch_position_of_short_loaders(spark):
    df = spark.createDataFrame([(5, 3), (0, 0)], "step int, n long")
    cols = rl.epoch_position(F.col("step"), F.col("n"), 0.25, 1)
    short, empty = df.select(*[c.alias(k) for k, c in cols.items()]).collect()
    assert short.asDict() == {"steps_train": 1, "steps_per_epoch": 3, "epoch": 1, "step_in_epoch": 2, "resume_skip": 2}
    assert empty["steps_train"] == 1 and empty["epoch"] is None and empty["resume_skip"] is None


def test_log_sum_exp_of_large_logits(spark):
    df = spark.createDataFrame([([800.0, 800.0], 800.0)], "logits array<float>, top double")
    assert abs(df.select(ev.log_sum_exp("logits", "top")).first()[0] - (800.0 + math.log(2))) < 1e-9


def test_align_logits_against_a_plain_walk(spark):
    rnd = random.Random(7)
    width, labels, logits, want = 3, [], [], {}
    for s in range(60):
        kg = [rnd.random() < 0.4 for _ in range(rnd.randint(1, 8))]
        rows = [[rnd.uniform(-1, 1) for _ in range(4)] for _ in range(rnd.randint(1, 14))]
        labels += [(s, i, k) for i, k in enumerate(kg)]
        logits += [(s, i, v) for i, v in enumerate(rows)]
        read, last = 0, None
        for i, k in enumerate(kg):
            if len(kg) == len(rows):
                last = rows[i]
            elif read < len(rows):
                block = rows[read:read + (width if k else 1)]
                read += len(block)
                last = [sum(c) / len(block) for c in zip(*block)]
            want[s, i] = last
    got = ev.align_logits(spark.createDataFrame(labels, "sample_id long, label_pos long, is_kg boolean"),
                          spark.createDataFrame(logits, "sample_id long, pos long, logits array<double>"), width)
    got = {(r["sample_id"], r["label_pos"]): r["logits"] for r in got.collect()}
    assert got.keys() == want.keys()
    assert all(abs(x - y) < 1e-12 for k in want for x, y in zip(got[k], want[k]))
