"""Codebook fit (V6): the residual quantiser learned step by step.

Each round is one Arrow pass over the vectors: a task assigns its residuals to the
nearest codes by cosine and emits one row a code, their count and the sum of their
directions; the sums meet by code, and only K sums reach the driver, which moves the
averages. Codes whose average count falls below the threshold start anew from residuals
that come first in the order of a hash of their id. Residuals are carried to the next
step by one more pass and written, so a step does not depend on the passes before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.vector import MAX_CODEBOOK_VALUES, ZERO_RESIDUAL
from trellis.session import materialize

#: The quantiser's settings: passes a step, weight of the past in the moving averages,
#: average count below which a code is dead.
ROUNDS = 6
DECAY = 0.8
DEAD = 0.5

_SUMS = "code int, n long, total array<double>"


@dataclass(frozen=True)
class Fit:
    """Unit codes [steps, K, D] (one step if shared) and how many residuals each step
    gave to each code [steps, K]."""

    codes: np.ndarray
    sizes: np.ndarray


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def nearest(r: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code with the highest cosine to each residual (the lowest of equals; 0 for a
    vanished one), and which residuals have a direction."""
    alive = np.linalg.norm(r, axis=1) >= ZERO_RESIDUAL
    return np.where(alive, np.argmax(r @ codes.T, axis=1), 0), alive


def project(r: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Residuals without their projection onto their codes."""
    code, alive = nearest(r, codes)
    chosen = codes[code]
    return r - np.where(alive, (r * chosen).sum(axis=1), 0.0)[:, None] * chosen


def _sums(vectors: DataFrame, codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts [depth, K] and sums of directions [depth, K, D] over all vectors (vanished
    residuals count for code 0, as the encoder has it); with
    ``depth`` over 1 each vector goes on with its residual on the same codes."""
    k, dim = codes.shape

    def part(batches):
        n, total = np.zeros((depth, k), np.int64), np.zeros((depth, k, dim))
        for batch in batches:
            r = _matrix(batch.column(1), dim)
            for s in range(depth):
                code, alive = nearest(r, codes)
                n[s] += np.bincount(code, minlength=k)
                np.add.at(total[s], code[alive], r[alive] / np.linalg.norm(r[alive], axis=1, keepdims=True))
                r = project(r, codes)
        used = np.flatnonzero(n.ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(n.ravel()[used]),
             pa.array(list(total.reshape(-1, dim)[used]), pa.list_(pa.float64()))], names=["code", "n", "total"])

    def meet(batches):
        have: dict[int, list] = {}
        for batch in batches:
            for code, n, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _matrix(batch.column(2), dim)):
                old = have.setdefault(code, [0, np.zeros(dim)])
                old[0] += n
                old[1] += row
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(have), pa.int32()), pa.array([x[0] for x in have.values()], pa.int64()),
             pa.array([x[1] for x in have.values()], pa.list_(pa.float64()))], names=["code", "n", "total"])

    n, total = np.zeros(depth * k, np.int64), np.zeros((depth * k, dim))
    for row in vectors.mapInArrow(part, _SUMS).repartition("code").mapInArrow(meet, _SUMS).collect():
        n[row["code"]], total[row["code"]] = row["n"], row["total"]
    return n.reshape(depth, k), total.reshape(depth, k, dim)


def _sample(vectors: DataFrame, n: int, seed: int) -> np.ndarray:
    """The directions of the first ``n`` residuals in hash order (all, if there are fewer)."""
    live = vectors.where(F.sqrt(F.aggregate("r", F.lit(0.0), lambda a, x: a + x * x)) >= ZERO_RESIDUAL)
    rows = live.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).collect()
    r = np.array([row["r"] for row in rows], float)
    return r / np.linalg.norm(r, axis=1, keepdims=True) if len(r) else r


class Averages:
    """Moving averages of counts and sums of one codebook."""

    def __init__(self, start: np.ndarray, decay: float, dead: float):
        self.codes, self.decay, self.dead = start, decay, dead
        self.n, self.total = np.ones(len(start)), start.copy()

    def update(self, n: np.ndarray, total: np.ndarray, fresh) -> None:
        """``fresh(count)`` gives that many new directions for dead codes."""
        self.n = self.decay * self.n + (1 - self.decay) * n
        self.total = self.decay * self.total + (1 - self.decay) * total
        gone = np.flatnonzero(self.n < self.dead)
        if len(gone):
            new = fresh(len(gone))
            gone = gone[:len(new)]
            self.total[gone], self.n[gone] = new * self.dead, self.dead
        length = np.linalg.norm(self.total, axis=1, keepdims=True)
        self.codes = np.where(length > ZERO_RESIDUAL, self.total / np.maximum(length, ZERO_RESIDUAL), self.codes)


def fit_codebook(vectors: DataFrame, steps: int, k: int, dim: int, id_col: str = "id", vec_col: str = "vec",
                 shared: bool = False, rounds: int = ROUNDS, decay: float = DECAY, dead: float = DEAD) -> Fit:
    """Learn ``steps`` codebooks of at most ``k`` unit codes (or one for all steps).

    Null vectors and those of another length or with null or non-finite values take no
    part; equal vectors count each. Fewer directions than codes repeat the last ones;
    no vectors raise. Runs ``rounds`` + 2 passes a step."""
    if steps * k * dim > MAX_CODEBOOK_VALUES:
        raise ValueError(f"codebook too large: {steps} steps x {k} codes x {dim} dims")
    x = F.transform(vec_col, lambda v: v.cast("double"))
    whole = (F.size(vec_col) == dim) & F.forall(vec_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    now = materialize(vectors.where(whole).select(F.col(id_col).cast("long").alias("id"), x.alias("r")))

    def start(seed):
        got = _sample(now, k, seed)
        if not len(got):
            raise ValueError("no vectors to learn codes from")
        return got[np.minimum(np.arange(k), len(got) - 1)]

    codes, sizes = [], []
    for s in range(1 if shared else steps):
        depth = steps if shared else 1
        try:
            average = Averages(start(1000 * s), decay, dead)
        except ValueError:
            if not s:
                raise
            average = Averages(codes[-1], decay, dead)  # nothing is left over: any codes will do
        for i in range(rounds):
            n, total = _sums(now, average.codes, depth)
            average.update(n.sum(axis=0), total.sum(axis=0), lambda count, i=i: _sample(now, count, 1000 * s + i + 1))
        n, _ = _sums(now, average.codes, depth)
        codes.append(average.codes)
        sizes += list(n)
        if s + 1 < steps and not shared:
            now = materialize(_carry(now, average.codes))
    return Fit(np.array(codes), np.array(sizes))


def _carry(vectors: DataFrame, codes: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            r = project(_matrix(batch.column(1), codes.shape[1]), codes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(r), pa.list_(pa.float64()))], names=["id", "r"])

    return vectors.mapInArrow(run, "id long, r array<double>")


def code_sets(codes: DataFrame) -> DataFrame:
    """V8/V9: the codes that each step uses, as bitmaps of 32768 codes each."""
    return codes.groupBy("step", F.bitmap_bucket_number("code").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("used"))


def set_utilisation(sets: DataFrame, k: int) -> DataFrame:
    """V8: distinct codes of each step / K."""
    return sets.groupBy("step").agg((F.sum(F.bitmap_count("used")) / F.lit(k)).alias("utilisation"))


def shared_utilisation(sets: DataFrame, k: int) -> DataFrame:
    """V9 of a shared codebook: codes used by any step / K, from the union of the bitmaps."""
    union = sets.groupBy("bucket").agg(F.bitmap_or_agg("used").alias("used"))
    return union.agg((F.sum(F.bitmap_count("used")) / F.lit(k)).alias("shared_utilisation"))
