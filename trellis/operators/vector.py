"""Residual vector quantisation and pooling.

The codebook is a model parameter of Q*K*D numbers; its size is checked and
it is shipped once per task with the function, while the vectors stream
through one Arrow-batched ``mapInPandas`` pass (no shuffle, no per-row
Python). Everything downstream (losses, utilisation, dead codes) is plain
aggregation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BETA_COMMIT = 0.25
STD_FLOOR = 1e-6
MAX_CODEBOOK_VALUES = 64_000_000  # 20 x 128 x 1024 fits many times over
ZERO_RESIDUAL = 1e-9

ENCODE_SCHEMA = "id long, step int, code int, alpha double, cos double, leftover double"


def load_codebook(codebook: DataFrame, dim: int | None = None) -> np.ndarray:
    """``codebook(step, code, vec)`` -> float64 array [Q, K, D] of unit codes,
    after checking that it is a bounded parameter table."""
    n = codebook.count()
    first = codebook.select(F.size("vec").alias("d")).first()
    d = dim or (first["d"] if first else 0)
    if n * max(d, 1) > MAX_CODEBOOK_VALUES:
        raise ValueError(f"codebook too large to ship: {n} codes x {d} dims")
    rows = codebook.select("step", "code", "vec").collect()
    q = 1 + max(r["step"] for r in rows)
    k = 1 + max(r["code"] for r in rows)
    cb = np.zeros((q, k, d), dtype=np.float64)
    for r in rows:
        v = np.asarray(r["vec"], dtype=np.float64)
        cb[r["step"], r["code"]] = v / max(np.linalg.norm(v), 1e-12)
    return cb


def rvq_encode(vectors: DataFrame, cb: np.ndarray, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """V1-V3 (+ the per-step terms of V4/V5): per vector and step, the code
    with the highest cosine to the residual (ties: lowest code), ``alpha =
    r . c``, ``r -= alpha * c``, the clamped cosine and ``mean(r^2)`` after
    the step."""
    q_steps = cb.shape[0]

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            ids = pdf[id_col].to_numpy()
            r = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec_col]])
            out = []
            for s in range(q_steps):
                dots = r @ cb[s].T                              # [B, K]
                norms = np.linalg.norm(r, axis=1, keepdims=True)
                cos = dots / np.maximum(norms, 1e-12)
                best = np.argmax(cos, axis=1)                   # first max = lowest code
                rows = np.arange(len(ids))
                # a vanished residual (|r| < 1e-9) has no direction: code 0, alpha 0
                dead = norms[:, 0] < ZERO_RESIDUAL
                best[dead] = 0
                alpha = np.where(dead, 0.0, dots[rows, best])
                cos[dead, 0] = 0.0
                r = r - alpha[:, None] * cb[s][best]
                out.append(pd.DataFrame({
                    "id": ids.astype("int64"), "step": np.int32(s), "code": best.astype("int32"),
                    "alpha": alpha, "cos": np.clip(cos[rows, best], -1.0, 1.0),
                    "leftover": (r ** 2).mean(axis=1)}))
            yield pd.concat(out, ignore_index=True)

    return vectors.select(F.col(id_col).cast("long").alias(id_col), vec_col).mapInPandas(run, ENCODE_SCHEMA)


def commitment_loss(codes: DataFrame) -> DataFrame:
    """V4: ``beta * mean(1 - cos)`` per step."""
    return codes.groupBy("step").agg((F.lit(BETA_COMMIT) * F.avg(1 - F.col("cos"))).alias("commit_loss"))


def leftover_energy(codes: DataFrame, last_step: int) -> DataFrame:
    """V5: mean over vectors of ``mean(residual^2)`` after the last step."""
    return codes.filter(F.col("step") == last_step).agg(F.avg("leftover").alias("leftover_energy"))


def dead_codes(codes: DataFrame, codebook: DataFrame, threshold: int) -> DataFrame:
    """V7: codes used fewer than ``threshold`` times."""
    use = codes.groupBy("step", "code").agg(F.count(F.lit(1)).alias("n"))
    return (codebook.select("step", "code").join(use, ["step", "code"], "left")
            .filter(F.coalesce("n", F.lit(0)) < threshold))


def utilisation(codes: DataFrame, k: int) -> DataFrame:
    """V8: distinct codes used per step / K (exact, global)."""
    return codes.groupBy("step").agg((F.count_distinct("code") / F.lit(k)).alias("utilisation"))


def bounded_codes(codes: DataFrame, start: int, end: int) -> DataFrame:
    """``[start] + codes in step order + [end]`` per vector."""
    g = codes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("step", "code"))).alias("_c"))
    return g.select("id", F.concat(F.array(F.lit(start)), F.transform("_c", lambda x: x["code"]),
                                   F.array(F.lit(end))).alias("tokens"))


def mean_pool(nodes: DataFrame, group: str, vec: str) -> DataFrame:
    """Element-wise mean of the node vectors of each graph (long form
    per dimension, partial aggregation; no graph is gathered whole)."""
    e = nodes.select(group, F.posexplode(vec).alias("dim", "x"))
    return e.groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def standardise(df: DataFrame, tokens: str, scale: Column, bias: float | list[float] = 0.0,
                out: str = "std_tokens") -> DataFrame:
    """Per graph, subtract the mean of all token values, divide by their
    sample std (floor 1e-6), multiply by ``scale`` and add ``bias`` (a number, or a
    vector of a token's width that repeats for each token). A pass of numpy over Arrow
    batches: element lambdas would compute mean and std anew for each value."""
    shift = np.asarray(bias, dtype=np.float64).ravel()

    @F.pandas_udf("array<double>")
    def values(rows: pd.Series, scales: pd.Series) -> pd.Series:
        def one(x, by):
            if x is None or not len(x):
                return x
            x = np.asarray(x, dtype=np.float64)
            sd = max(x.std(ddof=1), STD_FLOOR) if len(x) > 1 else STD_FLOOR
            return (x - x.mean()) / sd * by + np.resize(shift, len(x))

        return pd.Series([one(x, by) for x, by in zip(rows, scales)], dtype=object)

    return df.withColumn(out, values(F.col(tokens), scale))


def hashed_ngram_embedding(labels: DataFrame, col: str, dim: int = 64, n: int = 3) -> DataFrame:
    """E5 default: a batch label encoder without a model -- hashed character
    n-gram counts, L2-normalised, computed per Arrow batch. Replace by any
    ``pandas.Series[str] -> list[vector]`` function for a real encoder."""
    import hashlib

    def enc(texts: pa.Array) -> pa.Array:
        # one flat matrix a batch: a list of Python floats a text takes four times its size
        out = np.zeros((len(texts), dim))
        known: dict[str, int] = {}  # the n-grams of a batch repeat
        for v, t in zip(out, texts.to_pylist()):
            s = f"  {t or ''}  "
            for i in range(len(s) - n + 1):
                gram = s[i:i + n]
                at = known.get(gram)
                if at is None:
                    at = known[gram] = int(hashlib.md5(gram.encode()).hexdigest()[:8], 16) % dim
                v[at] += 1.0
            nrm = math.sqrt(v @ v)
            if nrm > 0:
                v /= nrm
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * dim), pa.array(out.ravel()))

    udf = F.arrow_udf(enc, T.ArrayType(T.DoubleType()))
    return labels.withColumn("vec", udf(F.col(col)))
