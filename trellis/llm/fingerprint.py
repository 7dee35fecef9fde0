"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases level by level. Runs of one name are a name of
their own; deterministic coin tossing then gives each name a label of a tiny
alphabet that depends on a few names to its left only, neighbours always
differ, and a phrase starts at each local maximum of the labels. The phrases'
hashes are the names of the next level, until one name is left. Equal substrings
therefore have the same names inside, wherever they stand. The fingerprint is a
one-permutation MinHash of the names of the upper levels.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import byte_table, bytes_of, id_text, mix, partitions, read, slices

#: Slots of a fingerprint (four hex digits each; 0000 is an empty slot), and the
#: first level whose names count: its phrases are about nine bytes long.
SLOTS = 64
FIRST_LEVEL = 2
#: Buckets of consecutive documents for each shuffle partition.
BUCKETS = 3

_NAMES = byte_table(23)
_PLACE = np.concatenate([[np.uint64(1)], mix(np.arange(1, 64, dtype=np.uint64)) | np.uint64(1)])


def _toss(prev: np.ndarray, cur: np.ndarray) -> np.ndarray:
    """2 * (lowest bit in which the two differ) + that bit of ``cur``."""
    diff = prev ^ cur
    low = diff & (~diff + diff.dtype.type(1))
    place = np.bitwise_count(low - diff.dtype.type(1)).astype(cur.dtype)
    return (2 * place + ((cur >> place) & cur.dtype.type(1))).astype(np.uint8)


# rounds two to four of the tossing work on labels below 128
_AGAIN = np.zeros((128, 128), np.uint8)
for _a in range(128):
    _AGAIN[_a] = _toss(np.full(128, _a, np.uint8), np.arange(128, dtype=np.uint8))
_AGAIN[np.arange(128), np.arange(128)] = 0


def phrases(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the phrases of texts whose adjacent names differ; ``first``
    marks the first name of each text."""
    at = np.flatnonzero(first)
    prev = np.empty_like(names)
    prev[1:] = names[:-1]
    prev[at] = ~names[at]
    labels = _toss(prev, names)
    for _ in range(3):
        before = np.empty_like(labels)
        before[1:] = labels[:-1]
        before[at] = labels[at] ^ 1
        labels = _AGAIN[before, labels]
    peak = np.ones(len(names), bool)
    peak[1:] = labels[1:] > labels[:-1]
    peak[:-1] &= (labels[:-1] > labels[1:]) | first[1:]
    return np.flatnonzero(peak | first)


def parse(names: np.ndarray, text: np.ndarray, n: int):
    """Yield (level, names, text) of all levels; ``text`` numbers the texts."""
    level = 0
    while len(names):
        first = np.ones(len(names), bool)
        first[1:] = text[1:] != text[:-1]
        new = first.copy()
        new[1:] |= names[1:] != names[:-1]
        at = np.flatnonzero(new)
        if len(at) < len(names):  # a run of one name becomes a name of its own
            runs = np.diff(np.append(at, len(names)))
            names, text, first = names[at], text[at], first[at]
            many = runs > 1
            names = names.copy()
            names[many] = mix(names[many] + runs[many].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        yield level, names, text
        size = np.bincount(text, minlength=n)
        going = size[text] > 1
        names, text, first = names[going], text[going], first[going]
        if not len(names):
            return
        at = phrases(names, first)
        place = np.arange(len(names)) - np.repeat(at, np.diff(np.append(at, len(names))))
        names = mix(np.add.reduceat(names * _PLACE[np.minimum(place, 63)], at))
        text = text[at]
        level += 1


def fingerprints(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[texts, SLOTS] 16-bit fingerprints; 0 is an empty slot."""
    n = len(starts) - 1
    best = np.full(n * SLOTS, ~np.uint64(0))
    text = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))
    for level, names, own in parse(_NAMES[data], text, n):
        if level < FIRST_LEVEL:  # of the lower levels only the whole text's name counts
            alone = np.bincount(own, minlength=n)[own] == 1
            names, own = names[alone], own[alone]
        h = mix(names)
        slot = own * SLOTS + (h >> np.uint64(58)).astype(np.int64)
        np.minimum.at(best, slot, h << np.uint64(6))
    out = (best >> np.uint64(24)) % np.uint64(0xFFFF) + np.uint64(1)
    out[best == ~np.uint64(0)] = 0
    return out.astype(np.uint16).reshape(n, SLOTS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common names, row by row: equal slots of those that
    either has; 1 for two empty texts."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return np.where(used > 0, same / np.maximum(used, 1), 1.0)


def _hex(rows: np.ndarray) -> pa.Array:
    return pa.array([r.astype(">u2").tobytes().hex() for r in rows], pa.string())


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text. A null text counts as empty;
    an empty text has the fingerprint of zeros."""
    def run(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), _hex(fingerprints(*bytes_of(part.column(1))))],
                                             names=["doc_id", "fingerprint"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, ghost, doc_id, text) sorted within partitions so that the next
    document by id stands behind each one.

    Ids are cut into buckets at quantiles. The first document of a bucket goes
    to the end of the one before as well (the very first to the end of the last),
    marked ``ghost``: one shuffle moves each text once, whatever the table's size.
    """
    spark = docs.sparkSession
    src = id_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    n = BUCKETS * partitions(spark)
    cuts = src.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] or []
    # as floating point: still in order, so equal ids share a bucket
    cuts = sorted({float(c) for c in cuts})
    src = src.withColumn("at", F.col("doc_id").cast("double"))
    if cuts:
        find = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="at", outputCol="bucket")
        src = find.transform(src).withColumn("bucket", F.col("bucket").cast("int"))
    else:
        src = src.withColumn("bucket", F.lit(0))
    firsts = src.groupBy("bucket").agg(F.min("doc_id").alias("doc_id")).collect()
    firsts = sorted((r[0], r[1]) for r in firsts)
    ghosts = [(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))]
    # one row for each bucket at most
    ghosts = F.broadcast(spark.createDataFrame(ghosts, "first long, target int"))
    own = src.join(ghosts, src.doc_id == ghosts["first"], "left").select(
        F.explode(F.when(F.col("target").isNull(), F.array(F.struct("bucket", F.lit(0).alias("ghost"))))
                  .otherwise(F.array(F.struct("bucket", F.lit(0).alias("ghost")),
                                     F.struct(F.col("target").alias("bucket"), F.lit(1).alias("ghost"))))).alias("at"),
        "doc_id", "text")
    own = own.select("at.bucket", "at.ghost", "doc_id", "text")
    return (own.repartition(partitions(spark), F.xxhash64("bucket"))
            .sortWithinPartitions("bucket", "ghost", "doc_id", "text"))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as
    many (or all) of ``following``."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, its edited text and its next document's.

    The next document is that of the next larger id (after the last: the first;
    a single document is its own next). Rows of one id follow each other in
    order of their texts. Rows with a null id come first. An empty table gives
    an empty result.
    """
    def run(batches):
        held: tuple | None = None  # the last row, whose next one has not come yet
        for part in slices(batches):
            buckets, ghosts, ids, texts = (part.column(c).to_pylist() for c in range(4))
            if held:
                buckets, ghosts, ids, texts = ([h, *x] for h, x in zip(held, (buckets, ghosts, ids, texts)))
            held = buckets[-1], ghosts[-1], ids[-1], texts[-1]
            at = [i for i in range(len(ids) - 1) if not ghosts[i] and buckets[i] == buckets[i + 1]]
            if not at:
                continue
            changed = [edited(texts[i], texts[i + 1]) for i in at]
            own = fingerprints(*bytes_of(pa.array(texts, pa.string())))
            alike = fingerprints(*bytes_of(pa.array(changed, pa.string())))
            rows = np.array(at)
            key = [None if ids[i] == -(1 << 63) else ids[i] for i in at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array([len(texts[i]) for i in at], pa.int64()),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                 _hex(own[rows]), _hex(alike), pa.array(likeness(own[rows], alike)),
                 pa.array(likeness(own[rows], own[rows + 1]))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return with_next(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(read(spark, sf_dir, "documents"))
