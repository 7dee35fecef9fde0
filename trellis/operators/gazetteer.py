"""Gazetteer mentions (N4): all labels in all texts, in one scan of the texts.

A label's hash sets two bits of a map of bounded size, which goes to the tasks; of a text's
word spans only those whose bits are set leave the scan (the labels in it, and a few others).
They are confirmed by an equi-join with the labels, so neither the passes over the texts
nor a task's memory grow with the labels; overlaps are then settled from the left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.text import col_

#: Bits of the map for each label, and at most (64 MB). A full map lets more spans through to
#: the join, never fewer labels.
BITS_PER_LABEL = 64
MAX_BITS = 1 << 29
#: Bits of one row of the map (Spark's bitmaps hold 32,768).
ROW_BITS = 32_768
SHARD_CHARS = MAX_BITS  # the former name of what bounds a task's share of the labels


def words(text) -> Column:
    """Lower-cased words of a text."""
    return F.split(F.lower(F.regexp_replace(col_(text), r"(?U)^\s+|\s+$", "")), r"(?U)\s+")


def label_map(keys: DataFrame, n_labels: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """The bits of ``keys(key)`` as bytes, a power of two times ``ROW_BITS``: fetched as
    bitmaps, not as labels."""
    bits = ROW_BITS
    while bits < min(n_labels * BITS_PER_LABEL, max_bits):
        bits *= 2
    at, h = F.col("_at"), F.xxhash64("key")
    places = F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftright(h, 32).bitwiseAND(F.lit(bits - 1)))
    # bitmap positions count from 1
    rows = (keys.select(F.explode(places).alias("_at")).select((at + 1).alias("_at")).groupBy(F.bitmap_bucket_number(at).alias("b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows.toLocalIterator():
        start = (r["b"] - 1) * (ROW_BITS // 8)
        out[start:start + len(r["m"])] = np.frombuffer(r["m"], dtype=np.uint8)
    return out


def _set_spans(label_bits: np.ndarray):
    """Of each text's ``hashes`` those whose bits are set, as (text_id, w, at): ``at`` counts
    the hashes of the text."""
    low = len(label_bits) * 8 - 1

    def is_set(at):
        return (label_bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def run(batches):
        for batch in batches:
            hashes = batch.column("hashes")
            flat = hashes.flatten().to_numpy()
            hit = np.flatnonzero(is_set(flat & low) & is_set((flat >> 32) & low))
            ends = np.cumsum(hashes.value_lengths().to_numpy(zero_copy_only=False))
            row = np.searchsorted(ends, hit, side="right")
            at = hit - np.concatenate([[0], ends])[row]
            counts = np.bincount(row, minlength=batch.num_rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            some = pa.array(counts > 0)
            lists = pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("text_id"), batch.column("w"), lists], names=["text_id", "w", "at"]).filter(some)

    return run


def mentions(texts: DataFrame, labels: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(text_id, pos, n_words, mention)``: the longest labels in ``texts(text_id,
    text)`` from the left, by word position; ``labels(key)`` are lower-cased. A text id
    is one text. Counts the labels and fetches the numbers of words that labels have; a
    text is looked up once for each of them at each word."""
    keys = labels.select(F.array_join(words("key"), " ").alias("key")).where("key <> ''").distinct()
    found = keys.groupBy((F.length("key") - F.length(F.replace("key", F.lit(" "), F.lit(""))) + 1).alias("n")).count().collect()
    sizes = sorted(r["n"] for r in found)
    kind = dict(texts.dtypes)["text_id"]
    schema = f"text_id {kind}, w array<string>, at array<int>"
    if not sizes:
        return texts.where("false").select("text_id", F.lit(0).alias("pos"), F.lit(0).alias("n_words"), F.lit("").alias("mention"))
    label_bits = label_map(keys, sum(r["count"] for r in found), max_bits)
    src = texts.select("text_id", words("text").alias("w")).where("array_join(w, ' ') <> ''")
    # hash i * len(sizes) + j: the span of sizes[j] words from word i (one that ends behind
    # the text is dropped below)
    span = lambda i, n: F.array_join(F.slice("w", i + 1, n), " ")
    hashes = F.flatten(F.transform(F.sequence(F.lit(0), F.size("w") - 1),
                                   lambda i: F.array(*[F.xxhash64(span(i, F.lit(n))) for n in sizes])))
    hits = src.select("text_id", "w", hashes.alias("hashes")).mapInArrow(_set_spans(label_bits), schema)
    size = lambda a: F.element_at(F.array(*map(F.lit, sizes)), F.pmod(a, F.lit(len(sizes))) + 1)
    at = lambda a: F.floor(a / len(sizes)).cast("int")
    spans = hits.select("text_id", F.inline(F.transform("at", lambda a: F.struct(
        at(a).alias("pos"), size(a).alias("n_words"), span(at(a), size(a)).alias("mention"), (at(a) + size(a) <= F.size("w")).alias("ends")))))
    spans = spans.where("ends").drop("ends")
    spans = spans.join(keys.withColumnRenamed("key", "mention"), "mention", "left_semi")
    # spans of one text, from the left and the longest first; one is kept if the last kept one ends before it
    order = F.array_sort(F.collect_list(F.struct("pos", (-F.col("n_words")).alias("less"), "mention")))
    kept = F.aggregate("s", F.array().cast("array<struct<pos:int,less:int,mention:string>>"),
                       lambda acc, x: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["pos"] - F.element_at(acc, -1)["less"]
                                                                   <= x["pos"]), F.concat(acc, F.array(x))).otherwise(acc))
    return (spans.groupBy("text_id").agg(order.alias("s")).select("text_id", F.explode(kept).alias("x"))
            .select("text_id", "x.pos", (-F.col("x.less")).alias("n_words"), "x.mention"))
