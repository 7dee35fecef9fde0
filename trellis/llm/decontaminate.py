"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a run of whole texts of about SHARD_BYTES in one task's input. Its words
become symbols, its texts one symbol sequence with an end mark after each. The index
holds the Burrows-Wheeler transform of that sequence as a wavelet matrix, the shard's
dictionary and sampled suffix positions, and is written as one row of a table. A test
phrase is searched backwards, word by word, through ranks in the wavelet matrix; its
occurrences are located by walking to the next sampled position. Overlapping
occurrences merge into removal spans.

Test phrases come in blocks of bounded size; each block is one pass over the index
table, so neither the benchmark nor the documents have to fit anywhere. A word counts
as equal if two independent 64-bit hashes of it are.

Null texts have no words, nor have empty ones; items without words search nothing.
Items with equal texts are all named; item ids count as strings and a repeated id is
one item, null ids are left out of the names. Repeated rows of documents give repeated
results; an empty table an empty one.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import RollingHash, byte_table, bytes_of, mix, read, slices, write_read

#: Bytes of text in a shard (a longer text is a shard of its own), words of a test
#: phrase, bytes of benchmark text searched in one pass, rows between two samples.
SHARD_BYTES = 4_000_000
WINDOW = 10
BLOCK_BYTES = 16_000_000
SAMPLE = 8

#: Bytes of words; A-Z are lower-cased.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = _WORD[_LOWER]
_VALUES = byte_table(101)[_LOWER], byte_table(211)[_LOWER]

INDEX = "shard long, texts int, words long, data binary"
FOUND = ("doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>, "
         "shard long, place int, digest long")


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the texts of a block, and each text's first word."""
    word = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    lo = word.copy()
    lo[1:] &= ~word[:-1] | edge[1:-1]
    hi = word
    hi[:-1] &= ~_WORD[data[1:]] | edge[1:-1]
    lo, hi = np.flatnonzero(lo), np.flatnonzero(hi) + 1
    return lo, hi, np.searchsorted(lo, starts)


def word_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word (lower-cased)."""
    if not len(lo):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = (mix(RollingHash(v[data]).raw(lo, hi)) for v in _VALUES)
    return a, b


def dictionary(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, second hashes, symbol of each word): distinct words in hash order."""
    order = np.argsort(a)
    x, y = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = x[1:] != x[:-1]
    if np.any(y[1:][~new[1:]] != y[:-1][~new[1:]]):  # two words share the first hash
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    symbols = np.empty(len(a), np.int64)
    symbols[order] = np.cumsum(new) - 1
    return x[new], y[new], symbols


def suffix_order(codes: np.ndarray, size: int) -> np.ndarray:
    """The suffix array of a sequence whose suffixes all differ, by prefix doubling:
    only what is still tied is sorted again. Codes are below ``size``."""
    n = len(codes)
    bits = max(1, int(size).bit_length())
    depth = max(1, min(4, 63 // bits))
    key = np.zeros(n, np.uint64)
    for j in range(depth):
        key <<= np.uint64(bits)
        key[:max(0, n - j)] |= codes[j:].astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = first
    tied = ~head
    tied[:-1] |= ~head[1:]
    left = order[tied]  # in the order found so far
    while len(left):
        old = rank[left]
        key = (old << 32) | (rank[np.minimum(left + depth, n)] + 1)
        by = np.argsort(key)
        left, key, old = left[by], key[by], old[by]
        at = np.arange(len(left))
        group, same = np.ones(len(left), bool), np.ones(len(left), bool)
        group[1:] = old[1:] != old[:-1]
        same[1:] = key[1:] != key[:-1]
        begin = np.maximum.accumulate(np.where(group, at, 0))
        rank[left] = old + np.maximum.accumulate(np.where(same, at, 0)) - begin
        tied = ~same
        tied[:-1] |= ~same[1:]
        left = left[tied]
        depth *= 2
    out = np.empty(n, np.int64)
    out[rank[:n]] = np.arange(n)
    return out


class Bits:
    """A bit vector with rank: the ones before a place."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int32)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        out.view(np.uint8)[:len(packed)] = packed
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0

    def rank(self, i: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)


class FMIndex:
    """The searchable form of one shard; ``arrays`` is what is stored."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.hashes, self.seconds = arrays["hashes"], arrays["seconds"]
        self.levels = [Bits(w) for w in arrays["levels"]]
        self.zeros, self.first, self.base = arrays["zeros"], arrays["first"], arrays["base"]
        self.marks, self.samples = Bits(arrays["marks"]), arrays["samples"]
        self.ends = arrays["ends"]  # place of each text's end mark

    @classmethod
    def build(cls, data: np.ndarray, starts: np.ndarray) -> FMIndex:
        texts = len(starts) - 1
        lo, hi, at = word_bounds(data, starts)
        hashes, seconds, symbols = dictionary(*word_hashes(data, lo, hi))
        ends = at[1:] + np.arange(texts)
        n = len(lo) + texts
        seq = np.zeros(n, np.int64)  # 0 for end marks
        is_word = np.ones(n, bool)
        is_word[ends] = False
        seq[is_word] = symbols + 1
        codes = seq + texts  # end marks differ, in text order, so all suffixes do
        codes[ends] = np.arange(texts) + 1
        order = suffix_order(codes, texts + len(hashes) + 1)
        size = len(hashes) + 1
        first = np.zeros(size + 1, np.int32)
        np.cumsum(np.bincount(seq, minlength=size), out=first[1:])
        begin = np.concatenate([[0], ends[:-1] + 1])
        place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        marked = (place % SAMPLE == 0)[order]  # each text's first place, then every SAMPLE-th
        cur = seq[order - 1]  # what stands before each suffix; before the first text, an end mark
        levels, zeros = [], []
        for bit in range(max(1, (size - 1).bit_length()) - 1, -1, -1):
            one = (cur >> bit) & 1 > 0
            levels.append(Bits.pack(one))
            zeros.append(n - int(np.count_nonzero(one)))
            cur = np.concatenate([cur[~one], cur[one]])
        base = np.zeros(size, np.int32)  # where each symbol's run begins after the last level
        new = np.flatnonzero(np.append(True, cur[1:] != cur[:-1]))
        base[cur[new]] = new
        return cls({"hashes": hashes, "seconds": seconds, "levels": np.array(levels), "zeros": np.array(zeros, np.int32),
                    "first": first, "base": base, "marks": Bits.pack(marked),
                    "samples": order[marked].astype(np.int32), "ends": ends.astype(np.int32)})

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.arrays)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> FMIndex:
        with np.load(io.BytesIO(data), allow_pickle=False) as z:
            return cls({k: z[k] for k in z.files})

    def symbols(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbol of each hashed word; 0 if the shard lacks it."""
        if not len(self.hashes):
            return np.zeros(len(a), np.int64)
        i = np.searchsorted(self.hashes, a)
        out = np.zeros(len(a), np.int64)
        todo = np.flatnonzero(i < len(self.hashes))
        while len(todo):  # as a rule once: words that share the first hash stand side by side
            j = i[todo]
            todo, j = todo[self.hashes[j] == a[todo]], j[self.hashes[j] == a[todo]]
            hit = self.seconds[j] == b[todo]
            out[todo[hit]] = j[hit] + 1
            todo = todo[~hit]
            i[todo] += 1
            todo = todo[i[todo] < len(self.hashes)]
        return out

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Where the suffixes that put ``symbol`` before one of the first ``row``
        suffixes end."""
        i = row
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(i)
            i = np.where((symbol >> (len(self.levels) - 1 - level)) & 1, zeros + ones, i - ones)
        return self.first[symbol] + i - self.base[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range [lo, hi) of each phrase: a row of symbols, aligned right."""
        n, width = phrases.shape
        lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero(((phrases > 0).sum(axis=1) == lengths) & (lengths > 0))
        last = phrases[live, width - 1]
        lo[live], hi[live] = self.first[last], self.first[last + 1]
        for j in range(1, width):
            live = live[hi[live] > lo[live]]
            go = live[lengths[live] > j]
            symbol = phrases[go, width - 1 - j]
            both = self.step(np.concatenate([symbol, symbol]), np.concatenate([lo[go], hi[go]]))
            lo[go], hi[go] = both[:len(go)], both[len(go):]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the sequence of each suffix, walked back to a sampled one."""
        out = np.empty(len(rows), np.int64)
        at, row, steps = np.arange(len(rows)), rows, 0
        while len(at):
            found = self.marks.get(row)
            out[at[found]] = self.samples[self.marks.rank(row[found])] + steps
            at, row, steps = at[~found], row[~found], steps + 1
            symbol, i = np.zeros(len(at), np.int64), row
            for bits, zeros in zip(self.levels, self.zeros):
                one, ones = bits.get(i), bits.rank(i)
                symbol = symbol << 1 | one
                i = np.where(one, zeros + ones, i - ones)
            row = self.first[symbol] + i - self.base[symbol]
        return out


class Phrases:
    """The distinct windows of some benchmark items and the items of each."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        texts = pa.array([t for _, t in items], pa.large_string())
        data, starts = bytes_of(texts)
        lo, hi, at = word_bounds(data, starts)
        self.a, self.b, symbols = dictionary(*word_hashes(data, lo, hi))
        self.names = [i for i, _ in items]
        count = np.diff(at)
        size = np.minimum(count, window)
        item = np.repeat(np.arange(len(items)), np.where(count > 0, count - size + 1, 0))
        begin = at[:-1][item] + np.arange(len(item)) - np.searchsorted(item, item)
        place = begin[:, None] + size[item][:, None] - window + np.arange(window)
        words = np.where(place >= begin[:, None], symbols[np.maximum(place, 0)] + 1, 0) if len(item) \
            else np.zeros((0, window), np.int64)
        self.words, which = np.unique(words, axis=0, return_inverse=True)  # 0: no word
        self.lengths = (self.words > 0).sum(axis=1)
        pairs = np.unique(np.stack([which.ravel(), item], axis=1), axis=0)
        self.items, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.words) + 1))

    def occurrences(self, index: FMIndex) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every occurrence of a window in a shard."""
        found = np.append(0, index.symbols(self.a, self.b))
        symbols = found[self.words]
        symbols[(self.words > 0) & (symbols == 0)] = 0
        lo, hi = index.search(symbols, self.lengths)
        which = np.repeat(np.arange(len(lo)), hi - lo)
        rows = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        return which, index.locate(rows)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a shard: the FM-index with the ids and digests of its texts. Write it
    once; it serves any number of benchmarks."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                      F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
                      F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("digest"))

    def build(batches):
        shard = TaskContext.get().partitionId() << 32
        for batch in slices(batches, limit=shard_bytes):
            index = FMIndex.build(*bytes_of(batch.column(1)))
            ids = batch.column(0)
            index.arrays |= {"ids": ids.fill_null(0).to_numpy(), "no_id": ids.is_null().to_numpy(zero_copy_only=False),
                             "digests": batch.column(2).to_numpy()}
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard]), pa.array([batch.num_rows], pa.int32()),
                 pa.array([int(index.first[-1]) - batch.num_rows]), pa.array([index.dump()], pa.binary())],
                names=["shard", "texts", "words", "data"])
            shard += 1

    return src.mapInArrow(build, INDEX)


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans [start, end) merged where they overlap or touch."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1) if len(starts) else np.zeros(0, int)
    return starts[new], ends[last]


def find(index: DataFrame, phrases: Phrases) -> DataFrame:
    """Each text's removal spans (in words) and items, by one pass over the index."""
    def run(batches):
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(3)):
                fm = FMIndex.load(data.as_buffer())
                which, place = phrases.occurrences(fm)
                ends = fm.ends.astype(np.int64)
                begin = np.concatenate([[0], ends[:-1] + 1])
                text = np.searchsorted(ends, place)
                lo, hi = merge(place, place + phrases.lengths[which])  # never beyond a text: end marks part texts
                owner = np.searchsorted(ends, lo)
                at = np.searchsorted(owner, np.arange(len(ends) + 1)).astype(np.int32)
                # each text's windows, then their items
                pair = np.unique(text * (len(phrases.lengths) + 1) + which)
                text, which = np.divmod(pair, len(phrases.lengths) + 1)
                n = phrases.first[which + 1] - phrases.first[which]
                item = phrases.items[np.repeat(phrases.first[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                pair = np.unique(np.repeat(text, n) * (len(phrases.names) + 1) + item)
                text, item = np.divmod(pair, len(phrases.names) + 1)
                many = np.searchsorted(text, np.arange(len(ends) + 1)).astype(np.int32)
                names = pa.array([phrases.names[i] for i in item.tolist()], pa.string())
                ids = pa.array(fm.arrays["ids"], mask=fm.arrays["no_id"])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(ends - begin), pa.ListArray.from_arrays(at, pa.array((lo - begin[owner]).astype(np.int32))),
                     pa.ListArray.from_arrays(at, pa.array((hi - begin[owner]).astype(np.int32))),
                     pa.ListArray.from_arrays(many, names), pa.array(np.full(len(ends), shard)),
                     pa.array(np.arange(len(ends), dtype=np.int32)), pa.array(fm.arrays["digests"])],
                    names=["doc_id", "n_words", "starts", "ends", "items", "shard", "place", "digest"])

    return index.mapInArrow(run, FOUND)


def phrase_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES):
    """Phrases of the items, some bounded bytes of text at a time."""
    src = items.select(F.col(f"`{id_col}`").cast("string").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    block, size = [], 0
    for name, text in src.where(F.length("text") > 0).toLocalIterator():
        block.append((name, text))
        size += 4 * len(text)
        if size >= block_bytes:
            yield Phrases(block, window)
            block, size = [], 0
    if block:
        yield Phrases(block, window)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, starts, ends, items, shard, place, digest) of every row of
    ``docs``: merged spans of words inside test phrases, and the items found."""
    index = write_read(build_index(docs, id_col, text_col, shard_bytes), "fm-index")
    passes = [find(index, p) for p in phrase_blocks(items, window=window, block_bytes=block_bytes)]
    if not passes:
        passes = [find(index, Phrases([], window))]
    if len(passes) == 1:
        return passes[0]
    found = passes[0]
    for other in passes[1:]:
        found = found.unionByName(other)

    def once(batches):
        for batch in batches:
            rows = batch.to_pydict()
            for i, (starts, ends) in enumerate(zip(rows["starts"], rows["ends"])):
                lo, hi = merge(np.concatenate([np.array(x, int) for x in starts]), np.concatenate([np.array(x, int) for x in ends]))
                rows["starts"][i], rows["ends"][i] = lo.tolist(), hi.tolist()
                rows["items"][i] = sorted({x for y in rows["items"][i] for x in y if x is not None})
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in out], schema=out)

    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
                     ("items", pa.list_(pa.string())), ("shard", pa.int64()), ("place", pa.int32()), ("digest", pa.int64())])
    lists = [F.collect_list(c).alias(c) for c in ("starts", "ends", "items")]
    rows = (found.groupBy("shard", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                                                F.first("digest").alias("digest"), *lists)
            .select("doc_id", "n_words", "starts", "ends", "items", "shard", "place", "digest"))
    return rows.mapInArrow(once, FOUND)


def cut_words(text: str, starts: list[int], ends: list[int]) -> str:
    """A text without some spans of its words; what stands between two removed words
    goes with them."""
    data = np.frombuffer(text.encode(), np.uint8)
    lo, hi, _ = word_bounds(data, np.array([0, len(data)]))
    raw, out, at = data.tobytes(), [], 0
    for s, e in zip(starts, ends):
        out.append(raw[at:lo[s]])
        at = hi[e - 1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with test phrases cut out of its texts. Only texts with spans are cut:
    they meet their spans by id and digest; ids and texts that repeat have equal spans."""
    spans = contamination(docs, items, id_col, text_col).where(F.size("starts") > 0)
    spans = spans.groupBy("doc_id", "digest").agg(F.first("starts").alias("starts"), F.first("ends").alias("ends"))
    spans = spans.select(*[F.col(c).alias(f"__{c}") for c in spans.columns])

    @F.pandas_udf("string")
    def cut(text, starts, ends):
        return text.__class__([t if s is None else cut_words(t, s, e) for t, s, e in zip(text, starts, ends)], dtype=object)

    text = F.col(f"`{text_col}`").cast("string")
    met = docs.join(spans, F.col("__doc_id").eqNullSafe(F.col(f"`{id_col}`").cast("long")) & (F.col("__digest") == F.xxhash64(text)), "left")
    return met.withColumn(text_col, F.when(F.col("__starts").isNotNull(), cut(text, "__starts", "__ends")).otherwise(text)) \
        .select(*[F.col(f"`{c}`") for c in docs.columns])


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.array_distinct(F.array_compact("items")))
    hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
                        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


OP12_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
windows AS (
  SELECT DISTINCT id AS item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS phrase
  FROM words, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(p) WHERE kind = 'b' AND len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT id AS doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS phrase
  FROM words, sizes, unnest(range(1, len(w) - n + 2)) AS t(p) WHERE kind = 'd'),
found AS (SELECT doc_id, p, n, item_id FROM places JOIN windows USING (n, phrase)),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM found, unnest(range(p, p + n)) AS t(q) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits ON id = hits.doc_id LEFT JOIN items ON id = items.doc_id WHERE kind = 'd'
"""
