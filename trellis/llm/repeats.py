"""Suffix-array dedup: remove bytes of later copies of long repeated strings.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a
document of smaller id, or earlier in the same one. Suffixes are compared
LENGTH bytes deep, so the suffix array of a block is the order of its windows,
and the longest previous factor of a window reaches LENGTH exactly if the
nearest smaller position before it in suffix order (the previous smaller value)
has the same window. Windows are brought together without sorting all suffixes
of the corpus:

1. Anchors. Each window picks the least hash of its GRAM-byte strings. A run of
   windows with one pick is keyed by the picked string (anchor) and by the bytes
   of the whole run (context). Equal windows pick equal anchors.
2. Runs meet by anchor. Of equal contexts all but the first go whole. A context
   whose anchor has no other context has no equal window elsewhere.
3. The other contexts are fetched from their texts and meet by anchor again;
   each task builds the suffix array of a block of them with its arrays of
   longest previous factors.
4. The spans of a document are merged and cut out.

Hot anchors (very frequent passages): a block of texts sends each context once;
an anchor with many contexts in a block is dealt by context, and the windows of
its runs that are first in their block meet once more by hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import (RollingHash, byte_table, bytes_of, mix, partitions, read, slices, write_read)
from trellis.operators.ordinal import dense_ordinal

LENGTH = 100
GRAM = 24
#: Contexts of one anchor in a block of texts beyond which they are dealt apart.
HOT_CONTEXTS = 8
#: Contexts whose windows make one suffix array.
ARRAY_CONTEXTS = 5_000
#: Bytes of a very long text that are searched at once.
SEGMENT_BYTES = 4_000_000

_BYTES = byte_table(5)
_PLACE_BITS = np.uint64(24)
_PLACE = np.uint64((1 << 24) - 1)
_ANCHOR, _DEALT, _HOT, _SPAN = range(4)
_FIRST = -(1 << 63)


def runs(data: np.ndarray, starts: np.ndarray, length: int = LENGTH):
    """(text, first window, last window, anchor hash, context hash) of each run
    of windows with one anchor; window numbers are places in ``data``."""
    n, wide = len(data), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    roll = RollingHash(_BYTES[data])
    grams = mix(roll.raw(np.arange(n - GRAM + 1), np.arange(GRAM, n + 1)))
    # the place in the low bits: ties go to the leftmost
    key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    padded = np.concatenate([key, np.full(-len(key) % wide, ~np.uint64(0))]).reshape(-1, wide)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    pick = (np.minimum(right[:count], left[wide - 1:wide - 1 + count]) & _PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:count]
    inside = np.arange(count) + length <= starts[text + 1]
    change = np.ones(count + 1, bool)
    change[1:-1] = (pick[1:] != pick[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    lo = np.flatnonzero(change[:-1] & inside)
    hi = np.flatnonzero(change[1:] & inside)
    return text[lo], lo, hi, grams[pick[lo]], mix(roll.raw(lo, hi + length))


def _arrow(names: str, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names.split())


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


RUNS = "h long, ctx long, uid long, at long"


def run_rows(docs: DataFrame, length: int) -> DataFrame:
    """Runs of all texts (uid, text), each context of a block once; spans of the
    block's other ones; marks of hot anchors. ``at`` holds place, size and kind."""
    def block(uids: np.ndarray, data: np.ndarray, starts: np.ndarray, shift: int):
        text, lo, hi, h, ctx = runs(data, starts, length)
        uid, place, size = uids[text], lo - starts[text] + shift, hi - lo
        order = np.lexsort((place, uid, ctx, h))
        uid, place, size, h, ctx = (x[order] for x in (uid, place, size, h, ctx))
        new_h = np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new = new_h.copy()
        new[1:] |= ctx[1:] != ctx[:-1]
        again = ~new
        spans = _arrow("h ctx uid at", _signed(mix(uid[again].view(np.uint64))), place[again] + size[again] + length,
                       uid[again], place[again] << 9 | _SPAN)
        uid, place, size, h, ctx, new_h = (x[new] for x in (uid, place, size, h, ctx, new_h))
        group = np.cumsum(new_h) - 1
        hot = np.bincount(group, minlength=1)[group] > HOT_CONTEXTS if len(h) else np.zeros(0, bool)
        key = np.where(hot, mix(h ^ (ctx * np.uint64(0x9E3779B97F4A7C15))), h)
        kept = _arrow("h ctx uid at", _signed(key), _signed(ctx), uid,
                      place << 9 | size << 2 | np.where(hot, _DEALT, _ANCHOR))
        marks = h[hot & new_h]
        mark = _arrow("h ctx uid at", _signed(marks), np.full(len(marks), _FIRST),
                      np.zeros(len(marks), np.int64), np.full(len(marks), _HOT, np.int64))
        yield from (b for b in (spans, kept, mark) if b.num_rows)

    def run(batches):
        for part in slices(batches):
            order = np.argsort(np.asarray(part.column(0)), kind="stable")
            part = part.take(pa.array(order))
            data, starts = bytes_of(part.column(1))
            uids = np.asarray(part.column(0))
            if len(data) <= SEGMENT_BYTES:
                yield from block(uids, data, starts, 0)
            else:
                for i in range(len(uids)):
                    own = data[starts[i]:starts[i + 1]]
                    for s in range(0, len(own), SEGMENT_BYTES):
                        piece = own[s:s + SEGMENT_BYTES + length - 1]
                        yield from block(uids[i:i + 1], piece, np.array([0, len(piece)]), s)

    return docs.select("uid", "text").mapInArrow(run, RUNS)


FOUND = "uid long, a long, b long, route long, kind int"


def meet_by_anchor(rows: DataFrame, length: int) -> DataFrame:
    """(uid, a, b, route, kind): spans [a, b) of kind 0, and contexts at ``a`` of
    ``b`` + 1 windows whose anchor has others (kind 1; 2 if it is hot).

    Rows come sorted by (h, ctx, uid, at), so groups of any size stream through.
    """
    def run(batches):
        last_h = last_ctx = None
        carry = None  # the last first-of-its-context row: (h, uid, at, sent, hot group)
        for batch in batches:
            if not batch.num_rows:
                continue
            h, ctx, uid, at = (np.asarray(batch.column(c)) for c in range(4))
            span = (at & 3) == _SPAN
            if span.any():
                yield _found(uid[span], at[span] >> 9, ctx[span], 0, 0)
                h, ctx, uid, at = (x[~span] for x in (h, ctx, uid, at))
            if not len(h):
                continue
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])
            new[0] = h[0] != last_h or ctx[0] != last_ctx
            last_h, last_ctx = h[-1], ctx[-1]
            again = ~new & ((at & 3) != _HOT)
            if again.any():
                start = at[again] >> 9
                yield _found(uid[again], start, start + (at[again] >> 2 & 127) + length, 0, 0)
            h, uid, at = h[new], uid[new], at[new]
            if not len(h):
                continue
            sent = np.zeros(len(h) + 1, bool)
            if carry is None:
                sent = sent[1:]
                hot_before = False
            else:
                h, uid, at = (np.append(c, x) for c, x in zip(carry, (h, uid, at)))
                sent[0], hot_before = carry[3], carry[4]
            kind = at & 3
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            shared = np.append(~first[1:], False) | ~first
            group = np.cumsum(first) - 1
            hot = (kind == _HOT)[first]
            hot[0] |= hot_before
            hot = hot[group]
            go = ((kind == _DEALT) | (kind == _ANCHOR) & shared) & ~sent
            if go.any():
                yield _found(uid[go], at[go] >> 9, at[go] >> 2 & 127, h[go],
                             np.where(hot[go] | (kind[go] == _DEALT), 2, 1))
            carry = (h[-1], uid[-1], at[-1], bool(go[-1] or sent[-1]), bool(hot[-1]))

    p = 2 * partitions(rows.sparkSession)
    return rows.repartition(p, "h").sortWithinPartitions("h", "ctx", "uid", "at").mapInArrow(run, FOUND)


def _found(uid, a, b, route, kind) -> pa.RecordBatch:
    n = len(uid)
    return _arrow("uid a b route kind", uid, a, b, np.broadcast_to(np.int64(route) if np.isscalar(route) else route, n).astype(np.int64),
                  np.broadcast_to(kind, n).astype(np.int32))


CONTEXTS = "route long, hot int, uid long, at long, bytes binary"


def fetch(found: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The bytes of the contexts, from their texts."""
    wanted = (found.where("kind > 0").groupBy("uid")
              .agg(F.collect_list(F.struct("a", "b", "route", "kind")).alias("own")))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                data, starts = bytes_of(part.column(1))
                raw = data.tobytes()
                rows = part.column(2)
                text = np.repeat(np.arange(len(rows)), np.asarray(rows.value_lengths()))
                flat = rows.flatten()
                a, b, route, kind = (np.asarray(flat.field(c)) for c in range(4))
                at = starts[text] + a
                cut = [raw[s:e] for s, e in zip(at.tolist(), (at + b + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(route), pa.array((kind == 2).astype(np.int32)), pa.array(np.asarray(part.column(0))[text]),
                     pa.array(a), pa.array(cut, pa.binary())], names=["route", "hot", "uid", "at", "bytes"])

    return (docs.select("uid", "text", "extra").hint("merge").join(wanted, "uid")
            .select("uid", "text", "own").mapInArrow(run, CONTEXTS))


def previous_factors(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, previous) of [n, length] byte windows in order of position.

    ``previous[p]`` is the nearest smaller position before p in suffix order if
    its longest common prefix with p has the full length, else -1. Equal windows
    stand in order of position, so that is p's neighbour, and no smaller one
    follows p: the longest previous factor of p reaches the full length exactly
    where ``previous[p] >= 0``.
    """
    n, length = windows.shape
    previous = np.full(n, -1)
    order = np.argsort(np.ascontiguousarray(windows).view(f"V{length}").ravel(), kind="stable")
    if n > 1:
        same = (windows[order[1:]] == windows[order[:-1]]).all(axis=1)
        previous[order[1:][same]] = order[:-1][same]
    return order, previous


MET = "w1 long, w2 long, uid long, a long, b long"


def suffix_arrays(contexts: DataFrame, length: int) -> DataFrame:
    """(w1, w2, uid, a, b): spans [a, b) of windows with an earlier equal one in
    their block, and, with ``b`` null, the other windows of hot anchors by hash."""
    def solve(rows: list[pa.RecordBatch], split: bool):
        table = pa.Table.from_batches(rows).sort_by([("uid", "ascending"), ("at", "ascending")]).combine_chunks()
        uid, at = np.asarray(table.column("uid")), np.asarray(table.column("at"))
        hot = np.asarray(table.column("hot")) > 0
        if split:
            hot[:] = True
        data, starts = bytes_of(table.column("bytes").combine_chunks().cast(pa.large_binary()))
        count = np.diff(starts) - length + 1
        ctx = np.repeat(np.arange(len(uid)), count)
        step = np.arange(len(ctx)) - np.repeat(np.cumsum(count) - count, count)
        place = starts[ctx] + step
        windows = np.lib.stride_tricks.sliding_window_view(data, length)[place]
        _, previous = previous_factors(windows)
        gone = previous >= 0
        edge = np.ones(len(ctx) + 1, bool)
        edge[1:-1] = (ctx[1:] != ctx[:-1]) | (gone[1:] != gone[:-1])
        lo, hi = np.flatnonzero(edge[:-1] & gone), np.flatnonzero(edge[1:] & gone)
        own = uid[ctx[lo]]
        yield _met(_signed(mix(own.view(np.uint64))), np.zeros(len(lo), np.int64), own, at[ctx[lo]] + step[lo],
                   pa.array(at[ctx[hi]] + step[hi] + length, pa.int64()))
        keep = np.flatnonzero(hot[ctx] & ~gone)
        if len(keep):
            roll = RollingHash(_BYTES[data])
            other = RollingHash(byte_table(77)[data])
            w1 = mix(roll.raw(place[keep], place[keep] + length))
            w2 = mix(other.raw(place[keep], place[keep] + length))
            yield _met(_signed(w1), _signed(w2), uid[ctx[keep]], at[ctx[keep]] + step[keep],
                       pa.nulls(len(keep), pa.int64()))

    def run(batches):
        held: list[pa.RecordBatch] = []
        n, split = 0, None  # split: the route of which a part has gone before
        for batch in batches:
            for i in range(0, batch.num_rows, ARRAY_CONTEXTS):
                part = batch.slice(i, ARRAY_CONTEXTS)
                held.append(part)
                n += part.num_rows
                if n < ARRAY_CONTEXTS:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                route = np.asarray(table.column("route"))
                cut = int(np.searchsorted(route, route[-1], "left"))
                if cut:
                    yield from solve(table.slice(0, cut).to_batches(), bool(route[0] == split))
                    held = table.slice(cut).to_batches()
                    split = None if route[-1] != split else split
                else:  # one route fills the block: its parts meet by window
                    yield from solve(table.to_batches(), True)
                    held, split = [], route[-1]
                n = sum(b.num_rows for b in held)
        if n:
            yield from solve(held, np.asarray(held[0].column(0))[0] == split)

    p = 2 * partitions(contexts.sparkSession)
    return contexts.repartition(p, "route").sortWithinPartitions("route", "uid", "at").mapInArrow(run, MET)


def _met(w1, w2, uid, a, b: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array(uid), pa.array(a), b],
                                      names=["w1", "w2", "uid", "a", "b"])


def meet_by_window(rows: DataFrame, length: int) -> DataFrame:
    """All spans (uid, a, b): windows that are not the first of their hash
    become spans. Rows stream in order of (w1, w2, uid, a)."""
    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            w1, w2, uid, a = (np.asarray(batch.column(c)) for c in range(4))
            window = np.asarray(batch.column(4).is_null())
            b = np.asarray(batch.column(4).fill_null(0))
            spans = ~window
            if spans.any():
                yield _arrow("uid a b", uid[spans], a[spans], b[spans])
            w1, w2, uid, a = (x[window] for x in (w1, w2, uid, a))
            if not len(w1):
                continue
            again = np.zeros(len(w1), bool)
            again[1:] = (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])
            again[0] = last == (w1[0], w2[0])
            last = (w1[-1], w2[-1])
            if again.any():
                yield _arrow("uid a b", uid[again], a[again], a[again] + length)

    p = 2 * partitions(rows.sparkSession)
    return rows.repartition(p, "w1", "w2").sortWithinPartitions("w1", "w2", "uid", "a").mapInArrow(
        run, "uid long, a long, b long")


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the intervals [a, b): maximal runs in order."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    at = np.flatnonzero(new)
    return a[at], b[np.append(at[1:], len(a)) - 1]


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, text, extra): ``extra`` has all columns but the text. ``uid`` is the
    id where ids are unique and none is null; else rows are numbered in order of
    id (null first) and text, equal rows in any order."""
    others = [c for c in docs.columns if c != text_col]
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("uid"),
                      F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
                      F.struct(*[F.col(f"`{c}`") for c in others]).alias("extra"))
    odd = (docs.select(F.col(f"`{id_col}`").cast("long").alias("id")).groupBy("id").count()
           .where("count > 1 or id is null").limit(1).count())
    if not odd:
        return src.where("uid is not null")
    src = src.withColumn("tie", F.xxhash64("text"))
    return (dense_ordinal(src, None, [F.col("uid").asc_nulls_first(), F.col("tie")], name="n")
            .select(F.col("n").alias("uid"), "text", "extra"))


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Removed spans [a, b) of numbered texts (uid, text), not yet merged."""
    found = write_read(meet_by_anchor(run_rows(docs, length), length), "anchors")
    late = meet_by_window(suffix_arrays(fetch(found, docs, length), length), length)
    return found.where("kind = 0").select("uid", "a", "b").union(late)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   as_text: bool = False) -> DataFrame:
    """(extra, n_bytes, starts, ends, kept): all rows, with the removed byte
    spans and the kept bytes, or with ``as_text`` the kept text, without the
    characters that a cut has broken.

    Null texts count as empty. Texts below ``length`` bytes stay as they are.
    Of rows that repeat an id each counts as a document of its own, in order of
    their texts. An empty table gives an empty result.
    """
    src = numbered(docs, id_col, text_col)
    own = spans(src, length).groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("own"))
    joined = src.hint("merge").join(own, "uid", "left").select("extra", "text", "own")
    extra = joined.schema["extra"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sizes, starts, ends, kept = [], [], [], []
                for text, own in zip(part.column(1), part.column(2)):
                    raw = text.as_buffer().to_pybytes()
                    sizes.append(len(raw))
                    if own.is_valid:
                        flat = own.values
                        a, b = merged(np.asarray(flat.field(0)), np.asarray(flat.field(1)))
                    else:
                        a = b = np.zeros(0, np.int64)
                    starts.append(a)
                    ends.append(b)
                    edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(raw)]
                    rest = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
                    kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(starts, pa.list_(pa.int64())),
                     pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.string() if as_text else pa.binary())],
                    names=["extra", "n_bytes", "starts", "ends", "kept"])

    kind = "string" if as_text else "binary"
    return joined.mapInArrow(run, f"extra {extra}, n_bytes long, starts array<long>, ends array<long>, kept {kind}")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select(F.col("extra.doc_id").cast("long").alias("doc_id"), "n_bytes",
                      (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                      F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
