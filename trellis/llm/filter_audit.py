"""Filter interaction audit: what each filter of an ordered chain removes.

The table is cut into blocks: runs of one part's rows in id order. A block keeps a
sorted posting list for each filter (the rows that fail it, by their place in the
block) and for each label. Unions and differences of the lists are made by galloping
k-way merges, block by block, and only their sizes go on: summed over the blocks they
say what a filter removes behind each set of other filters, and so in each order.

Null texts count as empty, null parts as ''. Every row counts, also rows that repeat
an id; a row of null id never copies another, no other copies it, and it has no labels. A text is
labelled where any of the label rows of its id says so. An empty table has no parts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import read, slices, write_read

FILTERS = "ABCDE"
#: Rows of a block: the longest run that one set of posting lists covers.
BLOCK_ROWS = 1 << 15

#: Capitals and special characters of filters C and D.
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPECIAL = re.compile(rb"[#$%&*|]")

_LISTS = [*FILTERS, "good", "toxic"]
BLOCKS = "part string, n long, ids array<long>, " + ", ".join(f"`{x}` array<int>" for x in _LISTS)


# posting lists

def gallop(a: list[int], x: int, lo: int) -> int:
    """The first place from ``lo`` on whose value is at least ``x``: steps double
    until they pass it, a binary search ends in the last step."""
    hi, step, n = lo, 1, len(a)
    while hi < n and a[hi] < x:
        lo = hi + 1
        hi += step
        step *= 2
    return bisect_left(a, x, lo, min(hi, n))


def union(lists: list[list[int]]) -> list[int]:
    """The sorted union of sorted lists: the run of the list with the least head,
    up to the next list's head, goes over at once."""
    heads = [[a, 0] for a in lists if a]
    out: list[int] = []
    while heads:
        first = min(heads, key=lambda h: h[0][h[1]])
        a, i = first
        others = [h[0][h[1]] for h in heads if h is not first]
        # an equal head of another list is taken from there
        first[1] = gallop(a, min(others), i) if others else len(a)
        out += a[i:first[1]]
        first[1] += first[1] == i
        heads = [h for h in heads if h[1] < len(h[0])]
    return out


def difference(a: list[int], others: list[list[int]]) -> list[int]:
    """What of ``a`` is in none of the other sorted lists."""
    at = [0] * len(others)
    out: list[int] = []
    i = 0
    while i < len(a):
        x, stop = a[i], None
        for j, b in enumerate(others):
            at[j] = p = gallop(b, x, at[j])
            if p < len(b) and (stop is None or b[p] < stop):
                stop = b[p]
        if stop is None:
            return out + a[i:]
        if stop == x:
            i += 1
        else:
            end = gallop(a, stop, i)
            out += a[i:end]
            i = end
    return out


def common_size(a: list[int], b: list[int]) -> int:
    """How many values two sorted lists share."""
    if len(a) > len(b):
        a, b = b, a
    n = p = 0
    for x in a:
        p = gallop(b, x, p)
        if p == len(b):
            break
        n += b[p] == x
    return n


def block_sizes(n: int, lists: dict[str, list[int]]) -> list[tuple]:
    """(filter, before, kept, removed, good_lost, toxic_lost, fails) of one block:
    for each filter behind each set of other filters (bits of ``before``)."""
    out = []
    unions = [len(union([lists[f] for i, f in enumerate(FILTERS) if s >> i & 1])) for s in range(1 << len(FILTERS))]
    for k, f in enumerate(FILTERS):
        for s in range(1 << len(FILTERS)):
            if s >> k & 1:
                continue
            lost = difference(lists[f], [lists[g] for i, g in enumerate(FILTERS) if s >> i & 1])
            out.append((k, s, n - unions[s | 1 << k], len(lost), common_size(lost, lists["good"]),
                        common_size(lost, lists["toxic"]), len(lists[f])))
    return out


# jobs

def _judge(batches):
    """Filters A to D of whole texts, as bits, and a digest of the text for E."""
    for whole in batches:
        for batch in slices(iter([whole])):
            texts = batch.column(2)
            bits, digests = [], []
            for raw, chars in zip(texts.cast(pa.binary()).to_pylist(), pc.utf8_length(texts).to_pylist()):
                words = raw.split()  # of bytes: at \x20 and \x09-\x0D alone
                capitals = len(raw) - len(raw.translate(None, _CAPITALS))
                bits.append((len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1
                            | (100 * capitals > 10 * chars) << 2 | bool(_SPECIAL.search(raw)) << 3)
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())],
                names=["doc_id", "part", "bits", "digest"])


def judged(docs: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, bits): the filters that each row fails, bit i for FILTERS[i]."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                      F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                      F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = write_read(src.mapInArrow(_judge, "doc_id long, part string, bits int, digest binary"), "audit-bits")
    # copies: one row for each text that has several ids, summed before the shuffle
    first = (rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
             .where(F.col("first") < F.col("last")).select("digest", "first"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(first, "digest", "left").select(
        "doc_id", "part", F.col("bits").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("bits"))


def posting_lists(rows: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of the audit: for a run of one part's rows in id order, the ids and the
    places of the rows that fail each filter, are good, are toxic."""
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 32).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 64).otherwise(0)).alias("toxic"))
    bits = F.col("bits") + F.coalesce(F.col("good"), F.lit(0)) + F.coalesce(F.col("toxic"), F.lit(0))
    ordered = (rows.join(marked, "doc_id", "left").select("part", "doc_id", bits.alias("bits"))
               .repartitionByRange("part", "doc_id", "bits").sortWithinPartitions("part", "doc_id", "bits"))

    def block(part, ids, bits):
        lists = [[i for i, b in enumerate(bits) if b >> j & 1] for j in range(len(_LISTS))]
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.string()), pa.array([len(ids)], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
             *[pa.array([x], pa.list_(pa.int32())) for x in lists]], names=["part", "n", "ids", *_LISTS])

    def cut(batches):
        part, ids, bits = None, [], []
        for batch in batches:
            for p, i, b in zip(*[c.to_pylist() for c in batch.columns]):
                if ids and (p != part or len(ids) == block_rows):
                    yield block(part, ids, bits)
                    ids, bits = [], []
                part = p
                ids.append(i)
                bits.append(b)
        if ids:
            yield block(part, ids, bits)

    return ordered.mapInArrow(cut, BLOCKS)


def interactions(blocks: DataFrame) -> DataFrame:
    """(part, filter, before, kept, removed, good_lost, toxic_lost, fails) summed over
    the blocks: 80 rows a part."""
    sums = ["kept", "removed", "good_lost", "toxic_lost", "fails"]

    def sizes(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                cols = list(zip(*block_sizes(row["n"], {x: row[x] for x in _LISTS})))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(cols[0])), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()),
                     *[pa.array(c, pa.int64()) for c in cols[2:]]], names=["part", "filter", "before", *sums])

    return (blocks.drop("ids").mapInArrow(sizes, "part string, filter int, before int, " + ", ".join(f"{s} long" for s in sums))
            .groupBy("part", "filter", "before").agg(*[F.sum(s).alias(s) for s in sums]))


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id",
          text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each part, order of the filters and step in it (see op11)."""
    blocks = write_read(posting_lists(judged(docs, part_col, id_col, text_col), labels, block_rows), "audit-blocks")
    sums = write_read(interactions(blocks), "audit-sums")
    weights = [factorial(n) * factorial(len(FILTERS) - 1 - n) for n in range(len(FILTERS))]
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.bit_count("before") + 1)
    # once a part and filter: its share over all orders, and what no other filter takes
    alone = sums.groupBy("part", "filter").agg(
        F.sum(weight * F.col("removed")).alias("shapley"),
        F.max(F.when(F.col("before") == 31 - F.pow(F.lit(2), F.col("filter")).cast("int"),
                     F.col("removed"))).alias("unique_fails"))
    steps = [("".join(o), step + 1, FILTERS.index(f), sum(1 << FILTERS.index(g) for g in o[:step]))
             for o in permutations(FILTERS) for step, f in enumerate(o)]
    # 600 rows of two numbers and two short strings, whatever the table
    orders = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, before int")
    return (sums.join(alone, ["part", "filter"]).join(F.broadcast(orders), ["filter", "before"])
            .select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
                    "unique_fails", "good_lost", "toxic_lost", "shapley"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first AS (SELECT t, min(doc_id) AS first FROM words GROUP BY t),
marked AS (SELECT doc_id, coalesce(max(quality), 0) = 1 AS good, coalesce(max(toxic), 0) = 1 AS toxic FROM labels GROUP BY doc_id),
rows AS (
  SELECT part, [len(w) < 100, 100 * list_unique(w) < 80 * len(w),
                100 * length(regexp_replace(words.t, '[^A-Z]', '', 'g')) > 10 * length(words.t),
                regexp_matches(words.t, '[#$%&*|]'), coalesce(words.doc_id > first, false)] AS fails,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM words JOIN first ON words.t = first.t LEFT JOIN marked ON words.doc_id = marked.doc_id),
masks AS (
  SELECT part, list_sum([CASE WHEN fails[i] THEN 1 << (i - 1) ELSE 0 END FOR i IN range(1, 6)])::INT AS mask, good, toxic FROM rows),
counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, step::INT AS step, filter_order[step] AS f, (1 << (ascii(filter_order[step]) - 65))::INT AS bit,
         list_sum([0] || [1 << (ascii(filter_order[i]) - 65) FOR i IN range(1, step)])::INT AS before
  FROM orders, unnest(range(1, 6)) AS s(step)),
found AS (
  SELECT part, filter_order, step, f,
         sum(n) FILTER (mask & (before | bit) = 0) AS kept,
         sum(n) FILTER (mask & bit > 0 AND mask & before = 0) AS removed,
         sum(n) FILTER (mask & bit > 0 AND mask & before > 0) AS redundant,
         sum(n) FILTER (mask = bit) AS unique_fails,
         sum(counts.good) FILTER (mask & bit > 0 AND mask & before = 0) AS good_lost,
         sum(counts.toxic) FILTER (mask & bit > 0 AND mask & before = 0) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM found
"""
