"""Connected components of a link table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import pyarrow as pa

from trellis.llm.common import write_read

#: Links that one task reduces at once.
FOREST_LINKS = 500_000


def spanning_links(links: DataFrame, part: int = FOREST_LINKS) -> DataFrame:
    """Pairs (a < b) that connect the same as ``links``, most of their cycles gone: links
    go by their end's smallest neighbour, so a family meets in one task (a large one in
    several), which puts its trees together by union-find and pairs each id with the
    smallest of its tree. A task's memory follows its own links."""
    pairs = links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = write_read(pairs, "pairs")
    both = pairs.union(pairs.select("b", "a"))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    keyed = write_read(pairs.join(low, "a").select("a", "b", "low"), "keyed")
    size = keyed.groupBy("low").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts")).where("parts > 1")
    deal = F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1)))
    dealt = keyed.join(size, "low", "left").select("a", "b", "low", deal.alias("part")).repartition("low", "part")

    def run(batches):
        parent: dict = {}

        def top(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
        ids = list(parent)
        for start in range(0, len(ids), 100_000):
            rows = [(t, x) for x in ids[start:start + 100_000] if (t := top(x)) != x]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], names=["a", "b"])

    return dealt.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of ``links`` (a, b; of any type that can be
    ordered): the smallest id reachable. Each round takes the smallest label of a
    node and its neighbours, then follows labels once (pointer jumping), until
    nothing changes. Tables are written between rounds; nothing is collected but
    a count. No links give an empty result.
    """
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = both.union(both.select("y", "x")).where("x != y").distinct()
    both = write_read(both, "links")
    labels = write_read(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l"))
                        .select(F.col("x").alias("id"), "l"), "labels")
    while True:
        near = (both.join(labels.select(F.col("id").alias("y"), "l"), "y")
                .groupBy("x").agg(F.min("l").alias("m")))
        near = write_read(labels.join(near, labels.id == near.x).select("id", "l", F.least("l", "m").alias("m")), "near")
        up = near.select(F.col("id").alias("m"), F.col("m").alias("top"))
        jumped = write_read(near.join(up, "m").select("id", F.col("l").alias("old"), F.least("m", "top").alias("l")), "labels")
        changed = jumped.where("l != old").limit(1).count()
        labels = jumped.select("id", "l")
        if not changed:
            return labels.select("id", F.col("l").alias("component"))
