"""MinHash near-dedup with an LSH forest.

Each document's set of word shingles has a signature of MINHASHES minima. The
forest sorts the distinct sets by TREES signature orders (rotations of the
signature); documents that share the first DEPTH minima of an order are a
region. Within a region the longest-common-prefix neighbours are compared by
their signatures: a region of more than REGION documents is read deeper, minimum
by minimum, until its parts are small. A region yields a spanning set of its
likely links, so their number grows with its documents, not with their pairs.
All links are confirmed on the full sets; components come from confirmed links.

What the spanning sets leave out is compared afterwards. Regions of more than
REGION rows, and those that a range border cuts, are joined tile by tile on the
whole signatures. All that likely links connect is a family; in each family that
the confirmed links leave in several components, every two sets of different
components are compared in full, tile by tile.

Two sets of similarity s share a region with probability 1 - (1 - s^2)^16:
all but two in a million at 0.75.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import bytes_of, id_text, mix, partitions, read, slices, write_read
from trellis.llm.components import components, spanning_links
from trellis.llm.shingles import minhashes, shingle_sets, similar

MINHASHES = 32
TREES = 16
DEPTH = 2
REGION = 256
#: Signatures that agree in fewer of MINHASHES places are no candidates: of two
#: sets of similarity 0.75 fewer than one pair in 10,000 agrees in so few.
AGREE = 14
PERCENT = 75
#: Spokes of one hub that are confirmed together; a larger hub is dealt in parts.
SPOKES = 200
#: Rows of one side of a tile, by signatures and by full sets.
SIGNATURE_TILE = 2048
SET_TILE = 256
#: Shingles that one matrix product of a tile holds.
SHINGLE_COLUMNS = 4096

SIGNATURES = "doc_id long, n_shingles long, s1 long, s2 long, sig binary"


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, sig): set size, 128-bit set hash, minima."""
    def run(batches):
        for part in slices(batches):
            sets = shingle_sets(*bytes_of(part.column(1)))
            sig = minhashes(sets, MINHASHES)
            s1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            s2 = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1), pa.array(s2),
                 pa.array([r.tobytes() for r in sig], pa.binary())], names=["doc_id", "n_shingles", "s1", "s2", "sig"])

    return docs.mapInArrow(run, SIGNATURES)


def tree_rows(sets: DataFrame) -> DataFrame:
    """(region, suffix, doc_id, sig) of each set in each tree: ``region`` is the
    hash of the tree and its first DEPTH minima, ``suffix`` the first two minima
    behind them, in the order of the tree."""
    def run(batches):
        step = MINHASHES // TREES
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, MINHASHES)
            short = pa.array([r.tobytes() for r in (sig & 0xFFFF).astype(np.uint16)], pa.binary())
            for t in range(TREES):
                order = np.roll(sig, -t * step, axis=1).astype(np.uint64)
                region = mix(order[:, 0] << np.uint64(32) | order[:, 1]) + np.uint64(t)
                suffix = order[:, 2] << np.uint64(31) | order[:, 3] >> np.uint64(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix(region).view(np.int64)), pa.array(suffix.view(np.int64)), batch.column(0), short,
                     pa.array(np.full(batch.num_rows, t, np.int32))],
                    names=["region", "suffix", "doc_id", "sig", "tree"])

    return sets.select("doc_id", "sig").mapInArrow(run, "region long, suffix long, doc_id long, sig binary, tree int")


def region_links(ids: np.ndarray, sig: np.ndarray, depth: int) -> Iterator[tuple[int, int]]:
    """A spanning set of the likely links of one region.

    ``sig`` is in the order of the region's tree. Pairs whose signatures agree
    most come first (Kruskal), so each part that likely links connect is spanned
    by its strongest ones; the smallest document of each part is linked with all
    that agree with it as well.
    """
    if len(ids) > REGION:
        if depth < sig.shape[1]:
            order = np.lexsort((ids, sig[:, depth]))
            ids, sig = ids[order], sig[order]
            cuts = np.flatnonzero(np.diff(sig[:, depth].astype(np.int64))) + 1
            parts = np.split(np.arange(len(ids)), cuts)
            for p in parts:
                yield from region_links(ids[p], sig[p], depth + 1)
        else:  # equal signatures: neighbours in id order
            order = np.argsort(ids)
            ids, sig = ids[order], sig[order]
            parts = [np.arange(i, min(i + REGION, len(ids))) for i in range(0, len(ids), REGION)]
            for p in parts:
                yield from region_links(ids[p], sig[p], depth)
        # the parts' smallest documents and their longest-common-prefix neighbours
        heads = np.array([p[np.argmin(ids[p])] for p in parts])
        for i in range(len(heads) - 1):
            if (sig[heads[i]] == sig[heads[i + 1]]).sum() >= AGREE:
                yield int(ids[heads[i]]), int(ids[heads[i + 1]])
        top = heads[np.argmin(ids[heads])]
        good = heads[((sig[heads] == sig[top]).sum(axis=1) >= AGREE) & (heads != top)]
        yield from ((int(ids[top]), int(ids[g])) for g in good)
        return
    order = np.argsort(ids, kind="stable")
    ids, sig = ids[order], sig[order]
    n = len(ids)
    rows, cols, agree = [], [], []
    for i in range(n - 1):
        same = (sig[i + 1:] == sig[i]).sum(axis=1)
        near = np.flatnonzero(same >= AGREE)
        rows.append(np.full(len(near), i))
        cols.append(near + i + 1)
        agree.append(same[near])
    if not rows:
        return
    a, b, w = np.concatenate(rows), np.concatenate(cols), np.concatenate(agree)
    parent = list(range(n))

    def top_of(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    chosen = set()
    for k in np.lexsort((b, a, -w)):
        x, y = top_of(a[k]), top_of(b[k])
        if x != y:
            parent[max(x, y)] = min(x, y)
            chosen.add((int(a[k]), int(b[k])))
    for k in range(len(a)):
        if top_of(a[k]) == a[k]:
            chosen.add((int(a[k]), int(b[k])))
    for i, j in chosen:
        if ids[i] != ids[j]:
            yield int(ids[i]), int(ids[j])


def candidates(sets: DataFrame) -> DataFrame:
    """Distinct candidate links (a < b) of ``sets`` (doc_id, sig), and a row of
    ``region`` alone for each region whose links may be incomplete: of more than
    REGION rows, or first or last in a range of the forest, whose border may cut it."""
    rows = tree_rows(sets)
    # a range of the sorted forest per task: a region that is hot spans several,
    # which reads it deeper there, and no task holds more than its range
    order = rows.repartitionByRange(partitions(rows.sparkSession) * 2, "region", "suffix", "doc_id")
    order = order.sortWithinPartitions("region", "suffix", "doc_id")

    def run(batches):
        step = MINHASHES // TREES
        ids, sigs, region, tree = [], [], None, 0

        def flush():
            if len(ids) < 2:
                return [], []
            sig = np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, MINHASHES)
            pairs = set(region_links(np.array(ids), np.roll(sig, -tree * step, axis=1), DEPTH))
            return [min(p) for p in pairs], [max(p) for p in pairs]

        first, large = None, set()
        for batch in batches:
            a, b = [], []
            regions = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(regions[1:] != regions[:-1]) + 1), len(regions)]
            all_ids, all_sigs, trees = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                # a region of far more rows is linked in runs of neighbours that overlap in one
                if regions[lo] != region or len(ids) > 64 * REGION:
                    if len(ids) > REGION:
                        large.add(int(region))
                    x, y = flush()
                    a += x
                    b += y
                    keep = regions[lo] == region
                    ids, sigs = (ids[-1:], sigs[-1:]) if keep else ([], [])
                    region, tree = regions[lo], trees[lo].as_py()
                    first = region if first is None else first
                ids += all_ids[lo:hi]
                sigs += all_sigs[lo:hi]
            yield marked(a, b, [None] * len(a))
        a, b = flush()
        yield marked(a, b, [None] * len(a))
        if region is not None:
            open_ = sorted(large | {int(first), int(region)})
            yield marked([None] * len(open_), [None] * len(open_), open_)

    def marked(a, b, open_):
        links = _links(a, b)
        return pa.RecordBatch.from_arrays([*links.columns, pa.array(open_, pa.int64())], names=["a", "b", "region"])

    return order.mapInArrow(run, "a long, b long, region long").distinct()


def _links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def tiles(members: DataFrame, size: int) -> DataFrame:
    """(t, u, own) and the columns of ``members`` (grp, id, label, ..), once for
    each tile: every two members of a group with different labels meet in one.

    A group's most frequent label is dealt into tiles of its own that do not
    meet each other, so one large component with few others makes few rows.
    """
    labels = members.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
    groups = labels.groupBy("grp").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n")).where("n > top.n")
    groups = groups.select("grp", F.col("top.label").alias("most"), F.ceil(F.col("top.n") / size).alias("n_most"),
                           F.ceil((F.col("n") - F.col("top.n")) / size).alias("n_rest"))
    rows = members.join(groups, "grp")
    most, deal = F.col("label") == F.col("most"), F.xxhash64("id")
    rows = rows.withColumn("tile", F.when(most, F.col("n_rest") + F.pmod(deal, "n_most")).otherwise(F.pmod(deal, "n_rest")))
    others = F.sequence(F.lit(0).cast("long"), F.col("n_rest") + F.when(most, 0).otherwise(F.col("n_most")) - 1)
    rows = rows.withColumn("other", F.explode(others))
    return rows.select(F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"),
                       (F.col("tile") == F.least("tile", "other")).alias("own"), *members.columns)


def tile_links(tiled: DataFrame, load: Callable, near: Callable) -> DataFrame:
    """Links (a < b) that join what ``near`` finds in each tile of ``tiled``
    (t, u, own, grp, id, label, text): of the pairs of different labels, as many
    as connect the same. ``load`` reads a column ``text``; ``near`` gives the
    matrix of two lists of what it read."""
    rows = tiled.repartition(2 * partitions(tiled.sparkSession), "grp", "t", "u").sortWithinPartitions("grp", "t", "u")
    rows = rows.select("grp", "t", "u", "own", "id", "label", "text")

    def run(batches):
        key, ids, labels, own, items = None, [], [], [], []

        def flush():
            a, b = [], []
            if key is not None:
                at, comp = np.array(ids), np.unique(np.array(labels), return_inverse=True)[1]
                left = np.flatnonzero(own)
                right = np.arange(len(at)) if key[1] == key[2] else np.flatnonzero(~np.array(own))
                if len(left) and len(right) and comp.any():
                    hits = near([items[i] for i in left], [items[j] for j in right])
                    for i, row in zip(left, hits):
                        js = right[row]
                        while len(js := js[comp[js] != comp[i]]):
                            comp[comp == comp[js[0]]] = comp[i]
                            a.append(int(min(at[i], at[js[0]])))
                            b.append(int(max(at[i], at[js[0]])))
            return _links(a, b)

        for part in slices(batches):
            read_ = load(part.column(6))
            for i, row in enumerate(zip(*(part.column(c).to_pylist() for c in range(6)))):
                if row[:3] != key:
                    yield flush()
                    key, ids, labels, own, items = row[:3], [], [], [], []
                own.append(row[3])
                ids.append(row[4])
                labels.append(row[5])
                items.append(read_[i])
        yield flush()

    return rows.mapInArrow(run, "a long, b long")


def _signatures_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def _likely(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Rows of which of ``right`` agree with each of ``left`` in AGREE places."""
    right = np.stack(right)
    return ((right == x).sum(axis=1) >= AGREE for x in left)


def _similar(percent: int) -> Callable:
    def near(left, right):
        """Whether 100 * |both| >= percent * |either|, from products of 0/1 matrices."""
        size = [np.array([len(s) for s in side]) for side in (left, right)]
        value = [np.concatenate(side) for side in (left, right)]
        shared = np.intersect1d(*value)
        row, column = [], []
        for v, n in zip(value, size):
            at = np.minimum(np.searchsorted(shared, v), max(len(shared) - 1, 0))
            hit = shared[at] == v if len(shared) else np.zeros(len(v), bool)
            row.append(np.repeat(np.arange(len(n)), n)[hit])
            column.append(at[hit])
        both = np.zeros((len(left), len(right)), np.int64)
        order = [np.argsort(c, kind="stable") for c in column]
        row, column = [r[o] for r, o in zip(row, order)], [c[o] for c, o in zip(column, order)]
        for start in range(0, len(shared), SHINGLE_COLUMNS):
            block = []
            for r, c, n in zip(row, column, size):
                lo, hi = np.searchsorted(c, [start, start + SHINGLE_COLUMNS])
                dense = np.zeros((len(n), min(SHINGLE_COLUMNS, len(shared) - start)), np.float32)
                dense[r[lo:hi], c[lo:hi] - start] = 1
                block.append(dense)
            both += (block[0] @ block[1].T).astype(np.int64)
        return (100 * both >= percent * (size[0][:, None] + size[1] - both)) & (both > 0)

    return near


def labelled(ids: DataFrame, found: DataFrame) -> DataFrame:
    """``ids`` with each id's component in ``found``, or itself, as its label."""
    return (ids.join(found.withColumnRenamed("component", "label"), "id", "left")
            .withColumn("label", F.coalesce("label", "id")))


def open_links(sets: DataFrame, regions: DataFrame, found: DataFrame) -> DataFrame:
    """Likely links in whole ``regions`` between the components ``found``."""
    rows = tree_rows(sets).join(regions, "region", "left_semi")
    rows = rows.select(F.col("region").alias("grp"), F.col("doc_id").alias("id"), F.col("sig").alias("text"))
    rows = write_read(labelled(rows, found), "open-regions")
    return tile_links(tiles(rows, SIGNATURE_TILE), _signatures_of, _likely).distinct()


def ends(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("id")).union(links.select("b"))


def contracted(links: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct links (a, b) of the labels of ``links``' ends, where they differ."""
    for end in ("a", "b"):
        other = "b" if end == "a" else "a"
        links = labelled(links.select(F.col(end).alias("id"), other), found).select(F.col("label").alias(end), other)
    return links.where("a != b").distinct()


def family_links(likely: DataFrame, more: DataFrame, found: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between the components ``found`` of each family that
    ``likely`` and ``more`` links connect. A family of two whose link is not
    among ``more`` was confirmed or refused before."""
    both = likely.union(more)
    family = components(spanning_links(contracted(both, found))).select(F.col("id").alias("label"), F.col("component").alias("grp"))
    members = labelled(ends(both).distinct(), found).join(family, "label").select("grp", "id", "label")
    members = write_read(members, "families")
    new = ends(more).distinct().withColumn("new", F.lit(1))
    open_ = (members.join(new, "id", "left").groupBy("grp")
             .agg(F.count(F.lit(1)).alias("n"), F.count("new").alias("new")).where("n > 2 or new > 0").select("grp"))
    tiled = write_read(tiles(members.join(open_, "grp", "left_semi"), SET_TILE), "family-tiles")
    # the texts of the families only, then once for each tile
    ids = tiled.select(F.col("id").alias("doc_id")).distinct()
    texts = write_read(docs.join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text"), "family-texts")
    return tile_links(tiled.join(texts, "id"), lambda c: shingle_sets(*bytes_of(c)), _similar(percent))


def confirm(links: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``links`` (a, b) whose full sets are similar. The smaller end is
    the hub: its text meets the texts of up to SPOKES others at once."""
    degree = links.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SPOKES).alias("parts"))
    dealt = links.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    dealt = write_read(dealt, "dealt")
    hubs = dealt.select("a", "part").distinct()
    need = (dealt.select(F.col("b").alias("doc_id"), "a", "part", F.lit(1).alias("spoke"))
            .union(hubs.select(F.col("a").alias("doc_id"), "a", "part", F.lit(0).alias("spoke"))))
    # texts always move by a merge join, however few links there are
    texts = need.join(docs.hint("merge"), "doc_id").select("a", "part", "spoke", "doc_id", "text")
    texts = texts.repartition(partitions(links.sparkSession) * 2, "a", "part").sortWithinPartitions("a", "part", "spoke")

    def run(batches):
        hub, key = [], None
        for part in slices(batches):
            sets = shingle_sets(*bytes_of(part.column(4)))
            a, b = [], []
            for i, (x, p, spoke, doc_id) in enumerate(zip(*(part.column(c).to_pylist() for c in range(4)))):
                if (x, p) != key:
                    key, hub = (x, p), []
                if not spoke:
                    hub.append(sets[i])
                elif any(similar(h, sets[i], percent) for h in hub):
                    a.append(x)
                    b.append(doc_id)
            yield _links(a, b)

    return texts.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    ``component_id`` is the smallest id reachable over links of
    100 * |intersection| >= ``percent`` * |union|; ``kept`` marks that document.
    Null or empty texts, and texts without words, have no shingles and no links.
    Equal sets are one class: its copies are not compared. Rows that repeat an
    id count as one document: they share the component (and are linked if any
    of their texts is). Rows with a null id have a null component and are kept;
    an empty table gives an empty result.
    """
    src = id_text(docs, id_col, text_col)
    sig = write_read(signatures(src), "signatures")
    full = sig.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = write_read(full.groupBy("s1", "s2", F.col("n_shingles").alias("n"))
                         .agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "sig")).getField("sig").alias("sig")),
                         "classes")
    sets, texts = classes.select(F.col("rep").alias("doc_id"), "sig"), src.where(F.col("doc_id").isNotNull())
    both = write_read(candidates(sets), "candidates")
    likely, regions = both.where("region is null").select("a", "b"), both.where("region is not null").select("region").distinct()
    sure = write_read(confirm(likely, texts, percent), "confirmed")
    found = components(spanning_links(sure))
    more = write_read(open_links(sets, regions, found), "open-links")
    rest = write_read(family_links(likely, more, found, texts, percent), "family-links")
    found = write_read(found, "components")
    joined = components(spanning_links(contracted(rest, found))).select(F.col("id").alias("label"), "component")
    found = (labelled(ends(sure).union(ends(rest)).distinct(), found).join(joined, "label", "left")
             .select("id", F.coalesce("component", "label").alias("component")))
    slim = sig.select("doc_id", "n_shingles", "s1", "s2")
    reps = slim.join(classes.select("s1", "s2", F.col("n").alias("n_shingles"), "rep"),
                     ["s1", "s2", "n_shingles"], "left")
    # rows of one id in several classes: all are part of the same component
    out = reps.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
