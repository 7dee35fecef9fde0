"""Line dedup: a segment-partition edit join of all distinct lines.

Two lines are linked if their edit distance is at most the smaller line's
threshold: one edit for each CHARS_PER_EDIT characters, MAX_EDITS at most. The
smaller line is split into threshold + 1 even segments; by the pigeonhole
principle one of them stands unchanged in the other line, near its own place.
Segments are indexed by (line length, number, text); each line probes the
lengths up to MAX_EDITS below its own with the few substrings that can match in
place. Candidates are verified by banded bit-parallel edit distance. All of it
is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import read, write_read
from trellis.llm.components import components
from trellis.llm.repeats import numbered

MAX_EDITS = 2
CHARS_PER_EDIT = 64
#: Letters whose counts (modulo 16) bound the distance from below.
LETTERS = "entriaoshdlucmgw"
#: The counts are taken of lines whose first or last END_CHARS characters more
#: than COMMON_ENDS distinct lines share; other lines have few candidates.
END_CHARS = 32
COMMON_ENDS = 8


def threshold(length: Column, max_edits: int = MAX_EDITS, chars: int = CHARS_PER_EDIT) -> Column:
    return F.least(F.floor(length / chars), F.lit(max_edits)).cast("int")


def lines_of(docs: DataFrame) -> DataFrame:
    """(uid, pos, line) of all lines with anything but white space."""
    return (docs.select("uid", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .where(F.col("line").rlike(r"\S")))


def letter_counts(line: str) -> Column:
    """Counts of LETTERS, four bits each."""
    n = F.length(line)
    counts = [F.shiftleft(((n - F.length(F.replace(F.col(line), F.lit(c), F.lit("")))) % 16).cast("bigint"), 4 * i)
              for i, c in enumerate(LETTERS)]
    out = counts[0]
    for c in counts[1:]:
        out = out.bitwiseOR(c)
    return out


def count_distance(a: Column, b: Column) -> Column:
    """Sum of the differences of two lines' letter counts, from below; null if
    either has no counts."""
    out = F.lit(0).cast("bigint")
    for i in range(len(LETTERS)):
        low = F.lit(15).cast("bigint")
        d = F.abs(F.shiftrightunsigned(a, 4 * i).bitwiseAND(low) - F.shiftrightunsigned(b, 4 * i).bitwiseAND(low))
        out = out + F.least(d, 16 - d)
    return out


def _keys(lines: DataFrame, places: list[tuple[int, int, int, int]], max_edits: int, chars: int) -> DataFrame:
    """(key, uid, pos, counts) of the pieces at ``places`` (difference in length, edits, segment,
    shift) that hold for a line (id, line, counts, n).

    The places are rows, not one expression each: a method of over 8000 bytes of
    code is not compiled by the JVM.
    """
    place = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("diff", "edits", "i", "shift"), p)])
                                for p in places]))
    at = lines.select("id", "line", "counts", "n", place.alias("p"))
    at = at.select("id", "line", "counts", "p.*", (F.col("n") - F.col("p.diff")).alias("size")).where(threshold(F.col("size"), max_edits, chars) == F.col("edits"))
    start, stop = (F.floor(F.col("size") * (F.col("i") + j) / (F.col("edits") + 1)) for j in (0, 1))
    piece = F.substring("line", (start + F.col("shift") + 1).cast("int"), (stop - start).cast("int"))
    return at.select(F.xxhash64(F.col("size").cast("int"), "i", piece).alias("key"), "id.*", "counts")


def segments(lines: DataFrame, max_edits: int, chars: int) -> DataFrame:
    """(key, uid, pos, counts) of the index: a line's own segments."""
    return _keys(lines, [(0, edits, i, 0) for edits in range(1, max_edits + 1) for i in range(edits + 1)], max_edits, chars)


def probes(lines: DataFrame, max_edits: int, chars: int) -> DataFrame:
    """(key, uid, pos, counts): substrings of each line that can equal a segment of a line that
    is shorter by up to ``max_edits``. A segment that the first edits before it
    shift by at most its number, and the edits behind it make up for the
    difference in length, can only start in the places tried here."""
    places = [(diff, edits, i, shift)
              for diff in range(max_edits + 1) for edits in range(max(1, diff), max_edits + 1) for i in range(edits + 1)
              for shift in range(max(-i, diff - (edits - i)), min(i, diff + (edits - i)) + 1)]
    return _keys(lines, places, max_edits, chars)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, wherever the filter is moved to."""
    return F.element_at(F.transform(F.array(value), use), 1)


def edit_distance(x: Column, y: Column, edits: int) -> Column:
    """Edit distance of the character arrays ``x`` (not longer) and ``y``, exact
    up to ``edits``; ``x`` has more than ``edits`` characters.

    Bit b of the words stands for row j - edits + b of column j: a band of
    2 * edits + 1 rows around the diagonal that moves down one row a column. The
    words hold where values rise (vp) or fall (vn) down a column. The distance
    is followed along the band's lowest diagonal to the last row, then along it.
    """
    mask = (1 << (2 * edits + 1)) - 1
    long = lambda v: F.lit(v).cast("bigint")
    m = F.size(x)

    def step(s: Column, j: Column) -> Column:
        here = F.get(y, j - 1)
        match = long(0)
        for b in range(2 * edits + 1):
            at = j - edits + b - 1
            hit = F.coalesce(F.when(at >= 0, F.get(x, F.greatest(at, F.lit(0)))) == here, F.lit(False))
            match = match + F.when(hit, long(1 << b)).otherwise(long(0))
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), match.alias("x"), j.alias("j"))

    def flow(s: Column) -> Column:
        vp, vn, x_ = s["vp"], s["vn"], s["x"]
        d0 = (((x_.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x_).bitwiseOR(vn)).bitwiseAND(long(mask))
        return F.struct(vp.alias("vp"), vn.alias("vn"), s["d"].alias("d"), d0.alias("d0"), s["j"].alias("j"))

    def close(s: Column) -> Column:
        vp, vn, d0 = s["vp"], s["vn"], s["d0"]
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(long(mask))
        hn = d0.bitwiseAND(vp)
        return F.struct(hp.alias("hp"), hn.alias("hn"), d0.alias("d0"), s["d"].alias("d"), s["j"].alias("j"))

    def turn(s: Column) -> Column:
        hp, hn, half, j = s["hp"], s["hn"], F.shiftright(s["d0"], 1), s["j"]
        row = F.lit(edits) + m - j  # the bit of the last row
        bit = lambda w, b: F.when(w.bitwiseAND(b) != 0, F.lit(1)).otherwise(F.lit(0))
        low = long(1 << 2 * edits)
        last = long(0)
        for b in range(2 * edits):
            last = F.when(row == b, long(1 << b)).otherwise(last)
        d = s["d"] + F.when(row >= 2 * edits, F.lit(1) - bit(s["d0"], low)).otherwise(bit(hp, last) - bit(hn, last))
        vp = hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp))).bitwiseAND(long(mask))
        return F.struct(vp.alias("vp"), half.bitwiseAND(hp).alias("vn"), d.cast("int").alias("d"))

    start = F.struct(long(((1 << (edits + 1)) - 1) << edits).alias("vp"), long(0).alias("vn"), F.lit(edits).alias("d"))
    return F.aggregate(F.sequence(F.lit(1), F.size(y)), start,
                       lambda s, j: bind(bind(bind(step(s, j), flow), close), turn), lambda s: s["d"])


def links(firsts: DataFrame, docs: DataFrame, max_edits: int = MAX_EDITS, chars: int = CHARS_PER_EDIT) -> DataFrame:
    """(a, b) of linked first lines (uid, pos, common); each is a struct of uid and pos."""
    own = firsts.groupBy("uid").agg(F.collect_list(F.struct("pos", "common")).alias("own"))
    cut = (docs.select("uid", "text", "extra").join(own.hint("merge"), "uid")
           .select("uid", "own", F.split("text", "\n").alias("lines")))
    lines = (cut.select("uid", F.explode(F.transform("own", lambda o: F.struct(
                 o["pos"].alias("pos"), o["common"].alias("common"), F.get("lines", o["pos"]).alias("line")))).alias("at"))
             .select(F.struct("uid", "at.pos").alias("id"), "at.line", "at.common", F.length("at.line").alias("n"))
             .where(threshold(F.col("n"), max_edits, chars) > 0))
    lines = write_read(lines.select("id", "line", "n", F.when(F.col("common"), letter_counts("line")).alias("counts")), "lines",
                       compression="zstd")
    index, probe = segments(lines, max_edits, chars), probes(lines, max_edits, chars)
    index, probe = index.hint("merge").alias("a"), probe.alias("b")
    other = (F.col("a.uid") != F.col("b.uid")) | (F.col("a.pos") != F.col("b.pos"))
    near = F.coalesce(count_distance(F.col("a.counts"), F.col("b.counts")) <= 2 * max_edits, F.lit(True))
    pairs = index.join(probe, (F.col("a.key") == F.col("b.key")) & other & near).select(
        F.struct("a.uid", "a.pos").alias("a"), F.struct("b.uid", "b.pos").alias("b")).distinct()
    pairs = write_read(pairs, "line-pairs")
    ends = pairs.select("a.*").union(pairs.select("b.*")).distinct()
    ends = write_read(ends.select(F.struct("uid", "pos").alias("id")), "line-ends")
    found = write_read(lines.select("id", "line").join(ends, "id"), "line-texts")
    full = (pairs.join(found.select(F.col("id").alias("a"), F.col("line").alias("x")), "a")
            .join(found.select(F.col("id").alias("b"), F.col("line").alias("y")), "b"))
    # of two equally long lines each may have probed the other: once is enough
    nx, ny = F.length("x"), F.length("y")
    full = full.where((nx < ny) | (nx == ny) & (F.col("a") < F.col("b"))).withColumn("t", threshold(nx, max_edits, chars))
    near = F.lit(False)
    for edits in range(1, max_edits + 1):
        distance = bind(F.struct(F.split("x", "").alias("x"), F.split("y", "").alias("y")),
                        lambda s: edit_distance(s["x"], s["y"], edits))  # noqa: B023
        near = F.when(F.col("t") == edits, distance <= edits).otherwise(near)
    # compiled code, which gives up beyond the most edits, bounds the pairs first
    bounded = F.levenshtein("x", "y", max_edits) >= 0
    return full.where(ny - nx <= F.col("t")).where(F.when(bounded, near).otherwise(F.lit(False))).select("a", "b")


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 max_edits: int = MAX_EDITS, chars: int = CHARS_PER_EDIT) -> tuple[DataFrame, DataFrame]:
    """(docs, lines): numbered documents (uid, text, extra), and every line with
    (uid, pos, class_uid, class_pos, n_links, kept).

    The class is the first line, by id and place, that equal and linked lines
    lead to; only that one is kept. ``n_links`` counts the other distinct lines
    linked directly. Blank lines are in no class. Null and empty texts have no
    lines. Rows that repeat an id count in order of their texts.
    """
    src = numbered(docs, id_col, text_col)
    lines = lines_of(src).select("uid", "pos", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"),
                                 F.xxhash64(F.substring("line", 1, END_CHARS)).alias("head"),
                                 F.xxhash64(F.substring("line", -END_CHARS, END_CHARS)).alias("tail"))
    classes = write_read(lines.groupBy("k1", "k2").agg(F.min(F.struct("uid", "pos")).alias("first"),
                                                       F.first("head").alias("head"), F.first("tail").alias("tail")),
                         "line-classes")
    firsts = classes.select("first.uid", "first.pos", "head", "tail")
    for end in ("head", "tail"):
        common = classes.groupBy(end).agg(F.count(F.lit(1)).alias(f"n_{end}")).where(F.col(f"n_{end}") > COMMON_ENDS)
        firsts = firsts.join(write_read(common, f"line-{end}s"), end, "left")
    firsts = firsts.select("uid", "pos", (F.col("n_head").isNotNull() | F.col("n_tail").isNotNull()).alias("common"))
    found = write_read(links(firsts, src, max_edits, chars), "line-links")
    degree = (found.select("a").union(found.select(F.col("b").alias("a"))).groupBy("a")
              .agg(F.count(F.lit(1)).alias("n_links")))
    tops = components(found).withColumnRenamed("id", "first")
    heads = (classes.join(tops, "first", "left").join(degree.withColumnRenamed("a", "first"), "first", "left")
             .select("k1", "k2", F.coalesce("component", "first").alias("top"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    heads = write_read(heads, "line-heads")
    out = lines.join(heads, ["k1", "k2"])
    at = F.struct("uid", "pos")
    return src, out.select("uid", "pos", F.col("top.uid").alias("class_uid"), F.col("top.pos").alias("class_pos"),
                           "n_links", (at == F.col("top")).alias("kept"))


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """(extra, text, cut): every document with the kept lines only (blank ones
    stay where they are); ``cut`` counts the removed ones."""
    src, lines = line_classes(docs, id_col, text_col, **limits)
    gone = lines.where(~F.col("kept")).groupBy("uid").agg(F.collect_list("pos").alias("gone"))
    both = src.hint("merge").join(gone, "uid", "left")
    cut = both.select("extra", "text", "gone", F.split("text", "\n").alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda p: F.get("lines", p)), "\n"))
    return cut.select("extra", text.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("cut"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    _, lines = line_classes(docs)
    return lines.select(F.col("uid").alias("doc_id"), F.col("pos").alias("line_no"), F.col("class_uid").alias("class_doc_id"),
                        F.col("class_pos").alias("class_line_no"), "n_links", "kept")
