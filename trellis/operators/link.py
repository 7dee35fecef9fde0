"""Entity linking and tool-call extraction.

Fuzzy linking never compares all pairs: a mention and a label can reach
``ratio >= 90`` only if their indel distance is at most ``2*len(label)/9``;
the label is cut into ``t+1`` segments and, by pigeonhole, one of them occurs
unchanged in the mention within ``t`` positions of where it sits in the
label (Pass-Join). The equi-join on (segment text, label length, segment
number) is therefore an exact filter; survivors are scored exactly. Labels
that share a segment with many others (names of one pattern, numbered) meet
their mentions by common subsequences instead.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.functions.text import col_, numeric_id
from trellis.operators.gazetteer import mentions
from trellis.session import materialize

# Role keywords, the tool-call pattern, tool name and messages.
ROLE_WORDS = ["president", "ceo", "director", "minister"]
TOOL_CALL_PATTERN = r'\{[^{}]*"name"\s*:\s*"[^"]+"\s*,\s*"arguments"\s*:\s*\{[^{}]*\}[^{}]*\}'
TOOL_NAME = "query_knowledge_graph"
KG_TOKEN = " <KG_EMBEDDING>"
FUZZY_THRESHOLD = 90.0
# A label segment is hot beyond so many labels; up to so many characters together, a
# mention and a label with a hot segment meet by common subsequences (four indels).
HOT_SEGMENT = 64
NEAR_CHARS = 50
MAX_ROUNDS = 5


def label_index(graph_nodes: DataFrame) -> DataFrame:
    """``graph_nodes(graph_id, node_id, label)`` for each graph's first
    node; key = lower(strip(label)); on duplicates the first graph (numeric
    id order) wins."""
    key = F.lower(F.regexp_replace("label", r"(?U)^\s+|\s+$", ""))
    g = graph_nodes.withColumn("key", key).filter(F.col("key") != "")
    return g.groupBy("key").agg(F.min_by("node_id", F.struct(numeric_id("graph_id"), F.col("graph_id")))
                                .alias("entity_id"))


def role_mentions(text) -> Column:
    """Role keywords, lower-cased."""
    return F.regexp_extract_all(F.lower(col_(text)), F.lit(r"\b(" + "|".join(ROLE_WORDS) + r")\b"), 1)


def token_fallback(text) -> Column:
    """Alphabetic tokens longer than 2 characters, lower-cased."""
    return F.transform(F.regexp_extract_all(col_(text), F.lit(r"(?U)\b\p{IsAlphabetic}{3,}\b"), 0),
                       lambda x: F.lower(x))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel (Hyyro 2004):
    one pass over ``a`` with ``b``'s character positions as bit masks."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(b):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(b)) - 1
    v = full
    for ch in a:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


def _lcs_ratio(a: str, b: str) -> float:
    """Indel similarity ``100 * 2*LCS / (la + lb)`` (the ``ratio`` score)."""
    la, lb = len(a), len(b)
    if la + lb == 0:
        return 100.0
    return 100.0 * 2 * lcs_length(a, b) / (la + lb)


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_lcs_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def _max_dist(n: Column) -> Column:
    return F.floor(n * F.lit(2) / F.lit(9)).cast("int")


def label_segments(index: DataFrame) -> DataFrame:
    """Pass-Join segments of each label: ``t = floor(2*lb/9)``, ``t+1`` parts
    (the last ``lb mod (t+1)`` parts one character longer)."""
    lb = F.length("key")
    d = index.withColumn("lb", lb).withColumn("k", _max_dist(lb) + 1)
    d = d.select("key", "entity_id", "lb", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    short = F.floor(F.col("lb") / F.col("k")).cast("int")
    n_short = F.col("k") - F.pmod(F.col("lb"), F.col("k"))
    pos = F.when(F.col("i") < n_short, F.col("i") * short) \
        .otherwise(n_short * short + (F.col("i") - n_short) * (short + 1))
    ln = F.when(F.col("i") < n_short, short).otherwise(short + 1)
    return d.select("key", "entity_id", "lb", "i", pos.cast("int").alias("seg_pos"),
                    ln.cast("int").alias("seg_len"),
                    F.substring("key", pos + 1, ln).alias("seg"))


def mention_probes(mentions: DataFrame, seg_layout: DataFrame) -> DataFrame:
    """For each mention, the substrings that could equal a segment of a label
    whose length is in the mention's band; ``seg_layout(lb, i, seg_pos,
    seg_len)`` is the distinct segment layout (as large as the label lengths are
    many)."""
    la = F.length("mention")
    # |la - lb| <= floor(2*lb/9) implies 9*la/11 <= lb <= 9*la/7: enumerate
    # those label lengths and equi-join on them (no band join), then apply
    # the exact condition
    m = mentions.withColumn("la", la).withColumn("lb", F.explode(F.sequence(
        F.greatest(F.lit(1), F.floor(F.col("la") * 9 / 11).cast("int")),
        F.greatest(F.lit(1), F.ceil(F.col("la") * 9 / 7).cast("int")))))
    j = m.join(seg_layout, "lb").filter(
        (F.col("lb") >= F.col("la") - _max_dist(F.col("lb"))) &
        (F.col("lb") <= F.col("la") + _max_dist(F.col("lb"))))
    t = _max_dist(F.col("lb"))
    lo = F.greatest(F.lit(0), F.col("seg_pos") - t)
    hi = F.least(F.col("la") - F.col("seg_len"), F.col("seg_pos") + t)
    p = j.select("mention", "la", "lb", "i", "seg_len",
                 F.explode(F.sequence(lo, F.greatest(hi, lo - 1))).alias("p"))
    p = p.filter(F.col("p") <= F.col("la") - F.col("seg_len"))
    return p.select("mention", "lb", "i", F.substring("mention", F.col("p") + 1, F.col("seg_len")).alias("seg"))


def fuzzy_candidates(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """N6 blocking + verification: ``(mention, key, entity_id, score)`` of labels with
    ``ratio >= 90``, the best of each mention among them.

    A segment that more than ``HOT_SEGMENT`` labels of one length share at one place is
    hot: its labels are not joined by it (``near_names`` looks them up). Lengths beyond
    ``NEAR_CHARS`` together stay with the segments, which are long and rare there."""
    segs = label_segments(index)
    layout = segs.select("lb", "i", "seg_pos", "seg_len").distinct()
    probes = mention_probes(mentions.select("mention").distinct(), layout)
    key = ["lb", "i", "seg"]
    # computed once, probed segments only: the hot keys take both sides apart
    probes = materialize(probes.distinct())
    segs = materialize(segs.join(probes.select(*key).distinct(), key, "left_semi"))
    hot = segs.groupBy(*key).count().where(F.col("count") > HOT_SEGMENT).select(*key, F.lit(True).alias("hot"))
    segs, probes = segs.join(hot, key, "left"), probes.join(hot, key, "left")
    la = F.length("mention")
    by_name = F.col("hot").isNotNull() & (la + F.col("lb") < NEAR_CHARS)
    pairs = (probes.where(~by_name).drop("hot").join(segs, ["lb", "i", "seg"])
             .select("mention", "key", "entity_id").distinct())
    lb = F.length("key")
    # exact prefilters: length band, then Levenshtein <= indel budget
    pairs = pairs.filter(F.abs(la - lb) <= F.floor((la + lb) * F.lit(0.1)))
    # Levenshtein never exceeds the indel distance, so this drops no match
    pairs = pairs.filter(F.levenshtein("mention", "key") <= F.floor((la + lb) * F.lit(0.1)))
    near = near_names(probes.where(by_name).select("mention", "lb").distinct(),
                      segs.where("hot").select("key", "entity_id", "lb").distinct())
    scored = pairs.unionByName(near).distinct().withColumn("score", indel_ratio("mention", "key"))
    return scored.filter(F.col("score") >= F.lit(FUZZY_THRESHOLD))


def shortened(text: str, n: Column, most: int) -> Column:
    """All distinct strings that are ``text`` without ``n`` (0 to ``most``) characters."""
    out = F.array(F.col(text))
    cases = F.when(n == 0, out)
    for k in range(1, most + 1):
        out = F.array_distinct(F.flatten(F.transform(out, lambda s: F.transform(
            F.sequence(F.lit(1), F.length(s)),
            lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))))))
        cases = cases.when((n == k) & (F.length(text) > k), out)
    return cases


def near_names(probes: DataFrame, labels: DataFrame) -> DataFrame:
    """``(mention, key, entity_id)``: for ``probes(mention, lb)`` the nearest of
    ``labels(key, entity_id, lb)`` by their common subsequences.

    At indel distance d a label of length lb without (d + lb - la) / 2 of its characters
    equals the mention without (d + la - lb) / 2: an equi-join on the shortened strings
    whose rows are matches. Distances go up one by one; a mention leaves when no greater
    distance can reach its best score, so names that differ in one place cost a row for
    each character, however many names begin alike."""
    left = materialize(probes.withColumn("la", F.length("mention")))
    found = []
    for d in range(1, NEAR_CHARS // 10):
        if left.isEmpty():
            break
        x = ((F.lit(d) + F.col("lb") - F.col("la")) / 2).cast("int")
        fits = ((F.abs(F.col("la") - F.col("lb")) <= d) & (F.pmod(F.lit(d) + F.col("lb") - F.col("la"), F.lit(2)) == 0)
                & (F.col("la") + F.col("lb") >= 10 * d))
        m = left.where(fits).select("mention", "la", "lb", x.alias("x"))
        short = m.select("mention", "la", "lb", "x", F.explode(shortened("mention", d - F.col("x"), d)).alias("v"))
        # only the lengths that are asked for: at most a row for each pair of lengths
        wanted = F.broadcast(m.select("lb", "x").distinct())
        cut = labels.join(wanted, "lb").select("key", "entity_id", "lb", "x", F.explode(shortened("key", F.col("x"), d)).alias("v"))
        level = materialize(short.join(cut, ["lb", "x", "v"]).select("mention", "la", "lb", "key", "entity_id").distinct())
        found.append(level.select("mention", "key", "entity_id"))
        score = 1 - F.lit(float(d)) / (F.col("la") + F.col("lb"))
        best = level.groupBy("mention", "la").agg(F.max(score).alias("best"))
        done = best.where(F.col("best") > 1 - F.lit(d + 1.0) / (2 * F.col("la") + d + 1) + 1e-12).select("mention")
        left = materialize(left.join(done, "mention", "left_anti"))
    if not found:
        return probes.join(labels, "lb").where("false").select("mention", "key", "entity_id")
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out


def link_mentions(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """N5 + N6: per distinct mention, the exact label (confidence 1.0), else
    the best fuzzy label (confidence score/100; ties: first label in index
    order). Unlinked mentions are absent."""
    distinct = mentions.select("mention").distinct()
    exact = distinct.join(index.select(F.col("key").alias("mention"), "entity_id"), "mention") \
        .select("mention", "entity_id", F.col("mention").alias("entity_name"), F.lit(1.0).alias("confidence"))
    rest = distinct.join(exact.select("mention"), "mention", "left_anti")
    fz = fuzzy_candidates(rest, index)
    w = Window.partitionBy("mention").orderBy(F.col("score").desc(), numeric_id("entity_id"), "key")
    best = (fz.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
            .select("mention", "entity_id", F.col("key").alias("entity_name"),
                    (F.col("score") / 100.0).alias("confidence")))
    return exact.unionByName(best)


def parse_tool_calls(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Regex-found JSON objects; ``arguments`` parsed as an object or a
    JSON-encoded string; unparsable calls are skipped. ``call_pos`` keeps
    the order inside the text."""
    calls = texts.select("*", F.posexplode(F.regexp_extract_all(col_(text_col), F.lit(TOOL_CALL_PATTERN), 0))
                         .alias("call_pos", "call"))
    parsed = F.from_json("call", "name string, arguments string")
    calls = calls.withColumn("_p", parsed).filter(F.col("_p").isNotNull() & F.col("_p.name").isNotNull())
    args = F.from_json(F.col("_p.arguments"), "entity_name string")
    return calls.select(*texts.columns, "call_pos", F.col("_p.name").alias("name"),
                        args["entity_name"].alias("entity_name"))


def candidates(texts: DataFrame, index: DataFrame) -> DataFrame:
    """``(text_id, mention, mention_pos)`` of ``texts(text_id, text)``, a text id
    being one text. Gazetteer spans in text order, then role words; alphabetic tokens
    only for texts with neither. ``mention_pos`` sorts in that order."""
    def at(kind):
        return F.struct(F.lit(kind).alias("kind"), F.col("pos").cast("bigint").alias("pos")).alias("mention_pos")

    spans = mentions(texts, index).select("text_id", "mention", at(0))
    roles = texts.select("text_id", F.posexplode(role_mentions("text")).alias("pos", "mention")).select("text_id", "mention", at(1))
    primary = materialize(spans.unionByName(roles))  # read for itself and for what it leaves out
    none = texts.join(primary.select("text_id"), "text_id", "left_anti")
    tokens = none.select("text_id", F.posexplode(token_fallback("text")).alias("pos", "mention")).select("text_id", "mention", at(2))
    return primary.unionByName(tokens)


def extract(texts: DataFrame, index: DataFrame, limit: int, whole: bool = False) -> DataFrame:
    """The best ``limit`` links of each text. With ``whole`` the stripped text is
    a candidate as well, behind the others (a name on its own, as a recogniser of names
    would find it)."""
    found = candidates(texts, index)
    if whole:
        found = found.unionByName(texts.select(
            "text_id", F.lower(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).alias("mention"),
            F.struct(F.lit(3).alias("kind"), F.lit(0).cast("bigint").alias("pos")).alias("mention_pos")).where("mention <> ''"))
    found = materialize(found)  # links are looked up by distinct mention, then joined back
    return top_links(found.join(link_mentions(found.select("mention"), index), "mention"), "text_id", limit)


def resolve_names(calls: DataFrame, index: DataFrame, has_graph: DataFrame) -> DataFrame:
    """``ok`` / ``not found`` / ``no graph`` per tool call, from one ranked lookup
    table of the distinct arguments: the candidates of each (N2-N4, and the argument
    itself) are linked and the best link is taken; ``index`` may hold entities without a
    graph. Adds ``mention, entity_id, matched_name, confidence, status``."""
    calls = materialize(calls)  # parsed once, for the names and for the result
    names = calls.select("entity_name").where(F.col("entity_name") != "").distinct()
    best = extract(names.select(F.col("entity_name").alias("text_id"), F.col("entity_name").alias("text")), index, 1, whole=True)
    table = (best.join(has_graph.select("entity_id").distinct().withColumn("_g", F.lit(True)), "entity_id", "left")
             .select(F.col("text_id").alias("entity_name"), "mention", "entity_id", F.col("entity_name").alias("matched_name"),
                     "confidence", "_g"))
    status = (F.when(F.col("entity_id").isNull(), F.lit("not found"))
              .when(F.col("_g").isNull(), F.lit("no graph")).otherwise(F.lit("ok")))
    return calls.join(table, "entity_name", "left").withColumn("status", status).drop("_g")


def cumulative_entities(turns: DataFrame, resolved: DataFrame) -> DataFrame:
    """``turns(chat_id, round, conv_id)`` with at most ``MAX_ROUNDS``
    rounds a chat, and the resolved calls of each response; entities of all
    calls so far, in round and call order, repeats kept. A chat ends at its
    first response without calls."""
    found = F.when((F.col("name") == TOOL_NAME) & (F.col("status") == "ok")
                   & (F.coalesce("entity_name", F.lit("")) != ""), F.col("entity_id"))
    per = resolved.groupBy("conv_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("call_pos", found.alias("e")))), lambda c: c["e"]).alias("_e"))
    so_far = Window.partitionBy("chat_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    d = turns.join(per, "conv_id", "left")
    d = d.withColumn("_going", F.bool_and(F.col("_e").isNotNull()).over(so_far)) \
        .withColumn("entities", F.array_compact(F.flatten(F.collect_list("_e").over(so_far))))
    return d.where("_going").select("chat_id", "round", "entities")


def tool_result_line(name, entity_name, status, matched_name) -> Column:
    """One line per call."""
    return (F.when(col_(name) != TOOL_NAME, F.lit(None))
            .when(col_(entity_name).isNull() | (col_(entity_name) == ""), F.lit("missing entity_name"))
            .when(col_(status) != "ok", F.concat(col_(entity_name), F.lit(" not found")))
            .otherwise(F.concat(F.lit("Found entity "), col_(matched_name), F.lit(KG_TOKEN))))


def top_links(links: DataFrame, key: str, limit: int) -> DataFrame:
    """N7 + N8: max confidence per (mention, entity, name), then the best
    ``limit`` per text by confidence, ties by first mention position."""
    d = links.groupBy(key, "mention", "entity_id", "entity_name").agg(
        F.max("confidence").alias("confidence"), F.min("mention_pos").alias("mention_pos"))
    w = Window.partitionBy(key).orderBy(F.col("confidence").desc(), "mention_pos", "entity_id")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
