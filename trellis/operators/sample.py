"""Sample assembly, text side (T1-T20): conversations, spans, token arrays.

Conversations are ``ARRAY<STRUCT<role, content>>``; token sequences are
``ARRAY<BIGINT>`` columns. Everything is a higher-order array expression
evaluated per row, so it parallelises with the rows and never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions.text import col_, find0, rfind0
from trellis.operators.ordinal import dense_ordinal

KG_TOKEN = " <KG_EMBEDDING>"
KG_MARK = "<KG_EMBEDDING>"
IGNORE = -100
#: Tokens whose ids are broadcast; a vocabulary has no bound.
FREQUENT_TOKENS = 20_000

# The 20 user question templates and the 10 negative answers.
USER_QUESTIONS = [
    "what do you know about {subject}?",
    "tell me all you know about {subject}",
    "what can you find about {subject}?",
    "can you provide more details on {subject}?",
    "give me background on {subject}.",
    "what's important to know about {subject}?",
    "describe {subject} in general terms.",
    "summarize the key facts about {subject}.",
    "what knowledge is available about {subject}?",
    "give a high-level overview of {subject}.",
    "what are the basics of {subject}?",
    "explain {subject} briefly.",
    "what is {subject} known for?",
    "outline the main points about {subject}.",
    "provide general information on {subject}.",
    "what should I know first about {subject}?",
    "share notable facts about {subject}.",
    "what connections are relevant to {subject}?",
    "what context is useful for understanding {subject}?",
    "how would you characterize {subject} overall?",
]
NEGATIVE_ANSWERS = [
    "The Knowledge Graph does not contain this information.",
    "The Knowledge Graph does not have this information.",
    "This information is not available in the Knowledge Graph.",
    "The KG returned no results for this query.",
    "The KG does not contain this information.",
    "With the current knowledge I have, I cannot provide an answer to that question.",
    "I don't have that information in my knowledge base.",
    "I'm sorry, but I don't have that information.",
    "I don't have that information.",
    "I don't know.",
]
ANSWER_PREFIX = "the answer is: "


def turn(role, content) -> Column:
    return F.struct(F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"),
                    col_(content).alias("content"))


def round_robin_question(idx, subject) -> Column:
    """``templates[idx % 20].format(subject=...)``."""
    tpl = F.element_at(F.array(*map(F.lit, USER_QUESTIONS)),
                       (F.pmod(col_(idx), F.lit(len(USER_QUESTIONS))) + 1).cast("int"))
    return F.replace(tpl, F.lit("{subject}"), col_(subject))


def sentence_conversation(question, subject_label, sentence, tool_role: str = "assistant") -> Column:
    """T2 (sentence form): user question, KG turn, assistant sentence."""
    return F.array(turn("user", question),
                   turn(tool_role, F.concat(col_(subject_label), F.lit(KG_TOKEN))),
                   turn("assistant", sentence))


def negative_pick(key, idx, p: float, seed: str = "neg") -> tuple[Column, Column]:
    """Seeded, deterministic coin ``u < p`` per row key; returns
    (is_negative, negative answer ``negatives[idx % 10]``)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed), col_(key).cast("string"))), 1, 8), 16, 10)
    u = h.cast("double") / F.lit(float(1 << 32))
    neg = F.element_at(F.array(*map(F.lit, NEGATIVE_ANSWERS)),
                       (F.pmod(col_(idx), F.lit(len(NEGATIVE_ANSWERS))) + 1).cast("int"))
    return u < F.lit(p), neg


def prefixed_answer(answer) -> Column:
    """T4: ``"the answer is: " + a`` unless ``a`` is a negative answer."""
    a = col_(answer)
    return F.when(a.isin(*NEGATIVE_ANSWERS), a).otherwise(F.concat(F.lit(ANSWER_PREFIX), a))


def qa_conversation(question, subject_label, answer, tool_role: str = "assistant") -> Column:
    """T2 (QA form)."""
    return F.array(turn("user", question),
                   turn(tool_role, F.concat(col_(subject_label), F.lit(KG_TOKEN))),
                   turn("assistant", prefixed_answer(answer)))


def flatten_chat(conv) -> Column:
    """T5: ``role: content`` lines joined by NL, stripped."""
    lines = F.transform(col_(conv), lambda t: F.concat(t["role"], F.lit(": "), t["content"]))
    return F.regexp_replace(F.array_join(lines, "\n"), r"(?U)^\s+|\s+$", "")


def drop_kg_turns(conv) -> Column:
    """Remove turns that contain the KG token."""
    return F.filter(col_(conv), lambda t: ~t["content"].contains(KG_TOKEN))


def replace_kg_token(conv, text) -> Column:
    """G11 placement: the KG token is replaced by the KG text."""
    return F.transform(col_(conv), lambda t: F.struct(
        t["role"].alias("role"), F.replace(t["content"], F.lit(KG_TOKEN), col_(text)).alias("content")))


def locate_answer(text, answer, mode: str = "first") -> Column:
    """0-based start of the answer; ``first`` = find, ``last`` = rfind."""
    return find0(text, answer) if mode == "first" else rfind0(text, answer)


def char_to_token(spans, c) -> Column:
    """Index of the token with ``start <= c < end``; NULL if none."""
    idx = F.filter(F.transform(col_(spans), lambda s, i: F.when((s["start"] <= col_(c)) & (col_(c) < s["end"]), i)),
                   lambda x: x.isNotNull())
    return F.try_element_at(idx, F.lit(1))


def suffix_labels(ids, start) -> Column:
    """-100 before ``start``, the ids from there on."""
    return F.transform(col_(ids), lambda x, i: F.when(i >= col_(start), x).otherwise(F.lit(IGNORE)))


def span_labels(ids, start, end) -> Column:
    """-100 outside ``[start, end)``."""
    return F.transform(col_(ids), lambda x, i: F.when((i >= col_(start)) & (i < col_(end)), x)
                       .otherwise(F.lit(IGNORE)))


def pad_right(arr, length, value) -> Column:
    """Right padding to ``length``."""
    n = F.greatest(F.lit(0), col_(length) - F.size(col_(arr)))
    return F.concat(col_(arr), F.array_repeat(F.lit(value).cast("bigint"), n.cast("int")))


def padded_length(longest, multiple: int | None = None) -> Column:
    """The length that a batch is padded to: its longest row's, rounded up to a
    multiple (an empty batch stays empty)."""
    if multiple is None:
        return col_(longest)
    if multiple < 1:
        raise ValueError("the multiple must be positive")
    return (F.ceil(col_(longest) / multiple) * multiple).cast("int")


def pad_left(arr, length, value) -> Column:
    """Left padding to ``length``."""
    n = F.greatest(F.lit(0), col_(length) - F.size(col_(arr)))
    return F.concat(F.array_repeat(F.lit(value).cast("bigint"), n.cast("int")), col_(arr))


def position_ids(mask, left: bool) -> Column:
    """Positions 0..len-1 over the real tokens, 0 on the pad side."""
    m = col_(mask)
    if left:
        # pads form a prefix: the first real token sits at array_position(m, 1) - 1
        first = F.array_position(m, F.lit(1)) - 1
        return F.transform(m, lambda x, i: F.when(x == 1, i - first).otherwise(F.lit(0)))
    return F.transform(m, lambda x, i: F.when(x == 1, i).otherwise(F.lit(0)))


def splice_kg(pairs, kg_tok: str, n_codes: int, code_base: int) -> tuple[Column, Column]:
    """Over ``ARRAY<STRUCT<tok, id>>``, each KG token becomes
    ``n_codes`` code positions (ids ``code_base + q``) labelled -100;
    returns (ids, labels)."""
    codes = F.sequence(F.lit(code_base).cast("bigint"), F.lit(code_base + n_codes - 1).cast("bigint"))
    new_ids = F.flatten(F.transform(col_(pairs), lambda p: F.when(p["tok"] == kg_tok, codes)
                                    .otherwise(F.array(p["id"].cast("bigint")))))
    labels = F.transform(new_ids, lambda x: F.when(x >= code_base, F.lit(IGNORE).cast("bigint"))
                         .otherwise(x))
    return new_ids, labels


def first_graph(n_kg, batch: str, order: str) -> Column:
    """Number of the batch's graph that a row's first KG token takes;
    graphs are consumed in batch order (the window holds one batch)."""
    w = Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(col_(n_kg)).over(w), F.lit(0))


def splice_graph_codes(pairs, kg_tok: str, codes) -> tuple[Column, Column]:
    """Over ``ARRAY<STRUCT<tok, id>>``, the i-th KG token becomes the
    i-th list of ``codes ARRAY<ARRAY<BIGINT>>`` (nothing if there is none),
    labelled -100; returns (ids, labels)."""
    at = F.filter(F.transform(col_(pairs), lambda p, i: F.when(p["tok"] == kg_tok, i)), lambda x: x.isNotNull())
    none = F.array().cast("array<bigint>")

    def graph(i):
        return F.coalesce(F.get(col_(codes), (F.array_position(at, i) - 1).cast("int")), none)

    def spliced(block):
        return F.flatten(F.transform(col_(pairs), lambda p, i: F.when(p["tok"] == kg_tok, block(graph(i)))
                                     .otherwise(F.array(p["id"].cast("bigint")))))

    return spliced(lambda g: g), spliced(lambda g: F.transform(g, lambda _: F.lit(IGNORE).cast("bigint")))


def unpad(arr, mask) -> Column:
    """Keep positions whose attention mask is 1."""
    z = F.arrays_zip(col_(arr).alias("v"), col_(mask).alias("m"))
    return F.transform(F.filter(z, lambda e: e["m"] == 1), lambda e: e["v"])


def truncate(arr, n: int) -> Column:
    """T16."""
    return F.slice(col_(arr), 1, n)


def token_cost(mask, n_kg, n_codes: int) -> Column:
    """Attended tokens + KG tokens x Q."""
    return F.size(F.filter(col_(mask), lambda x: x == 1)) + col_(n_kg) * F.lit(n_codes)


def to_str(arr) -> Column:
    return F.array_join(F.transform(col_(arr), lambda x: x.cast("string")), ",")


def explode_tokens(df: DataFrame, spans_col: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.posexplode(spans_col).alias("tpos", "t")) \
        .select(*keys, "tpos", F.col("t.tok").alias("tok"))


def byte_order_key(s) -> Column:
    """Numeric key non-decreasing in the byte order of a string (first 7
    UTF-8 bytes), for bucketing a string sort in :func:`dense_ordinal`."""
    return F.conv(F.rpad(F.substring(F.hex(col_(s)), 1, 14), 14, "0"), 16, 10).cast("bigint")


def vocabulary(tokens: DataFrame, tok: str = "tok") -> DataFrame:
    """``(tok, token_id, n)``: distinct tokens with a dense id in byte order."""
    v = tokens.groupBy(tok).agg(F.count(F.lit(1)).alias("n"))
    return dense_ordinal(v, byte_order_key(tok), [F.col(tok)], name="token_id")


def attach_token_ids(df: DataFrame, spans_col: str, key: str, vocab: DataFrame,
                     keep: list[str] | None = None) -> DataFrame:
    """Map each row's token spans to vocabulary ids: ``ids ARRAY<BIGINT>``
    in token order (per-row lists are as long as the row's own text). Only
    ``keep`` columns (default: all) travel through the join back, so texts
    and span arrays are not shuffled when the caller no longer needs them. The
    FREQUENT_TOKENS most frequent tokens, most of any text, find their ids where they
    stand; the others go through a join with the whole vocabulary."""
    long = df.select(key, F.posexplode(spans_col).alias("tpos", "t")) \
        .select(key, "tpos", F.col("t.tok").alias("tok"))
    near = vocab.orderBy(F.desc("n"), "token_id").limit(FREQUENT_TOKENS).select("tok", F.col("token_id").alias("_near"))
    found = long.join(F.broadcast(near), "tok", "left")
    rare = found.where(F.col("_near").isNull()).select(key, "tpos", "tok").join(vocab.select("tok", "token_id"), "tok")
    ids = (found.where(F.col("_near").isNotNull()).select(key, "tpos", F.col("_near").alias("token_id"))
           .unionByName(rare.select(key, "tpos", "token_id"))
           .groupBy(key)
           .agg(F.array_sort(F.collect_list(F.struct("tpos", "token_id"))).alias("_p"))
           .select(key, F.transform("_p", lambda x: x["token_id"]).alias("ids")))
    base = df if keep is None else df.select(key, *keep)
    return base.join(ids, key, "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
