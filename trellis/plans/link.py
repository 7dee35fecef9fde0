"""Entity-linking and tool-call queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trellis.operators import link as lk
from trellis.operators import star
from trellis.operators.gazetteer import mentions
from trellis.plans.kg import kg_frames
from trellis.plans.registry import register
from trellis.session import materialize

TOP_LIMIT = 2

SQL_INDEX = """
nodes AS (
  SELECT l.id, NULLIF(regexp_replace(translate(l.label, ';' || chr(9) || chr(10), '   '), '^\\s+|\\s+$', '', 'g'), '') AS label
  FROM (SELECT id, arg_min(label, ord) AS label FROM kg_label WHERE lang = 'en' GROUP BY id) l
),
ge AS (SELECT s AS id FROM kg_triple WHERE o_type = 'uri' UNION SELECT o FROM kg_triple WHERE o_type = 'uri'),
idx AS (
  SELECT lower(regexp_replace(n.label, '^\\s+|\\s+$', '', 'g')) AS key,
         arg_min(n.id, CAST(substr(n.id, 2) AS BIGINT)) AS entity_id
  FROM nodes n JOIN ge USING (id) WHERE n.label IS NOT NULL AND lower(regexp_replace(n.label, '^\\s+|\\s+$', '', 'g')) <> ''
  GROUP BY 1
)"""


def index_df(spark, sf_dir):
    """N1 over every entity that has a tool graph (out- or in-edges)."""
    t, tr, _, lb, rk = kg_frames(spark, sf_dir)
    uri = tr.filter(F.col("o_type") == "uri")
    ge = uri.select(F.col("s").alias("id")).union(uri.select(F.col("o").alias("id"))).distinct()
    nodes = star.english_labels(lb).join(ge, "id")
    idx = lk.label_index(nodes.select(F.col("id").alias("graph_id"), F.col("id").alias("node_id"), "label"))
    # the index feeds exact lookups, segment blocking and verification
    return t, materialize(idx), ge


def tool_texts(t):
    """One model response per order line with a tool call whose argument is
    the part name, upper-cased, unknown, string-encoded, broken JSON, missing
    or addressed to another tool, by line number."""
    li = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber")
    name = (F.when(n == 2, F.upper("p_name")).when(n == 3, F.lit("unknown gadget"))
            .otherwise(F.col("p_name")))
    obj = F.concat(F.lit('{"name":"query_knowledge_graph","arguments":{"entity_name":"'), name, F.lit('"}}'))
    call = (F.when(n == 4, F.concat(F.lit('{"name":"query_knowledge_graph","arguments":"{\\"entity_name\\": \\"'),
                                    name, F.lit('\\"}"}')))
            .when(n == 5, F.concat(F.lit('{"name":"query_knowledge_graph","arguments":{"entity_name":"'), name,
                                   F.lit('",}}')))
            .when(n == 6, F.lit('{"name":"query_knowledge_graph","arguments":{}}'))
            .when(n == 7, F.concat(F.lit('{"name":"lookup","arguments":{"entity_name":"'), name, F.lit('"}}')))
            .otherwise(obj))
    piece = F.concat(F.lit("Let me check. "), call, F.lit(" One moment."))
    # one response per order; an order's calls are few (one per line item)
    g = li.groupBy(F.col("l_orderkey").cast("bigint").alias("conv_id")).agg(F.array_sort(F.collect_list(
        F.struct("l_linenumber", "l_partkey", "l_suppkey", piece.alias("p")))).alias("_c"))
    return g.select("conv_id", F.array_join(F.transform("_c", lambda x: x["p"]), " ").alias("text"))


SQL_TOOL_TEXTS = """
tt AS (
  SELECT CAST(l_orderkey AS BIGINT) AS conv_id,
         string_agg('Let me check. ' || CASE
           WHEN l_linenumber = 4 THEN '{"name":"query_knowledge_graph","arguments":"{\\"entity_name\\": \\"' || p_name || '\\"}"}'
           WHEN l_linenumber = 5 THEN '{"name":"query_knowledge_graph","arguments":{"entity_name":"' || p_name || '",}}'
           WHEN l_linenumber = 6 THEN '{"name":"query_knowledge_graph","arguments":{}}'
           WHEN l_linenumber = 7 THEN '{"name":"lookup","arguments":{"entity_name":"' || p_name || '"}}'
           ELSE '{"name":"query_knowledge_graph","arguments":{"entity_name":"'
                || CASE WHEN l_linenumber = 2 THEN upper(p_name) WHEN l_linenumber = 3 THEN 'unknown gadget' ELSE p_name END
                || '"}}' END || ' One moment.', ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS text
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
),
calls AS (
  SELECT conv_id, unnest(range(len(regexp_extract_all(text, '\\{[^{}]*"name"\\s*:\\s*"[^"]+"\\s*,\\s*"arguments"\\s*:\\s*\\{[^{}]*\\}[^{}]*\\}')))) AS call_pos,
         unnest(regexp_extract_all(text, '\\{[^{}]*"name"\\s*:\\s*"[^"]+"\\s*,\\s*"arguments"\\s*:\\s*\\{[^{}]*\\}[^{}]*\\}')) AS call
  FROM tt
),
parsed AS (
  SELECT conv_id, call_pos, json_extract_string(call, '$.name') AS name,
         json_extract_string(call, '$.arguments.entity_name') AS entity_name
  FROM calls WHERE json_valid(call) AND NOT regexp_matches(call, ',\\s*[}\\]]')
),
res AS (
  SELECT p.*, i.entity_id, i.key AS matched
  FROM parsed p LEFT JOIN idx i ON i.key = lower(regexp_replace(p.entity_name, '^\\s+|\\s+$', '', 'g'))
),
lines AS (
  SELECT conv_id, call_pos, entity_id, CASE
      WHEN name <> 'query_knowledge_graph' THEN NULL
      WHEN entity_name IS NULL OR entity_name = '' THEN 'missing entity_name'
      WHEN entity_id IS NULL THEN entity_name || ' not found'
      ELSE 'Found entity ' || matched || ' <KG_EMBEDDING>' END AS line
  FROM res
)"""


@register("N11_tool_results", "N1 N5 N9 N10 N11", kg=True, sql=f"""
WITH {SQL_INDEX},{SQL_TOOL_TEXTS}
SELECT conv_id, string_agg(line, chr(10) ORDER BY call_pos) || chr(10) AS tool_result
FROM lines WHERE line IS NOT NULL GROUP BY 1
""")
def n11_tool_results(spark, sf_dir):
    """Tool calls found by regex and parsed (N10), names resolved against the
    label index (N1, N5/N6, N9), one tool message per response (N11)."""
    t, idx, ge = index_df(spark, sf_dir)
    calls = lk.parse_tool_calls(tool_texts(t))
    res = lk.resolve_names(calls, idx, ge.select(F.col("id").alias("entity_id")))
    line = lk.tool_result_line("name", "entity_name", "status", "matched_name")
    lines = res.withColumn("line", line).filter(F.col("line").isNotNull())
    g = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("call_pos", "line"))).alias("_l"))
    return g.select("conv_id",
                    F.concat(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit("\n"))
                    .alias("tool_result"))


@register("N12_cumulative_entities", "N12", kg=True, sql=f"""
WITH {SQL_INDEX},{SQL_TOOL_TEXTS},
turns AS (
  SELECT CAST(o_custkey AS BIGINT) AS chat_id, CAST(o_orderkey AS BIGINT) AS conv_id,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS round,
         EXISTS (SELECT 1 FROM parsed p WHERE p.conv_id = o_orderkey) AS has_calls
  FROM orders
),
live AS (
  SELECT * FROM (SELECT *, bool_and(has_calls) OVER (PARTITION BY chat_id ORDER BY round) AS going FROM turns)
  WHERE going AND round < {lk.MAX_ROUNDS}
),
ok AS (SELECT conv_id, call_pos, entity_id FROM lines WHERE line LIKE 'Found entity %')
SELECT l.chat_id, CAST(l.round AS INTEGER) AS round,
       COALESCE(string_agg(k.entity_id, ',' ORDER BY e.round, k.call_pos), '') AS entities
FROM live l JOIN live e ON e.chat_id = l.chat_id AND e.round <= l.round LEFT JOIN ok k ON k.conv_id = e.conv_id
GROUP BY 1, 2
""")
def n12_cumulative_entities(spark, sf_dir):
    """A chat is one customer's orders in key order, a round one response with
    all its calls: the entities found so far after each round, in call order
    with repeats; a chat ends after 5 rounds or at a response without calls."""
    t, idx, ge = index_df(spark, sf_dir)
    res = lk.resolve_names(lk.parse_tool_calls(tool_texts(t)), idx, ge.select(F.col("id").alias("entity_id")))
    turn = Window.partitionBy("chat_id").orderBy("conv_id")
    turns = t.orders.select(F.col("o_custkey").cast("bigint").alias("chat_id"),
                            F.col("o_orderkey").cast("bigint").alias("conv_id")) \
        .withColumn("round", F.row_number().over(turn) - 1).where(F.col("round") < lk.MAX_ROUNDS)
    return lk.cumulative_entities(turns, res).select("chat_id", F.col("round").cast("int").alias("round"),
                                                     F.array_join("entities", ",").alias("entities"))


def typo_mentions(t):
    """Part names with the last character dropped or the first doubled, and
    customer names without their last digit (each such name is equally
    close to ten customers, so ties are decided by index order)."""
    p = t.part.select(F.lower("p_name").alias("n"))
    c = t.customer.select(F.lower("c_name").alias("n"))
    drop_last = F.expr("substring(n, 1, length(n) - 1)")
    double_first = F.concat(F.substring("n", 1, 1), F.col("n"))
    return (p.select(drop_last.alias("mention")).union(p.select(double_first.alias("mention")))
            .union(c.select(drop_last.alias("mention"))).distinct())


@register("N6_fuzzy_links", "N6", kg=True, sql=f"""
WITH {SQL_INDEX},
mentions AS (
  SELECT DISTINCT mention FROM (
    SELECT substr(lower(p_name), 1, length(p_name) - 1) AS mention FROM part
    UNION ALL SELECT substr(lower(p_name), 1, 1) || lower(p_name) FROM part
    UNION ALL SELECT substr(lower(c_name), 1, length(c_name) - 1) FROM customer)
),
exact AS (SELECT mention, entity_id, key AS entity_name, 1.0::DOUBLE AS confidence FROM mentions JOIN idx ON key = mention),
pairs AS (
  SELECT mention, key, entity_id, length(mention) AS la, length(key) AS lb FROM mentions JOIN idx
  ON abs(length(mention) - length(key)) <= (length(mention) + length(key)) // 10
  WHERE mention NOT IN (SELECT mention FROM exact) AND levenshtein(mention, key) <= (length(mention) + length(key)) // 10
),
masks AS (
  SELECT *, list_transform(range(1, la + 1), lambda i: list_sum(list_transform(range(1, lb + 1),
    lambda j: CASE WHEN mention[i] = key[j] THEN (1::BIGINT << (j - 1)) ELSE 0::BIGINT END))::BIGINT) AS m FROM pairs
),
lcs AS (
  SELECT mention, key, entity_id, la, lb,
         lb - bit_count(list_reduce(list_prepend((1::BIGINT << lb) - 1, m),
                        lambda v, x: ((v + (v & x)) | (v - (v & x))) & ((1::BIGINT << lb) - 1))) AS common FROM masks
),
best AS (
  SELECT *, row_number() OVER (PARTITION BY mention ORDER BY 2.0 * common / (la + lb) DESC, CAST(substr(entity_id, 2) AS BIGINT), key) AS rn
  FROM lcs WHERE 20 * common >= 9 * (la + lb)
)
SELECT * FROM exact
UNION ALL SELECT mention, entity_id, key, round(2.0 * common / (la + lb), 6)::DOUBLE FROM best WHERE rn = 1
""")
def n6_fuzzy_links(spark, sf_dir):
    """Best label per misspelt name with indel ratio >= 90 (exact labels first);
    candidates come from exact blocking, so no mention is compared with every
    label. The SQL twin scores all pairs within the length band, by a
    bit-parallel common subsequence."""
    t, idx, _ = index_df(spark, sf_dir)
    links = lk.link_mentions(typo_mentions(t), idx)
    return links.select("mention", "entity_id", "entity_name", F.round("confidence", 6).alias("confidence"))


def order_texts(t):
    """One request text per order: a role word and the ordered part names,
    or -- for pending orders -- a text with neither role nor known name."""
    li = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    g = li.groupBy(F.col("l_orderkey").cast("bigint").alias("text_id")).agg(F.array_sort(F.collect_list(
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name"))).alias("_p"))
    g = g.join(t.orders.select(F.col("o_orderkey").cast("bigint").alias("text_id"), "o_orderstatus"), "text_id")
    names = F.array_join(F.transform("_p", lambda x: x["p_name"]), " and ")
    text = F.when(F.col("o_orderstatus") == "P",
                  F.concat(F.lit("nothing to report about purchase "), F.col("text_id").cast("string")))\
        .otherwise(F.concat(F.lit("The director asked for "), names))
    return g.select("text_id", text.alias("text"))


#: The longest labels from the left in w(text_id, w): all word spans that are labels of
#: idx, the longest at each word, then a walk that steps over each span taken.
SQL_SPANS = """
sizes AS (SELECT DISTINCT len(string_split(key, ' ')) AS n FROM idx),
spans AS (
  SELECT text_id, pos, max(n) AS n FROM (
    SELECT text_id, pos, n, array_to_string(w[pos + 1:pos + n], ' ') AS mention
    FROM w, sizes, unnest(range(0, len(w) - n + 1)) AS t(pos)) JOIN idx ON key = mention GROUP BY text_id, pos
),
walk AS (
  SELECT text_id, 0 AS pos, w FROM w
  UNION ALL
  SELECT k.text_id, k.pos + coalesce(s.n, 1), k.w FROM walk k LEFT JOIN spans s ON s.text_id = k.text_id AND s.pos = k.pos
  WHERE k.pos < len(k.w)
),
ner AS (
  SELECT k.text_id, k.pos, s.n, array_to_string(k.w[k.pos + 1:k.pos + s.n], ' ') AS mention
  FROM walk k JOIN spans s ON s.text_id = k.text_id AND s.pos = k.pos
)"""


@register("N8_text_links", "N2 N3 N4 N5 N7 N8", kg=True, sql=f"""
WITH RECURSIVE {SQL_INDEX},
tx AS (
  SELECT CAST(l_orderkey AS BIGINT) AS text_id,
         CASE WHEN any_value(o_orderstatus) = 'P' THEN 'nothing to report about purchase ' || CAST(l_orderkey AS VARCHAR)
              ELSE 'The director asked for ' || string_agg(p_name, ' and ' ORDER BY l_linenumber, l_partkey, l_suppkey) END AS text
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey
),
w AS (SELECT text_id, string_split_regex(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+') AS w FROM tx),
{SQL_SPANS},
roles AS (
  SELECT text_id, unnest(range(len(r))) AS pos, unnest(r) AS mention
  FROM (SELECT text_id, regexp_extract_all(lower(text), '\\b(president|ceo|director|minister)\\b', 1) AS r FROM tx)
),
links AS (
  SELECT text_id, mention, entity_id, 1.0 AS confidence, pos AS mention_pos FROM ner JOIN idx ON key = mention
  UNION ALL SELECT text_id, mention, entity_id, 1.0, 1000000 + pos FROM roles JOIN idx ON key = mention
),
d AS (
  SELECT text_id, mention, entity_id, max(confidence) AS confidence, min(mention_pos) AS mention_pos
  FROM links GROUP BY 1, 2, 3
),
r AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY confidence DESC, mention_pos, entity_id) AS rank FROM d)
SELECT text_id, mention, entity_id, mention AS entity_name, confidence, CAST(rank AS INTEGER) AS rank
FROM r WHERE rank <= {TOP_LIMIT}
""")
def n8_text_links(spark, sf_dir):
    """Free-text linking: candidates (N2-N4), exact or fuzzy links (N5/N6),
    dedupe by max confidence (N7), best two per text (N8)."""
    t, idx, _ = index_df(spark, sf_dir)
    top = lk.extract(materialize(order_texts(t)), idx, TOP_LIMIT)
    return top.select("text_id", "mention", "entity_id", "entity_name",
                      F.col("confidence").cast("double").alias("confidence"),
                      F.col("rank").cast("int").alias("rank"))


def catalogue(t):
    """Every part under its full name of five words, beside the label index."""
    return t.part.select(F.lower(F.concat_ws(" ", "p_name", F.lit("made by"), "p_brand")).alias("key")).distinct()


@register("N4_gazetteer_mentions", "N4", kg=True, sql=f"""
WITH RECURSIVE {SQL_INDEX.replace("idx AS", "idx0 AS")},
idx AS (SELECT key FROM idx0 UNION SELECT lower(p_name || ' made by ' || p_brand) FROM part),
tx AS (
  SELECT CAST(l_orderkey AS BIGINT) AS text_id, string_agg(CASE l_linenumber % 3 WHEN 0 THEN p_name || ' made by  ' || p_brand
    WHEN 1 THEN p_name || ' made by ' || p_brand ELSE p_name || ' by ' || p_brand END, ' or ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS text
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
),
w AS (SELECT text_id, string_split_regex(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+') AS w FROM tx),
{SQL_SPANS}
SELECT text_id, pos::INTEGER AS pos, n::INTEGER AS n_words, mention FROM ner
""")
def n4_gazetteer_mentions(spark, sf_dir):
    """Parts named in order texts, by their full names (five words) or the short
    labels within them: the longest label at each place."""
    t, idx, _ = index_df(spark, sf_dir)
    li = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    kind = F.pmod("l_linenumber", F.lit(3))
    name = (F.when(kind == 0, F.concat("p_name", F.lit(" made by  "), "p_brand"))
            .when(kind == 1, F.concat("p_name", F.lit(" made by "), "p_brand"))
            .otherwise(F.concat("p_name", F.lit(" by "), "p_brand")))
    g = li.groupBy(F.col("l_orderkey").cast("bigint").alias("text_id")).agg(F.array_sort(F.collect_list(
        F.struct("l_linenumber", "l_partkey", "l_suppkey", name.alias("n")))).alias("_n"))
    texts = g.select("text_id", F.array_join(F.transform("_n", lambda x: x["n"]), " or ").alias("text"))
    return mentions(texts, idx.select("key").union(catalogue(t)))


@register("N9_resolution", "N9 N2 N3 N4 N5", kg=True, sql=f"""
WITH RECURSIVE {SQL_INDEX},
args AS (
  SELECT CAST(o_orderkey AS BIGINT) AS conv_id, CASE CAST(o_orderkey AS BIGINT) % 6 WHEN 0 THEN c_name
    WHEN 1 THEN 'the file of ' || c_name WHEN 2 THEN upper(r_name) || ' ' WHEN 3 THEN 'nobody at all'
    WHEN 4 THEN 'minister' ELSE 'director of ' || n_name END AS entity_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
),
w AS (
  SELECT entity_name AS text_id, string_split_regex(lower(regexp_replace(entity_name, '^\\s+|\\s+$', '', 'g')), '\\s+') AS w
  FROM (SELECT DISTINCT entity_name FROM args)
),
{SQL_SPANS},
best AS (
  SELECT * FROM (SELECT text_id, mention, entity_id, row_number() OVER (PARTITION BY text_id ORDER BY pos, entity_id) AS rn
                 FROM ner JOIN idx ON key = mention) WHERE rn = 1
),
has_graph AS (SELECT DISTINCT s AS entity_id FROM kg_triple WHERE o_type = 'uri')
SELECT conv_id, a.entity_name, b.entity_id, b.mention AS matched_name,
       CASE WHEN b.entity_id IS NULL THEN 'not found' WHEN h.entity_id IS NULL THEN 'no graph' ELSE 'ok' END AS status
FROM args a LEFT JOIN best b ON b.text_id = a.entity_name LEFT JOIN has_graph h ON h.entity_id = b.entity_id
""")
def n9_resolution(spark, sf_dir):
    """Arguments that are a name, hold a name, name a region (it is in the index but
    has no graph: no edge leaves it), or name nothing: all three statuses."""
    t, idx, _ = index_df(spark, sf_dir)
    _, tr, _, _, _ = kg_frames(spark, sf_dir)
    has_graph = tr.filter(F.col("o_type") == "uri").select(F.col("s").alias("entity_id")).distinct()
    o = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
         .join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey")))
    key = F.col("o_orderkey").cast("bigint")
    kind = F.pmod(key, F.lit(6))
    name = (F.when(kind == 0, F.col("c_name")).when(kind == 1, F.concat(F.lit("the file of "), "c_name"))
            .when(kind == 2, F.concat(F.upper("r_name"), F.lit(" "))).when(kind == 3, F.lit("nobody at all"))
            .when(kind == 4, F.lit("minister")).otherwise(F.concat(F.lit("director of "), "n_name")))
    calls = materialize(o.select(key.alias("conv_id"), name.alias("entity_name")))
    return lk.resolve_names(calls, idx, has_graph).select("conv_id", "entity_name", "entity_id", "matched_name", "status")
