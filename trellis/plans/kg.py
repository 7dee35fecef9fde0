"""Star-graph queries over the KG view (Q*, C1-C4, G*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.operators import star
from trellis.plans.registry import register
from trellis.sources import kg_view as kv
from trellis.session import stored
from trellis.sources.tables import Tables

N_TEXT = 3


def kg_frames(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t, kv.kg_triple(t), kv.kg_property(spark), kv.kg_label(t), kv.kg_rank(t)


def star_parts(spark, sf_dir, n):
    """``(tables, star edges, star centres)`` sharing one node table: labels
    and ranks are computed once (stored), not once per branch."""
    t, tr, pr, lb, rk = kg_frames(spark, sf_dir)
    nodes = stored(star.node_attributes(lb, rk), "kg-nodes")
    edges = star.star_edges_from_nodes(tr, pr, nodes, n=n)
    return t, edges, nodes.filter(F.col("label").isNotNull())


# SQL twin of the candidate-edge + top-n + collapse chain, reused below.
SQL_STAR = """
nodes AS (
  SELECT l.id,
         NULLIF(regexp_replace(translate(l.label, ';' || chr(9) || chr(10), '   '), '^\\s+|\\s+$', '', 'g'), '') AS label,
         COALESCE(r.rank, 0.5) AS rank
  FROM (SELECT id, arg_min(label, ord) AS label FROM kg_label WHERE lang = 'en' GROUP BY id) l
  LEFT JOIN kg_rank r ON r.id = l.id
),
cand AS (
  SELECT t.s AS center_id, t.p AS rel_id, pr.plabel AS rel_label, t.o AS nbr_id,
         n.label AS nbr_label, n.rank AS nbr_rank, t.ord
  FROM kg_triple t JOIN kg_property pr ON pr.p = t.p JOIN nodes n ON n.id = t.o
  WHERE t.o_type = 'uri' AND t.o LIKE 'Q%' AND n.label IS NOT NULL
    AND NOT starts_with(n.label, 'Category:') AND NOT starts_with(t.o, 'Template:')
    AND NOT starts_with(t.o, 'Wikipedia:') AND n.label <> t.o
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY center_id ORDER BY nbr_rank DESC,
         CAST(substr(nbr_id, 2) AS BIGINT), CAST(substr(rel_id, 2) AS BIGINT), ord) - 1 AS pos
  FROM cand
),
topn AS (SELECT * FROM ranked WHERE pos < {n}),
star_edge AS (
  SELECT center_id, nbr_id, min(pos) AS pos, arg_max(rel_id, pos) AS rel_id,
         arg_max(rel_label, pos) AS rel_label, any_value(nbr_label) AS nbr_label,
         any_value(nbr_rank) AS nbr_rank
  FROM topn GROUP BY center_id, nbr_id
)
"""


def sql_star(n: int) -> str:
    return SQL_STAR.replace("{n}", str(n))


@register("kg_star_text", "Q2 Q3 Q4 Q5 Q6 Q7 Q8 C1 C2 C3 C4 G1 G2 G3 G11", kg=True, sql=f"""
WITH {sql_star(N_TEXT)},
centers AS (SELECT id, label FROM nodes WHERE label IS NOT NULL)
SELECT e.center_id, CAST(count(*) AS BIGINT) AS n_edges,
       ' Information from the knowledge graph: '
       || string_agg(c.label || ' ' || e.rel_label || ' ' || e.nbr_label || '. ', '' ORDER BY e.pos)
       || chr(10) AS text
FROM star_edge e JOIN centers c ON c.id = e.center_id
GROUP BY e.center_id
""")
def kg_star_text(spark, sf_dir):
    """Minimum slice: every centre's 3 best neighbours as KG text."""
    _, edges, centers = star_parts(spark, sf_dir, N_TEXT)
    return star.textualise(edges, centers)


@register("Q6_neighbour_values", "Q6 Q2 C1 C4", kg=True, sql="""
WITH nodes AS (
  SELECT id, NULLIF(regexp_replace(translate(label, ';' || chr(9) || chr(10), '   '), '^\\s+|\\s+$', '', 'g'), '') AS label
  FROM (SELECT id, arg_min(label, ord) AS label FROM kg_label WHERE lang = 'en' GROUP BY id) l
)
SELECT t.s, t.p, t.o, t.o_type, t.ord, CASE WHEN t.o_type = 'uri' THEN n.label ELSE t.o END AS value
FROM kg_triple t LEFT JOIN nodes n ON n.id = t.o
""")
def q6_neighbour_values(spark, sf_dir):
    """Every triple's neighbour value: the label for an entity, the literal
    itself otherwise (before the entity-only filter of the star query)."""
    _, tr, _, lb, _ = kg_frames(spark, sf_dir)
    labels = star.english_labels(lb).withColumnRenamed("id", "o")
    return (tr.join(labels, "o", "left")
            .select("s", "p", "o", "o_type", "ord", star.neighbour_label("o", "o_type", "label").alias("value")))
