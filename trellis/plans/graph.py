"""Star-graph queries (G4-G10, G12-G16, K2, S6) over the KG view."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.operators import graph as gr
from trellis.operators import star
from trellis.operators.ordinal import dense_ordinal
from trellis.functions.text import numeric_id
from trellis.plans.kg import kg_frames, sql_star, star_parts
from trellis.plans.registry import register
from trellis.session import scratch_path
from trellis.sources import kg_view as kv
from trellis.sources.derived import SQL_SAMPLES, sentence_samples

GRAPH_BATCH = 8
N_WHOLE = 10_000  # the callers' limit: whole stars
VIS_MAX_NODES = 40  # the callers' limit: the centre and 39 neighbours


def stars(spark, sf_dir, n):
    return star_parts(spark, sf_dir, n)


@register("G6_object_removal", "G6 G7", kg=True, sql=f"""
WITH {sql_star(10_000)},{SQL_SAMPLES}
SELECT s.sample_id, s.subject_id, count(e.nbr_id) AS n_edges_before,
       count(CASE WHEN e.nbr_id IS NOT NULL AND e.nbr_id <> s.object_id THEN 1 END) AS n_edges_after
FROM samples s LEFT JOIN star_edge e ON e.center_id = s.subject_id
GROUP BY 1, 2
""")
def g6_object_removal(spark, sf_dir):
    """Each sentence sample's subject star without the edge to its object;
    a star can end up empty but keeps its centre."""
    t, edges, _ = stars(spark, sf_dir, N_WHOLE)
    return gr.remove_object(edges, sentence_samples(t))


@register("G8_edge_index", "G8", kg=True, sql=f"""
WITH {sql_star(10_000)},
e AS (SELECT *, row_number() OVER (PARTITION BY center_id ORDER BY pos) AS node_pos,
             count(*) OVER (PARTITION BY center_id) AS n FROM star_edge)
SELECT center_id, CAST(node_pos - 1 AS BIGINT) AS edge_pos, CAST(node_pos AS INTEGER) AS src_pos, 0 AS dst_pos, rel_id FROM e
UNION ALL
SELECT center_id, CAST(n + node_pos - 1 AS BIGINT), 0, CAST(node_pos AS INTEGER), rel_id FROM e
""")
def g8_edge_index(spark, sf_dir):
    _, edges, _ = stars(spark, sf_dir, N_WHOLE)
    b = gr.bidirectional_edges(edges)
    return b.select("center_id", F.col("edge_pos").cast("bigint").alias("edge_pos"),
                    F.col("src_pos").cast("int").alias("src_pos"), F.col("dst_pos").cast("int").alias("dst_pos"),
                    "rel_id")


@register("G9_tool_edges", "G9 G16 L1", kg=True, sql="""
WITH t AS (SELECT s, p, o FROM kg_triple WHERE o_type = 'uri'),
has_out AS (SELECT DISTINCT s AS entity FROM t),
e AS (
  SELECT s AS entity, o AS nbr, COALESCE(p, 'edge::' || s || '->' || o) AS rel_id, 'out' AS direction FROM t
  UNION ALL
  SELECT o, s, COALESCE(p, 'edge::' || s || '->' || o), 'in' FROM t WHERE o NOT IN (SELECT entity FROM has_out)
)
SELECT entity, nbr, rel_id, direction FROM e WHERE nbr <> entity
""")
def g9_tool_edges(spark, sf_dir):
    """Per entity: its out-edges, or its in-edges when it has none."""
    t, tr, _, _, _ = kg_frames(spark, sf_dir)
    return gr.tool_edges(tr.filter(F.col("o_type") == "uri").select("s", "p", "o"))


@register("G10_graph_batches", "G10 E4", kg=True, sql=f"""
WITH {sql_star(10_000)},
g AS (SELECT center_id, CAST(count(*) + 1 AS BIGINT) AS n_nodes FROM star_edge GROUP BY 1),
o AS (SELECT *, CAST((row_number() OVER (ORDER BY CAST(substr(center_id, 2) AS BIGINT), center_id) - 1) // {GRAPH_BATCH} AS BIGINT) AS batch_id FROM g)
SELECT center_id, batch_id, n_nodes,
       CAST(COALESCE(sum(n_nodes) OVER (PARTITION BY batch_id ORDER BY CAST(substr(center_id, 2) AS BIGINT), center_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS node_offset
FROM o
""")
def g10_graph_batches(spark, sf_dir):
    """Stars in numeric centre order, batches of 8 graphs, node offsets of
    each graph inside its batch."""
    _, edges, _ = stars(spark, sf_dir, N_WHOLE)
    g = edges.groupBy("center_id").agg((F.count(F.lit(1)) + 1).cast("bigint").alias("n_nodes"))
    g = dense_ordinal(g, numeric_id("center_id"), [numeric_id("center_id"), F.col("center_id")], name="_ord")
    g = g.withColumn("batch_id", F.floor(F.col("_ord") / GRAPH_BATCH).cast("bigint")).drop("_ord")
    return gr.batch_offsets(g).select("center_id", "batch_id", "n_nodes", "node_offset")


@register("G12_subgraph_cap", "G12 G14", kg=True, sql=f"""
WITH {sql_star(10000)},
e AS (SELECT *, row_number() OVER (PARTITION BY center_id ORDER BY pos) AS rn FROM star_edge)
SELECT center_id, CAST(rn AS INTEGER) AS node_pos, nbr_id, substr(COALESCE(nbr_label, nbr_id), 1, 40) AS node_label,
       substr(COALESCE(rel_label, rel_id), 1, 25) AS edge_label
FROM e WHERE rn <= {VIS_MAX_NODES - 1}
""")
def g12_subgraph_cap(spark, sf_dir):
    """Drawing cut of each full star: centre + first neighbours up to 8
    nodes, labels cut to 40/25 characters."""
    _, edges, _ = stars(spark, sf_dir, 10000)
    c = gr.subgraph_cap(edges, VIS_MAX_NODES)
    return c.select("center_id", F.col("node_pos").cast("int").alias("node_pos"), "nbr_id", "node_label",
                    "edge_label")


@register("G13_label_search", "G13", kg=True, sql=f"""
WITH {sql_star(10_000)},
centers AS (SELECT id, label FROM nodes WHERE label IS NOT NULL),
terms AS (
  SELECT 'Q' || CAST(CAST(c_custkey AS BIGINT) + 300000000 AS VARCHAR) AS center_id, lower(n_name) AS term
  FROM customer JOIN nation ON c_nationkey = n_nationkey
),
nd AS (
  SELECT id AS center_id, id AS node_id, label, -1 AS pos FROM centers
  UNION ALL SELECT center_id, nbr_id, nbr_label, pos FROM star_edge
)
SELECT t.center_id, t.term, arg_min(nd.node_id, nd.pos) AS found_node
FROM terms t JOIN nd ON nd.center_id = t.center_id AND lower(nd.label) = lower(t.term)
GROUP BY 1, 2
""")
def g13_label_search(spark, sf_dir):
    """Search each customer's star for its nation by a lower-cased name."""
    t, edges, centers = stars(spark, sf_dir, N_WHOLE)
    terms = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        kv.qid("customer", "c_custkey").alias("center_id"), F.lower("n_name").alias("term"))
    return gr.label_search(edges, centers, terms)


@register("G15_star_statistics", "G15", kg=True, sql=f"""
WITH {sql_star(10_000)},
centers AS (SELECT id, label FROM nodes WHERE label IS NOT NULL)
SELECT e.center_id, c.label AS center_label, count(*) AS n_edges,
       CAST(count(DISTINCT e.nbr_id) + 1 - max(CASE WHEN e.nbr_id = e.center_id THEN 1 ELSE 0 END) AS BIGINT) AS n_nodes,
       arg_min(e.nbr_label, e.pos) AS first_nbr_label
FROM star_edge e JOIN centers c ON c.id = e.center_id GROUP BY 1, 2
""")
def g15_star_statistics(spark, sf_dir):
    _, edges, centers = stars(spark, sf_dir, N_WHOLE)
    return star.star_statistics(edges, centers)


@register("G4_star_json_roundtrip", "K2 S6 G4 G5", kg=True, sql=f"""
WITH {sql_star(10_000)}
SELECT center_id, CAST(row_number() OVER (PARTITION BY center_id ORDER BY pos) - 1 AS INTEGER) AS pos,
       rel_id, rel_label, nbr_id, nbr_label, nbr_rank, TRUE AS star_shape_ok
FROM star_edge
""")
def g4_star_json_roundtrip(spark, sf_dir):
    """Stars written as node-link JSON documents (K2) into the shared
    checkpoint folder, read back (S6) and parsed into edges (G4); every
    link must start at the centre (G5)."""
    from trellis.sources import readers, sinks

    _, edges, centers = stars(spark, sf_dir, N_WHOLE)
    path = scratch_path(spark, "star-docs")
    sinks.write_star_documents(gr.to_node_link(edges, centers), path)
    docs = readers.read_star_documents(spark, path)
    p = gr.parse_node_link(docs)
    return p.select("center_id", F.col("pos").cast("int").alias("pos"), "rel_id", "rel_label", "nbr_id",
                    "nbr_label", "nbr_rank", "star_shape_ok")
