"""Star graphs: 1-hop out-neighbourhoods of a centre, top-N by rank.

Edge-list form: ``star_edge(center_id, pos, rel_id, rel_label, nbr_id,
nbr_label, nbr_rank)``; the centre itself is ``star_center(id, label, rank)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions.text import clean_label, last_segment, numeric_id

DEFAULT_RANK = 0.5
KG_TEXT_HEAD = " Information from the knowledge graph: "


def english_labels(kg_label: DataFrame) -> DataFrame:
    """Q2: first English label per id (lowest ``ord``), cleaned."""
    return (kg_label.filter(F.col("lang") == "en")
            .groupBy("id")
            .agg(F.min_by("label", "ord").alias("raw_label"))
            .select("id", clean_label("raw_label").alias("label")))


def node_attributes(kg_label: DataFrame, kg_rank: DataFrame) -> DataFrame:
    """``(id, label, rank)``: Q2 label, C3 rank default. Labels and ranks are
    both keyed by id, so they are joined once here and the edge table is
    shuffled only once against the result."""
    return (english_labels(kg_label)
            .join(kg_rank, "id", "left")
            .select("id", "label", F.coalesce(F.col("rank"), F.lit(DEFAULT_RANK)).alias("rank")))


def candidate_edges(kg_triple: DataFrame, kg_property: DataFrame,
                    nodes: DataFrame) -> DataFrame:
    """Q3-Q7 + C2: every out-edge of every centre with a usable label.

    * Q4: only entity neighbours (URI starting with ``Q``); the filter is on a
      scan column and reaches the parquet reader through the union.
    * Q6: a literal neighbour would use its own value as label; Q4 removes
      literals before that matters, so the literal branch is kept only in
      :func:`neighbour_label`.
    * Q5/Q7: no label -> no edge (inner join on a non-null label).
    * C2: ``Category:`` labels, ``Template:``/``Wikipedia:`` ids and
      label == id are dropped.
    """
    props = kg_property.select("p", clean_label("plabel").alias("rel_label")) \
        .filter(F.col("rel_label").isNotNull())
    t = kg_triple.filter((F.col("o_type") == "uri") & F.col("o").startswith("Q"))
    e = (t.join(props, "p")
         .join(nodes.withColumnRenamed("id", "o"), "o")
         .select(F.col("s").alias("center_id"),
                 last_segment("p").alias("rel_id"), "rel_label",
                 last_segment("o").alias("nbr_id"),
                 F.col("label").alias("nbr_label"),
                 F.col("rank").alias("nbr_rank"), "ord"))
    return e.filter(F.col("nbr_label").isNotNull()
                    & ~F.col("nbr_label").startswith("Category:")
                    & ~F.col("nbr_id").startswith("Template:")
                    & ~F.col("nbr_id").startswith("Wikipedia:")
                    & (F.col("nbr_label") != F.col("nbr_id")))


def neighbour_label(o, o_type, label) -> F.Column:
    """Q6: URI neighbours take their label, literals their own value."""
    return F.when(F.col(o_type) == "uri", F.col(label)).otherwise(F.col(o))


def top_n(edges: DataFrame, n: int) -> DataFrame:
    """G1: per centre, the ``n`` best edges by rank (desc); ties by numeric
    neighbour id, numeric relation id, then result order. ``pos`` is 0-based.

    The filter on ``row_number()`` is planned as WindowGroupLimit, which runs
    a partial top-n per map partition *before* the shuffle, so a hub centre
    with a third of all edges ships at most ``n`` rows per partition.
    """
    w = Window.partitionBy("center_id").orderBy(
        F.col("nbr_rank").desc(), numeric_id("nbr_id"), numeric_id("rel_id"), F.col("ord"))
    return (edges.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= n)
            .withColumn("pos", F.col("_rn") - 1)
            .drop("_rn"))


def collapse_multi_edges(edges: DataFrame) -> DataFrame:
    """A simple digraph keeps one edge per (centre, neighbour); the position
    is that of the first edge, relation id/label those of the last one."""
    return (edges.groupBy("center_id", "nbr_id")
            .agg(F.min("pos").alias("pos"),
                 F.max_by("rel_id", "pos").alias("rel_id"),
                 F.max_by("rel_label", "pos").alias("rel_label"),
                 F.first("nbr_label").alias("nbr_label"),
                 F.first("nbr_rank").alias("nbr_rank")))


def star_edges(kg_triple: DataFrame, kg_property: DataFrame, kg_label: DataFrame,
               kg_rank: DataFrame, n: int = 10000) -> DataFrame:
    """G3 edge part: candidate edges -> G1 -> G2."""
    return star_edges_from_nodes(kg_triple, kg_property, node_attributes(kg_label, kg_rank), n)


def star_edges_from_nodes(kg_triple: DataFrame, kg_property: DataFrame, nodes: DataFrame,
                          n: int = 10000) -> DataFrame:
    """As :func:`star_edges`, with a precomputed node table."""
    return collapse_multi_edges(top_n(candidate_edges(kg_triple, kg_property, nodes), n))


def star_centers(kg_label: DataFrame, kg_rank: DataFrame) -> DataFrame:
    """Q8: a centre needs a label; its rank defaults to 0.5."""
    return node_attributes(kg_label, kg_rank).filter(F.col("label").isNotNull())


def textualise(edges: DataFrame, centers: DataFrame) -> DataFrame:
    """``" Information from the knowledge graph: "`` followed by
    ``"{centre} {relation} {neighbour}. "`` per edge in position order, then NL.

    One row per centre with at least one edge: ``(center_id, n_edges, text)``.
    The per-centre list is bounded by the top-n cut.
    """
    c = centers.select(F.col("id").alias("center_id"), F.col("label").alias("center_label"))
    piece = F.concat_ws(" ", "center_label", "rel_label", "nbr_label")
    g = (edges.join(c, "center_id")
         .groupBy("center_id")
         .agg(F.count(F.lit(1)).alias("n_edges"),
              F.sort_array(F.collect_list(F.struct("pos", F.concat(piece, F.lit(". ")).alias("t"))))
              .alias("_parts")))
    return g.select("center_id", "n_edges",
                    F.concat(F.lit(KG_TEXT_HEAD),
                             F.concat_ws("", F.transform("_parts", lambda x: x["t"])),
                             F.lit("\n")).alias("text"))


def star_statistics(edges: DataFrame, centers: DataFrame) -> DataFrame:
    """Nodes, edges and the first neighbour labels per star."""
    c = centers.select(F.col("id").alias("center_id"), F.col("label").alias("center_label"))
    g = edges.groupBy("center_id").agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.count_distinct("nbr_id").alias("n_nbrs"),
        F.sum(F.when(F.col("nbr_id") == F.col("center_id"), 1).otherwise(0)).alias("n_self_loops"),
        F.min_by("nbr_label", "pos").alias("first_nbr_label"))
    return (g.join(c, "center_id")
            .select("center_id", "center_label", "n_edges",
                    (F.col("n_nbrs") + 1 - F.when(F.col("n_self_loops") > 0, 1).otherwise(0))
                    .cast("bigint").alias("n_nodes"),
                    "first_nbr_label"))
