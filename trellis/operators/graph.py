"""Star-graph operators beyond assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions.text import numeric_id
from trellis.session import stored

NODE_LINK_SCHEMA = (
    "directed boolean, multigraph boolean, "
    "graph struct<central_node:string, central_node_label:string, central_node_rank:double>, "
    "nodes array<struct<id:string, label:string, rank:double>>, "
    "links array<struct<source:string, target:string, id:string, label:string>>, "
    "edges array<struct<source:string, target:string, id:string, label:string>>")


def sample_edges(edges: DataFrame, samples: DataFrame, drop: Column) -> DataFrame:
    """G6 + T3: each sample's subject star, edge by edge; where ``drop`` holds,
    without the edges to the sample's object. A star left without edges gives
    no row."""
    s = samples.select("sample_id", F.col("subject_id").alias("center_id"), "object_id", drop.alias("_drop"))
    return s.join(edges, "center_id").where(
        ~(F.col("_drop") & F.col("nbr_id").eqNullSafe(F.col("object_id")))).drop("_drop", "object_id")


def remove_object(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """G6 + G7: per sample, the subject's star without edges to the sample's
    object; the centre stays even when no edge is left (``n_edges = 0``)."""
    e = edges.select(F.col("center_id").alias("subject_id"), "nbr_id", "pos")
    j = samples.select("sample_id", "subject_id", "object_id").join(e, "subject_id", "left")
    kept = F.when(F.col("nbr_id").isNotNull() & (F.col("nbr_id") != F.col("object_id")), 1)
    return j.groupBy("sample_id", "subject_id").agg(
        F.count("nbr_id").alias("n_edges_before"), F.count(kept).alias("n_edges_after"))


def node_positions(edges: DataFrame) -> DataFrame:
    """Centre = node 0, neighbours 1..n in position order (per-star window,
    bounded by the top-n cut)."""
    w = Window.partitionBy("center_id").orderBy("pos")
    return edges.withColumn("node_pos", F.row_number().over(w))


def bidirectional_edges(edges: DataFrame) -> DataFrame:
    """Neighbour i -> centre at edge i-1, then centre -> neighbour i at
    edge n+i-1 (edge features are therefore doubled)."""
    e = node_positions(edges.where(F.col("center_id").isNotNull())).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("center_id")))
    pos = F.col("node_pos")
    both = F.array(F.struct((pos - 1).cast("bigint").alias("edge_pos"), pos.alias("src_pos"), F.lit(0).alias("dst_pos")),
                   F.struct((F.col("_n") + pos - 1).alias("edge_pos"), F.lit(0).alias("src_pos"), pos.alias("dst_pos")))
    return e.select("center_id", F.explode(both).alias("_b"), "rel_id").select("center_id", "_b.*", "rel_id")


def tool_edges(triples: DataFrame) -> DataFrame:
    """G9 + G16: each entity's out-edges; only an entity without out-edges
    uses its in-edges. The neighbour is the other end, self-loops are
    skipped, a missing relation id becomes ``edge::u->v``. Written as an
    anti-join (no per-entity window, so hub entities do not gather)."""
    out = triples.select(F.col("s").alias("entity"), F.col("o").alias("nbr"), "p",
                         F.lit("out").alias("direction"), F.col("s").alias("_u"), F.col("o").alias("_v"))
    has_out = triples.select(F.col("s").alias("entity")).distinct()
    inn = (triples.select(F.col("o").alias("entity"), F.col("s").alias("nbr"), "p",
                          F.lit("in").alias("direction"), F.col("s").alias("_u"), F.col("o").alias("_v"))
           .join(has_out, "entity", "left_anti"))
    e = out.unionByName(inn).filter(F.col("nbr") != F.col("entity"))
    rel = F.coalesce("p", F.concat(F.lit("edge::"), "_u", F.lit("->"), "_v"))
    return e.select("entity", "nbr", rel.alias("rel_id"), "direction")


def batch_offsets(stars: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Node offset of each graph inside its batch = running sum of the
    node counts before it (window per batch, bounded by the batch size)."""
    w = Window.partitionBy(batch_col).orderBy(numeric_id("center_id"), "center_id") \
        .rowsBetween(Window.unboundedPreceding, -1)
    return stars.withColumn("node_offset", F.coalesce(F.sum("n_nodes").over(w), F.lit(0)).cast("bigint"))


def subgraph_cap(edges: DataFrame, max_nodes: int = 40, node_chars: int = 40,
                 edge_chars: int = 25) -> DataFrame:
    """G12 + G14: the centre plus the first ``max_nodes - 1`` neighbours in
    edge order, labels cut to 40 (nodes) / 25 (edges) characters."""
    w = Window.partitionBy("center_id").orderBy("pos")
    e = edges.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_nodes - 1)
    return e.select("center_id", F.col("_rn").alias("node_pos"), "nbr_id",
                    F.substring(F.coalesce("nbr_label", "nbr_id"), 1, node_chars).alias("node_label"),
                    F.substring(F.coalesce("rel_label", "rel_id"), 1, edge_chars).alias("edge_label"))


def label_search(edges: DataFrame, centers: DataFrame, terms: DataFrame) -> DataFrame:
    """``terms(center_id, term)``; the first node (centre first, then by
    position) whose label equals the term ignoring case."""
    nodes = (centers.select(F.col("id").alias("center_id"), F.col("id").alias("node_id"),
                            "label", F.lit(-1).alias("pos"))
             .unionByName(edges.select("center_id", F.col("nbr_id").alias("node_id"),
                                       F.col("nbr_label").alias("label"), "pos")))
    j = terms.join(nodes, (terms.center_id == nodes.center_id)
                   & (F.lower(nodes.label) == F.lower(terms.term))).drop(nodes.center_id)
    return j.groupBy(terms.center_id, "term").agg(F.min_by("node_id", "pos").alias("found_node"))


def to_node_link(edges: DataFrame, centers: DataFrame) -> DataFrame:
    """K2: one node-link JSON document per star: ``(entity, json)``."""
    c = centers.select(F.col("id").alias("center_id"), F.col("label").alias("c_label"),
                       F.col("rank").alias("c_rank"))
    g = edges.groupBy("center_id").agg(F.sort_array(F.collect_list(F.struct(
        "pos", "nbr_id", "nbr_label", "nbr_rank", "rel_id", "rel_label"))).alias("_e"))
    g = g.join(c, "center_id")
    center_node = F.struct(F.col("center_id").alias("id"), F.col("c_label").alias("label"),
                           F.col("c_rank").alias("rank"))
    nodes = F.concat(F.array(center_node), F.transform("_e", lambda x: F.struct(
        x["nbr_id"].alias("id"), x["nbr_label"].alias("label"), x["nbr_rank"].alias("rank"))))
    links = F.transform("_e", lambda x: F.struct(
        F.col("center_id").alias("source"), x["nbr_id"].alias("target"),
        x["rel_id"].alias("id"), x["rel_label"].alias("label")))
    doc = F.struct(F.lit(True).alias("directed"), F.lit(False).alias("multigraph"),
                   F.struct(F.col("center_id").alias("central_node"), F.col("c_label").alias("central_node_label"),
                            F.col("c_rank").alias("central_node_rank")).alias("graph"),
                   nodes.alias("nodes"), links.alias("links"))
    return g.select(F.col("center_id").alias("entity"), F.to_json(doc).alias("json"))


def parse_node_link(docs: DataFrame) -> DataFrame:
    """G4 + G5: node-link JSON -> edge rows ``(center_id, pos, rel_id,
    rel_label, nbr_id, nbr_label, nbr_rank, star_shape_ok)``; the link list
    may be called ``links`` or ``edges``. A document is parsed once and its links
    find their nodes within it; only entities with several documents are joined."""
    twice = stored(docs.groupBy("entity").count().where("count > 1 or entity is null").select("entity"), "entities-twice")
    same = docs["entity"].eqNullSafe(twice["entity"])
    parsed = lambda d: d.select("entity", F.from_json("json", NODE_LINK_SCHEMA).alias("g"))
    d = parsed(docs.join(twice, same, "left_anti")).withColumn("_repeats", _repeats("g.nodes"))

    def found(target, i):
        # our own documents have the node of link i at place i + 1, behind the centre
        near = F.get("g.nodes", i + 1)
        return F.when(~F.col("_repeats") & (near["id"] == target), F.array(near)).otherwise(
            F.filter("g.nodes", lambda x: x["id"] == target))

    links = F.transform(_links(), lambda l, i: F.struct(i.alias("pos"), l.alias("l"), found(l["target"], i).alias("n")))
    e = d.select("entity", F.col("g.graph.central_node").alias("center_id"), F.explode(links).alias("x"))
    e = e.select("entity", "center_id", "x.pos", "x.l", F.explode_outer("x.n").alias("n"))
    e = e.select("entity", F.col("l.target").alias("nbr_id"), "center_id", "pos", F.col("l.source").alias("src"),
                 F.col("l.id").alias("rel_id"), F.col("l.label").alias("rel_label"),
                 F.col("n.label").alias("nbr_label"), F.col("n.rank").alias("nbr_rank"))
    return (e.unionByName(_join_nodes(parsed(docs.join(twice, same, "left_semi"))))
            .withColumn("star_shape_ok", F.col("src") == F.col("center_id")))


def _links() -> Column:
    return F.coalesce(F.col("g.links"), F.col("g.edges"))


def _repeats(nodes: str) -> Column:
    """Whether a node list names an id twice."""
    ids = F.filter(F.transform(nodes, lambda x: x["id"]), lambda i: i.isNotNull())
    return F.coalesce(F.size(F.array_distinct(ids)) < F.size(ids), F.lit(False))


def _join_nodes(d: DataFrame) -> DataFrame:
    """The links of parsed documents, joined to the nodes of the same entity."""
    nodes = d.select("entity", F.explode("g.nodes").alias("n")) \
        .select("entity", F.col("n.id").alias("nbr_id"), F.col("n.label").alias("nbr_label"),
                F.col("n.rank").alias("nbr_rank"))
    e = d.select("entity", F.col("g.graph.central_node").alias("center_id"),
                 F.posexplode(_links()).alias("pos", "l"))
    e = e.select("entity", "center_id", "pos", F.col("l.source").alias("src"),
                 F.col("l.target").alias("nbr_id"), F.col("l.id").alias("rel_id"),
                 F.col("l.label").alias("rel_label"))
    return e.join(nodes, ["entity", "nbr_id"], "left")
