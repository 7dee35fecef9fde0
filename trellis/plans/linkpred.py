"""Link-prediction queries (L1-L8) over whole stars with vectors from
``embeddings`` (entity row = numeric id mod #rows; relation row = 7919 x
numeric id mod #rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trellis.functions.text import numeric_id
from trellis.operators import graph as gr
from trellis.operators import linkpred as lp
from trellis.operators import star
from trellis.plans.kg import kg_frames, sql_star
from trellis.plans.registry import register
from trellis.session import stored

N_STAR = 10_000  # the callers' limit: whole stars


def frames(spark, sf_dir):
    t, tr, pr, lb, rk = kg_frames(spark, sf_dir)
    edges = star.star_edges(tr, pr, lb, rk, n=N_STAR)
    vecs = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    n_vec = vecs.count()  # one number to the driver
    ent = lambda c: F.pmod(numeric_id(c), F.lit(n_vec))
    rel = lambda c: F.pmod(numeric_id(c) * F.lit(7919), F.lit(n_vec))
    w = Window.partitionBy("center_id").orderBy("pos")
    e = edges.withColumn("node_pos", F.row_number().over(w)) \
        .withColumn("c_row", ent("center_id")).withColumn("n_row", ent("nbr_id")).withColumn("r_row", rel("rel_id"))
    # the edge table (ids and vector rows, one shuffle by graph) is computed once; vectors
    # never travel with edges
    light = stored(e.select(F.col("center_id").alias("graph_id"), "nbr_id", "rel_id", "node_pos", "c_row", "n_row", "r_row"), "link-edges")
    # the centre stands before its first neighbour
    centre = F.struct(F.col("graph_id").alias("node_id"), F.lit(0).alias("node_pos"), F.col("c_row").alias("row"))
    nbr = F.struct(F.col("nbr_id").alias("node_id"), "node_pos", F.col("n_row").alias("row"))
    ids = light.select("graph_id", F.inline(F.when(F.col("node_pos") == 1, F.array(centre, nbr)).otherwise(F.array(nbr))))
    return light, ids, vecs.select(F.col("vec_id").alias("row"), "vec")


SQL_LP = f"""{sql_star(N_STAR)},
nv AS (SELECT count(*) AS n FROM embeddings),
vec AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
e AS (
  SELECT s.center_id AS graph_id, s.center_id, s.nbr_id, s.rel_id,
         row_number() OVER (PARTITION BY s.center_id ORDER BY s.pos) AS node_pos,
         cv.v AS c_vec, nvv.v AS n_vec, rv.v AS r_vec
  FROM star_edge s
  JOIN vec cv ON cv.vec_id = CAST(substr(s.center_id, 2) AS BIGINT) % (SELECT n FROM nv)
  JOIN vec nvv ON nvv.vec_id = CAST(substr(s.nbr_id, 2) AS BIGINT) % (SELECT n FROM nv)
  JOIN vec rv ON rv.vec_id = (CAST(substr(s.rel_id, 2) AS BIGINT) * 7919) % (SELECT n FROM nv)
),
gnodes AS (
  SELECT DISTINCT graph_id, center_id AS node_id, 0 AS node_pos, c_vec AS vec FROM e
  UNION ALL SELECT graph_id, nbr_id, node_pos, n_vec FROM e
),
bank AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY node_pos) AS rn FROM gnodes) WHERE rn <= 50),
dots AS (
  SELECT r.graph_id, r.rel_id, b.node_pos,
         list_sum(list_transform(range(len(r.c_vec)), lambda i: r.c_vec[i + 1] * b.vec[i + 1])) AS cx,
         list_sum(list_transform(range(len(r.c_vec)), lambda i: r.r_vec[i + 1] * b.vec[i + 1])) AS rx
  FROM (SELECT graph_id, rel_id, any_value(c_vec) AS c_vec, any_value(r_vec) AS r_vec FROM e GROUP BY 1, 2) r
  JOIN bank b ON b.graph_id = r.graph_id
),
sc AS (
  SELECT e.graph_id, e.nbr_id, e.rel_id, b.node_id AS cand_id,
         d.cx + d.rx AS score,
         CASE WHEN b.node_id = e.nbr_id THEN 1 ELSE 0 END AS positive
  FROM e JOIN bank b ON b.graph_id = e.graph_id
  JOIN dots d ON d.graph_id = e.graph_id AND d.rel_id = e.rel_id AND d.node_pos = b.node_pos
)"""


@register("L5_link_ranks", "L1 L2 L3 L4 L5", kg=True, sql=f"""
WITH {SQL_LP},
pos AS (SELECT DISTINCT graph_id, nbr_id, rel_id, score AS pos_score FROM sc WHERE positive = 1)
SELECT s.graph_id, s.nbr_id, s.rel_id, count(*) AS n_candidates,
       CAST(CASE WHEN max(p.pos_score) IS NOT NULL THEN sum(CASE WHEN s.score > p.pos_score THEN 1 ELSE 0 END) + 1 END AS INTEGER) AS rank
FROM sc s LEFT JOIN pos p USING (graph_id, nbr_id, rel_id)
GROUP BY 1, 2, 3
""")
def l5_link_ranks(spark, sf_dir):
    """Each star edge scored against the first 50 nodes of its graph with
    ``(centre + relation) . candidate``; rank of the true neighbour."""
    light, ids, vrow = frames(spark, sf_dir)
    r = lp.rank_blocks(lp.score_blocks(light, lp.candidate_bank(ids), vrow))
    return r.select("graph_id", "nbr_id", "rel_id", "n_candidates", "rank")


@register("L7_link_losses", "L6 L7 L8", kg=True, sql=f"""
WITH {SQL_LP}
SELECT (SELECT round(avg(list_sum(list_transform(range(len(c_vec)), lambda i: power(c_vec[i + 1] + r_vec[i + 1] - n_vec[i + 1], 2))) / len(c_vec)), 6) FROM e) AS mse,
       (SELECT round(avg(greatest(score, 0.0) - score * positive + ln(1 + exp(-abs(score)))), 6) FROM sc) AS bce,
       (SELECT count(*) FROM sc) AS n_pairs,
       (SELECT CAST(max(3 * len(c_vec)) AS INTEGER) FROM e) AS feature_dim,
       (SELECT round(sum(list_sum(list_transform(range(len(c_vec)), lambda i: 2 * c_vec[i + 1]))), 6) FROM e) AS feature_sum
""")
def l7_link_losses(spark, sf_dir):
    """MSE between the predicted ``centre + relation`` vector and the
    neighbour (L6), masked BCE over the candidate scores (L7), and the
    ``[ni, nj, ni - nj]`` pair features (L8) summarised."""
    light, ids, vrow = frames(spark, sf_dir)
    losses = lp.block_loss(lp.score_blocks(light, lp.candidate_bank(ids), vrow))
    m = lp.edge_sums(light, vrow).select(F.round(F.col("mse") / F.col("n"), 6).alias("mse"), F.col("dim").cast("int").alias("feature_dim"),
                                         F.round("features", 6).alias("feature_sum"))
    b = losses.agg(F.round(F.sum("loss") / F.sum("n"), 6).alias("bce"), F.sum("n").alias("n_pairs"))
    # two one-row aggregates side by side: union, then one row (no join)
    cols = ["mse", "bce", "n_pairs", "feature_dim", "feature_sum"]
    m = m.select(*[F.col(c) if c in m.columns else F.lit(None).alias(c) for c in cols])
    b = b.select(*[F.col(c) if c in b.columns else F.lit(None).alias(c) for c in cols])
    u = m.unionByName(b, allowMissingColumns=False)
    return u.agg(*[F.max(c).alias(c) for c in cols])


@register("L2_masked_banks", "L1 L2 L3 L5 G9", kg=True, sql="""
WITH t AS (SELECT s, p, o FROM kg_triple WHERE o_type = 'uri'),
has_out AS (SELECT DISTINCT s AS entity FROM t),
e AS (
  SELECT DISTINCT entity, nbr, rel_id, direction FROM (
    SELECT s AS entity, o AS nbr, p AS rel_id, 'out' AS direction FROM t
    UNION ALL SELECT o, s, p, 'in' FROM t WHERE o NOT IN (SELECT entity FROM has_out)) WHERE nbr <> entity
),
nodes AS (
  SELECT entity, entity AS node, 0 AS kind, 0 AS num FROM e GROUP BY entity
  UNION ALL SELECT DISTINCT entity, nbr, 1, CAST(substr(nbr, 2) AS BIGINT) FROM e
),
bank AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY kind, num) - 1 AS pos FROM nodes) WHERE pos < 50),
real AS (SELECT entity, count(*) AS n FROM bank GROUP BY entity),
nv AS (SELECT count(*) AS n FROM embeddings),
vec AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
q AS (
  SELECT r.entity, r.rel_id, b.pos, list_dot_product(list_transform(range(len(cv.v)), lambda i: cv.v[i + 1] + rv.v[i + 1]), nvv.v) AS score
  FROM (SELECT DISTINCT entity, rel_id FROM e) r JOIN bank b USING (entity)
  JOIN vec cv ON cv.vec_id = CAST(substr(r.entity, 2) AS BIGINT) % (SELECT n FROM nv)
  JOIN vec rv ON rv.vec_id = (CAST(substr(r.rel_id, 2) AS BIGINT) * 7919) % (SELECT n FROM nv)
  JOIN vec nvv ON nvv.vec_id = CAST(substr(b.node, 2) AS BIGINT) % (SELECT n FROM nv)
),
lists AS (SELECT entity, rel_id, list(score) AS scores FROM q GROUP BY 1, 2)
SELECT e.entity AS graph_id, e.rel_id, e.nbr AS nbr_id, e.direction, 50 AS width, r.n::INTEGER AS n_real, (50 - r.n)::INTEGER AS n_masked,
       COALESCE(b.pos, -1)::INTEGER AS target_pos,
       CASE WHEN b.pos IS NOT NULL THEN (len(list_filter(l.scores, lambda x: x > q.score)) + 1)::INTEGER END AS rank
FROM e JOIN real r USING (entity) JOIN lists l ON l.entity = e.entity AND l.rel_id = e.rel_id
LEFT JOIN bank b ON b.entity = e.entity AND b.node = e.nbr
LEFT JOIN q ON q.entity = e.entity AND q.rel_id = e.rel_id AND q.pos = b.pos
""")
def l2_masked_banks(spark, sf_dir):
    """Every entity's graph, by its in-edges where it has no out-edges (L1): the padded
    bank of 50 with its mask (L2), the place of the neighbour in it (L3), -inf for masked
    scores and the rank among the real ones (L5)."""
    t, tr, _, _, _ = kg_frames(spark, sf_dir)
    vecs = t.embeddings.select(F.col("vec_id").alias("row"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    n_vec = vecs.count()
    ent = lambda c: F.pmod(numeric_id(c), F.lit(n_vec))
    e = stored(gr.tool_edges(tr.filter(F.col("o_type") == "uri").select("s", "p", "o")).distinct(), "link-edges")
    # out- or in-edges: one direction a graph
    edges = e.select(F.col("entity").alias("graph_id"), "rel_id", F.col("nbr").alias("nbr_id"), "direction",
                     F.pmod(numeric_id("rel_id") * F.lit(7919), F.lit(n_vec)).alias("r_row"))
    place = lambda kind, num: F.struct(F.lit(kind).alias("kind"), num.cast("long").alias("num")).alias("node_pos")
    nodes = (e.select(F.col("entity").alias("graph_id"), F.col("entity").alias("node_id"), place(0, F.lit(0)), ent("entity").alias("row")).distinct()
             .unionByName(e.select(F.col("entity").alias("graph_id"), F.col("nbr").alias("node_id"), place(1, numeric_id("nbr")),
                                   ent("nbr").alias("row")).distinct()))
    r = lp.rank_blocks(lp.score_blocks(edges, lp.candidate_bank(nodes), vecs, carry=("direction",)), ("direction",))
    return r.select("graph_id", "rel_id", "nbr_id", "direction", "width", (F.col("width") - F.col("n_masked")).alias("n_real"), "n_masked",
                    "target_pos", "rank")
