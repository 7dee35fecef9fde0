"""Vector queries (V1-V13, E5, K4) over ``embeddings``.

Codebook: step q uses the unit-normalised rows ``vec_id`` in [8q, 8q+8)
(FIXTURES: ``vec_id < 8*Q``); every embedding row is encoded.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trellis.operators import codebook as cbk
from trellis.operators import vector as vq
from trellis.plans.registry import register
from trellis.session import materialize, scratch_path
from trellis.sources.tables import Tables

Q = 4
K = 8
DEAD_THRESHOLD = 2
START_TOKEN, END_TOKEN = -1, -2


def codebook_df(t):
    e = t.embeddings.filter(F.col("vec_id") < Q * K)
    return e.select(F.expr(f"vec_id div {K}").cast("int").alias("step"),
                    F.pmod("vec_id", F.lit(K)).cast("int").alias("code"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def encode(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cb = vq.load_codebook(codebook_df(t))
    x = t.embeddings.select(F.col("vec_id").alias("id"),
                            F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    return t, vq.rvq_encode(x, cb)


SQL_RVQ = f"""
cb AS (
  SELECT step, list(c ORDER BY code) AS codes FROM (
    SELECT CAST(vec_id // {K} AS INTEGER) AS step, CAST(vec_id % {K} AS INTEGER) AS code,
           list_transform(embedding, lambda x: CAST(x AS DOUBLE) /
             sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS c
    FROM embeddings WHERE vec_id < {Q * K}) GROUP BY step
),
rvq AS (
  SELECT vec_id, 0 AS step, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS r,
         CAST(NULL AS INTEGER) AS code, CAST(NULL AS DOUBLE) AS alpha, CAST(NULL AS DOUBLE) AS cos,
         CAST(NULL AS DOUBLE[]) AS chosen
  FROM embeddings
  UNION ALL
  SELECT vec_id, step + 1, list_transform(range(len(r)), lambda i: r[i + 1] - a * c[i + 1]),
         best - 1, a, CASE WHEN a = 0.0 THEN 0.0 ELSE
           least(1.0, greatest(-1.0, a / sqrt(list_sum(list_transform(r, lambda x: x * x))))) END, c
  FROM (
    SELECT vec_id, step, r, best, scores[best] AS a, codes[best] AS c
    FROM (
      SELECT vec_id, step, r, codes,
             CASE WHEN sqrt(list_sum(list_transform(r, lambda x: x * x))) < 1e-9
                  THEN list_transform(scores, lambda x: 0.0) ELSE scores END AS scores,
             CASE WHEN sqrt(list_sum(list_transform(r, lambda x: x * x))) < 1e-9 THEN 1
                  ELSE list_position(scores, list_max(scores)) END AS best
      FROM (
        SELECT x.vec_id, x.step, x.r, cb.codes,
               list_transform(cb.codes, lambda cc: list_dot_product(x.r, cc)) AS scores
        FROM rvq x JOIN cb ON cb.step = x.step WHERE x.step < {Q}
      ) y0
    ) y1
  ) z
),
codes AS (
  SELECT vec_id, step - 1 AS step, code, alpha, cos, chosen,
         list_sum(list_transform(r, lambda x: x * x)) / len(r) AS leftover
  FROM rvq WHERE step > 0
)"""


@register("V3_rvq_codes", "V1 V2 V3", sql=f"""
WITH RECURSIVE {SQL_RVQ}
SELECT vec_id, CAST(step AS INTEGER) AS step, CAST(code AS INTEGER) AS code, round(alpha, 6) AS alpha FROM codes
""")
def v3_rvq_codes(spark, sf_dir):
    """Q-step directional encoding of every embedding: nearest code by
    cosine, projection residual update."""
    _, c = encode(spark, sf_dir)
    return c.select(F.col("id").alias("vec_id"), "step", "code", F.round("alpha", 6).alias("alpha"))


@register("V4_quantiser_stats", "V4 V5 V7 V8 V9", sql=f"""
WITH RECURSIVE {SQL_RVQ},
use AS (SELECT step, code, count(*) AS n FROM codes GROUP BY 1, 2),
allc AS (SELECT CAST(vec_id // {K} AS INTEGER) AS step, CAST(vec_id % {K} AS INTEGER) AS code FROM embeddings WHERE vec_id < {Q * K}),
dead AS (SELECT a.step, count(*) AS n_dead FROM allc a LEFT JOIN use u USING (step, code)
         WHERE COALESCE(u.n, 0) < {DEAD_THRESHOLD} GROUP BY 1),
ps AS (SELECT step, round({vq.BETA_COMMIT} * avg(1 - cos), 6) AS commit_loss,
              count(DISTINCT code) / {K} AS utilisation FROM codes GROUP BY 1)
SELECT CAST(ps.step AS INTEGER) AS step, ps.commit_loss, ps.utilisation, COALESCE(d.n_dead, 0) AS n_dead_codes,
       (SELECT avg(utilisation) FROM ps) AS overall_utilisation,
       (SELECT round(avg(leftover), 9) FROM codes WHERE step = {Q - 1}) AS leftover_energy
FROM ps LEFT JOIN dead d USING (step)
""")
def v4_quantiser_stats(spark, sf_dir):
    """Per step: commitment loss (V4), utilisation (V8), dead codes (V7);
    with the mean utilisation over steps (V9) and the leftover energy (V5)."""
    t, c = encode(spark, sf_dir)
    c = materialize(c)  # one encode for all measures
    left = c.groupBy("step").agg(F.avg(F.when(F.col("step") == Q - 1, F.col("leftover"))).alias("_left"))
    per = (vq.commitment_loss(c).join(vq.utilisation(c, K), "step").join(left, "step")
           .join(vq.dead_codes(c, codebook_df(t), DEAD_THRESHOLD).groupBy("step")
                 .agg(F.count(F.lit(1)).alias("n_dead_codes")), "step", "left"))
    # run-level values over the Q per-step rows (a window over Q rows only)
    allq = Window.partitionBy()
    return per.select(F.col("step").cast("int").alias("step"), F.round("commit_loss", 6).alias("commit_loss"),
                      "utilisation", F.coalesce("n_dead_codes", F.lit(0)).cast("bigint").alias("n_dead_codes"),
                      F.avg("utilisation").over(allq).alias("overall_utilisation"),
                      F.round(F.max("_left").over(allq), 9).alias("leftover_energy"))


def chosen_values(t, c):
    """(id, v, tokens): the chosen unit codes of each vector in step order, as one list,
    and their ids framed by start and end."""
    unit = codebook_df(t).select("step", "code", F.transform("vec", lambda x: x / F.sqrt(
        F.aggregate("vec", F.lit(0.0), lambda a, y: a + y * y))).alias("cvec"))
    j = c.join(F.broadcast(unit), ["step", "code"])  # Q x K rows
    g = j.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("step", "code", "cvec"))).alias("_s"))
    return g.select("id", F.flatten(F.transform("_s", lambda x: x["cvec"])).alias("v"),
                    F.concat(F.array(F.lit(START_TOKEN)), F.transform("_s", lambda x: x["code"]),
                             F.array(F.lit(END_TOKEN))).alias("tokens"))


@register("V13_kg_tokens", "V12 V13", sql=f"""
WITH RECURSIVE {SQL_RVQ},
sc AS (SELECT stddev_samp(CAST(x AS DOUBLE)) AS s FROM (SELECT unnest(embedding) AS x FROM embeddings)),
tok AS (
  SELECT vec_id, '{START_TOKEN},' || string_agg(CAST(code AS VARCHAR), ',' ORDER BY step) || ',{END_TOKEN}' AS tokens,
         flatten(list(chosen ORDER BY step)) AS v
  FROM codes GROUP BY 1
),
st AS (SELECT *, list_avg(v) AS mu FROM tok),
st2 AS (SELECT *, greatest(sqrt(list_sum(list_transform(v, lambda x: (x - mu) * (x - mu))) / (len(v) - 1)), 1e-6) AS sd FROM st)
SELECT vec_id, tokens, round((v[1] - mu) / sd * (SELECT s FROM sc), 6) AS std_first
FROM st2
""")
def v13_kg_tokens(spark, sf_dir):
    """Each vector's KG tokens: code ids framed by start/end (V13), and the
    chosen code vectors standardised per vector and scaled to the spread of
    the embedding table (V12); the first standardised value is reported."""
    t, c = encode(spark, sf_dir)
    scale = t.embeddings.select(F.explode("embedding").alias("x")) \
        .agg(F.stddev_samp(F.col("x").cast("double"))).first()[0]
    g = chosen_values(t, c)
    g = vq.standardise(g, "v", F.lit(float(scale)))
    return g.select(F.col("id").alias("vec_id"),
                    F.array_join(F.transform("tokens", lambda x: x.cast("string")), ",").alias("tokens"),
                    F.round(F.element_at("std_tokens", 1), 6).alias("std_first"))


@register("V10_mean_pool", "V10 V11", sql="""
WITH n AS (SELECT vec_id // 4 AS graph_id, vec_id % 4 AS node_pos, embedding FROM embeddings),
e AS (SELECT graph_id, node_pos, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM n)
SELECT CAST(graph_id AS BIGINT) AS graph_id, CAST(dim AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean,
       CAST(max(CASE WHEN node_pos = 0 THEN x END) AS DOUBLE) AS first_node
FROM e GROUP BY 1, 2
""")
def v10_mean_pool(spark, sf_dir):
    """Graphs of four consecutive node vectors: element-wise mean pool
    (V10) next to the first node's value (V11), per dimension."""
    t = Tables(spark, sf_dir)
    nodes = t.embeddings.select(F.expr("vec_id div 4").cast("bigint").alias("graph_id"),
                                F.pmod("vec_id", F.lit(4)).alias("node_pos"), "embedding")
    pool = vq.mean_pool(nodes, "graph_id", "embedding")
    first = nodes.filter(F.col("node_pos") == 0).select("graph_id", F.posexplode("embedding").alias("dim", "x"))
    return (pool.join(first, ["graph_id", "dim"], "left")
            .select("graph_id", F.col("dim").cast("int").alias("dim"), F.round("mean", 6).alias("mean"),
                    F.col("x").cast("double").alias("first_node")))


def fitted(spark, sf_dir, shared=False):
    t = Tables(spark, sf_dir)
    x = t.embeddings.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    dim = x.select(F.size("vec")).first()[0]
    return x, cbk.fit_codebook(x, Q, K, dim, shared=shared)


@register("V6_codebook_fit", "V6")
def v6_codebook_fit(spark, sf_dir):
    """All Q steps of the quantiser learned from the vectors: each code with the
    number of residuals that its step gave to it."""
    _, fit = fitted(spark, sf_dir)
    # Q x K rows of model, whatever the table
    return spark.createDataFrame([(s, c, int(n), [float(v) for v in fit.codes[s, c]])
                                  for s in range(Q) for c, n in enumerate(fit.sizes[s])],
                                 "step int, code int, size long, vec array<double>")


@register("V6_fit_invariants", "V6 V3 V5", sql=f"""
SELECT CAST(s AS INTEGER) AS step, {K}::BIGINT AS n_unit_codes, (SELECT count(*) FROM embeddings) AS n_vectors,
       (SELECT count(*) FROM embeddings) AS n_encoded, true AS same_sizes, true AS energy_falls
FROM range({Q}) AS r(s)
""")
def v6_fit_invariants(spark, sf_dir):
    """What holds for any fit: K unit codes a step, every vector counted once a step,
    the sizes equal those of an encode of the vectors with the fitted codes, and each
    step leaves less energy than the one before."""
    x, fit = fitted(spark, sf_dir)
    c = materialize(vq.rvq_encode(x, fit.codes))
    per = c.groupBy("step").agg(F.count(F.lit(1)).alias("n_encoded"), F.avg("leftover").alias("left"))
    use = c.groupBy("step", "code").agg(F.count(F.lit(1)).alias("n"))
    model = spark.createDataFrame([(s, k, int(n), bool(abs((fit.codes[s, k] ** 2).sum() - 1) < 1e-9))
                                   for s in range(Q) for k, n in enumerate(fit.sizes[s])],
                                  "step int, code int, size long, unit boolean")
    sizes = (model.join(use, ["step", "code"], "left").groupBy("step").agg(
        F.count_if("unit").alias("n_unit_codes"), F.sum("size").alias("n_vectors"),
        F.bool_and(F.col("size") == F.coalesce("n", F.lit(0))).alias("same_sizes")))
    before = F.lag("left").over(Window.partitionBy().orderBy("step"))  # Q rows
    return (per.withColumn("energy_falls", F.coalesce(F.col("left") < before, F.lit(True))).join(sizes, "step")
            .select("step", "n_unit_codes", "n_vectors", "n_encoded", "same_sizes", "energy_falls"))


@register("V9_utilisation", "V8 V9", sql=f"""
WITH RECURSIVE {SQL_RVQ}
SELECT CAST(step AS INTEGER) AS step, count(DISTINCT code) / {K} AS utilisation,
       avg(count(DISTINCT code) / {K}) OVER () AS overall_separate,
       (SELECT count(DISTINCT code) / {K} FROM codes) AS overall_shared
FROM codes GROUP BY step
""")
def v9_utilisation(spark, sf_dir):
    """Utilisation per step and over all steps, both for separate codebooks (the mean)
    and for a shared one (the union), from one encode and one set of bitmaps."""
    _, c = encode(spark, sf_dir)
    sets = materialize(cbk.code_sets(c))  # Q bitmaps
    return (cbk.set_utilisation(sets, K).withColumn("overall_separate", F.avg("utilisation").over(Window.partitionBy()))
            .join(cbk.shared_utilisation(sets, K).withColumnRenamed("shared_utilisation", "overall_shared").hint("broadcast"))
            .select("step", "utilisation", "overall_separate", "overall_shared"))


@register("V12_standardised_values", "V12", sql=f"""
WITH RECURSIVE {SQL_RVQ},
sc AS (SELECT stddev_samp(CAST(x AS DOUBLE)) AS s FROM (SELECT unnest(embedding) AS x FROM embeddings)),
bias AS (
  SELECT list(b ORDER BY d) AS b FROM (
    SELECT d, avg(x) AS b FROM (SELECT unnest(range(len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY d)
),
tok AS (SELECT vec_id, flatten(list(chosen ORDER BY step)) AS v FROM codes GROUP BY 1),
st AS (SELECT *, list_avg(v) AS mu FROM tok),
st2 AS (SELECT *, greatest(sqrt(list_sum(list_transform(v, lambda x: (x - mu) * (x - mu))) / (len(v) - 1)), 1e-6) AS sd FROM st)
SELECT vec_id, CAST(i AS INTEGER) AS pos, round((v[i + 1] - mu) / sd * s + b[i % len(b) + 1], 6) AS value
FROM st2, sc, bias, unnest(range(len(v))) AS t(i)
""")
def v12_standardised_values(spark, sf_dir):
    """Every value of each vector's KG tokens after standardisation, scaled to the
    spread of the embedding table and shifted by a bias vector (its mean row)."""
    t, c = encode(spark, sf_dir)
    e = t.embeddings.select(F.posexplode("embedding").alias("d", "x")).select("d", F.col("x").cast("double").alias("x"))
    by_dim = e.groupBy("d").agg(F.avg("x").alias("b"), F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    model = by_dim.orderBy("d").collect()  # a row a dimension: the bias and the moments
    n, total, squares = (sum(r[c] for r in model) for c in ("n", "s", "q"))
    scale = ((squares - total * total / n) / (n - 1)) ** 0.5
    g = materialize(chosen_values(t, c))
    g = vq.standardise(g, "v", F.lit(float(scale)), [r["b"] for r in model])
    return g.select(F.col("id").alias("vec_id"), F.posexplode("std_tokens").alias("pos", "x")) \
        .select("vec_id", "pos", F.round("x", 6).alias("value"))


def _e5_sql() -> str:
    from trellis.plans.dictionary import SQL_DICT
    from trellis.sources.kg_view import SQL_KG_CTE

    return f"""WITH {SQL_KG_CTE}, {SQL_DICT},
tri AS (
  SELECT d.id, d.ordinal, '  ' || COALESCE(d.label, '') || '  ' AS s FROM dict d
),
g AS (
  SELECT id, ordinal, CAST(('0x' || substr(md5(substr(s, i, 3)), 1, 8)) AS BIGINT) % 64 AS b
  FROM (SELECT id, ordinal, s, unnest(range(1, length(s) - 1)) AS i FROM tri)
),
c AS (SELECT id, ordinal, b, count(*) AS n FROM g GROUP BY 1, 2, 3),
nr AS (SELECT id, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1)
SELECT c.id, c.ordinal, 64 AS dim, round(sum(c.n / nr.norm * (c.b + 1)), 6) AS checksum
FROM c JOIN nr USING (id) GROUP BY 1, 2
"""


@register("E5_label_embeddings", "E5 K4 E6", sql=_e5_sql())
def e5_label_embeddings(spark, sf_dir):
    """Entity labels encoded in Arrow batches (hashed character trigrams by
    default), written as ``(id, ordinal, vec)`` with NaN -> 0 (K4) and read
    back; reported with a position-weighted checksum of each vector."""
    from trellis.plans.dictionary import entity_dict
    from trellis.sources import sinks

    d, _ = entity_dict(spark, sf_dir)
    emb = vq.hashed_ngram_embedding(d, "label").select("id", "ordinal", "vec")
    path = scratch_path(spark, "label-vectors")
    sinks.write_embeddings(emb, path)
    back = spark.read.parquet(path)
    weighted = F.aggregate(F.transform("vec", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return back.select("id", "ordinal", F.size("vec").alias("dim"), F.round(weighted, 6).alias("checksum"))
