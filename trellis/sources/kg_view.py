"""Knowledge-graph view over the driver tables.

The reference reads triples, labels and ranks from a remote graph store; here
they are DataFrames derived from the TPC-H-like tables so that every job
grows with the data:

* ``kg_entity(id, kind, key, label, rank)``
* ``kg_triple(s, p, o, o_type, ord)``   (``ord`` = order of the result rows)
* ``kg_property(p, plabel)``
* ``kg_label(id, lang, label, ord)``
* ``kg_rank(id, rank)``                 (missing id = default rank 0.5)
* ``kg_freebase(qid, fbid, ord)``       (the ``/m/...`` cross-reference)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.sources.tables import Tables

# Id offsets per entity kind, and the property vocabulary.
ID_OFFSET = {
    "region": 100000000,
    "nation": 200000000,
    "customer": 300000000,
    "supplier": 400000000,
    "part": 500000000,
    "order": 600000000,
}
PROPERTIES = [
    ("P1", "in region"),
    ("P2", "has nation"),
    ("P3", "based in"),
    ("P4", "placed"),
    ("P5", "contains part"),
    ("P6", "supplied by"),
    ("P7", "order status"),
    ("P8", "market segment"),
]


def qid(kind: str, key) -> F.Column:
    """``Q<offset + key>`` as a string column."""
    col = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit("Q"), (col.cast("bigint") + F.lit(ID_OFFSET[kind])).cast("string"))


def kg_entity(t: Tables) -> DataFrame:
    def part_(df, kind, key, label, rank):
        return df.select(
            qid(kind, key).alias("id"), F.lit(kind).alias("kind"),
            F.col(key).cast("bigint").alias("key"), label.alias("label"),
            (rank if rank is not None else F.lit(None)).cast("double").alias("rank"))

    return (part_(t.region, "region", "r_regionkey", F.col("r_name"), None)
            .unionByName(part_(t.nation, "nation", "n_nationkey", F.col("n_name"), None))
            .unionByName(part_(t.customer, "customer", "c_custkey", F.col("c_name"), F.col("c_acctbal")))
            .unionByName(part_(t.supplier, "supplier", "s_suppkey", F.col("s_name"), F.col("s_acctbal")))
            .unionByName(part_(t.part, "part", "p_partkey", F.col("p_name"), F.col("p_retailprice")))
            .unionByName(part_(t.orders, "order", "o_orderkey",
                               F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")),
                               F.col("o_totalprice"))))


def kg_triple(t: Tables) -> DataFrame:
    """Each source table is scanned once; a row that yields two triples
    (a line item: order -> part and order -> supplier) emits both through
    ``explode``."""
    def edge(p, s, o, ord_col=None, o_type="uri"):
        return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(o_type).alias("o_type"),
                        (ord_col if ord_col is not None else F.lit(0)).cast("int").alias("ord"))

    def rows(df, *edges):
        return df.select(F.explode(F.array(*edges)).alias("_e")).select("_e.*")

    return (rows(t.nation, edge("P1", qid("nation", "n_nationkey"), qid("region", "n_regionkey")))
            .unionByName(rows(t.customer,
                              edge("P2", qid("customer", "c_custkey"), qid("nation", "c_nationkey")),
                              edge("P8", qid("customer", "c_custkey"), F.col("c_mktsegment"), o_type="literal")))
            .unionByName(rows(t.supplier, edge("P3", qid("supplier", "s_suppkey"), qid("nation", "s_nationkey"))))
            .unionByName(rows(t.orders,
                              edge("P4", qid("customer", "o_custkey"), qid("order", "o_orderkey")),
                              edge("P7", qid("order", "o_orderkey"), F.col("o_orderstatus"), o_type="literal")))
            .unionByName(rows(t.lineitem,
                              edge("P5", qid("order", "l_orderkey"), qid("part", "l_partkey"), F.col("l_linenumber")),
                              edge("P6", qid("order", "l_orderkey"), qid("supplier", "l_suppkey"),
                                   F.col("l_linenumber")))))


def kg_property(spark: SparkSession) -> DataFrame:
    """The property vocabulary: a bounded dimension table (a local relation
    with size statistics, so joins against it broadcast)."""
    rows = ", ".join(f"('{p}', '{lbl}')" for p, lbl in PROPERTIES)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {rows} AS v(p, plabel)"))


def kg_label(t: Tables) -> DataFrame:
    """English labels for every entity (``ord`` 0); parts also carry their type
    as a second English label and their brand as a French one."""
    ent = kg_entity(t).select("id", F.lit("en").alias("lang"), "label", F.lit(0).alias("ord"))
    part = t.part
    return (ent
            .unionByName(part.select(qid("part", "p_partkey").alias("id"), F.lit("en").alias("lang"),
                                     F.col("p_type").alias("label"), F.lit(1).alias("ord")))
            .unionByName(part.select(qid("part", "p_partkey").alias("id"), F.lit("fr").alias("lang"),
                                     F.col("p_brand").alias("label"), F.lit(2).alias("ord"))))


def kg_rank(t: Tables) -> DataFrame:
    return kg_entity(t).filter(F.col("rank").isNotNull()).select("id", "rank")


def kg_freebase(t: Tables) -> DataFrame:
    """``(qid, fbid, ord)``: each customer is tagged ``/m/n<nationkey>``, so a
    Freebase id has many bindings and "first binding" (lowest ``ord`` = custkey)
    matters."""
    return t.customer.select(
        qid("customer", "c_custkey").alias("qid"),
        F.concat(F.lit("/m/n"), F.col("c_nationkey").cast("string")).alias("fbid"),
        F.col("c_custkey").cast("bigint").alias("ord"))


# ---------------------------------------------------------------- SQL twin
# The same view for the DuckDB oracle; it is plain SQL so oracle queries can
# prepend it as CTEs.
def _q(off: int, key: str) -> str:
    return f"('Q' || CAST(CAST({key} AS BIGINT) + {off} AS VARCHAR))"


SQL_KG_CTE = f"""
kg_entity AS (
  SELECT {_q(100000000, 'r_regionkey')} AS id, 'region' AS kind, CAST(r_regionkey AS BIGINT) AS key, r_name AS label, CAST(NULL AS DOUBLE) AS rank FROM region
  UNION ALL SELECT {_q(200000000, 'n_nationkey')}, 'nation', CAST(n_nationkey AS BIGINT), n_name, CAST(NULL AS DOUBLE) FROM nation
  UNION ALL SELECT {_q(300000000, 'c_custkey')}, 'customer', CAST(c_custkey AS BIGINT), c_name, CAST(c_acctbal AS DOUBLE) FROM customer
  UNION ALL SELECT {_q(400000000, 's_suppkey')}, 'supplier', CAST(s_suppkey AS BIGINT), s_name, CAST(s_acctbal AS DOUBLE) FROM supplier
  UNION ALL SELECT {_q(500000000, 'p_partkey')}, 'part', CAST(p_partkey AS BIGINT), p_name, CAST(p_retailprice AS DOUBLE) FROM part
  UNION ALL SELECT {_q(600000000, 'o_orderkey')}, 'order', CAST(o_orderkey AS BIGINT), 'Order ' || CAST(o_orderkey AS VARCHAR), CAST(o_totalprice AS DOUBLE) FROM orders
),
kg_triple AS (
  SELECT {_q(200000000, 'n_nationkey')} AS s, 'P1' AS p, {_q(100000000, 'n_regionkey')} AS o, 'uri' AS o_type, 0 AS ord FROM nation
  UNION ALL SELECT {_q(300000000, 'c_custkey')}, 'P2', {_q(200000000, 'c_nationkey')}, 'uri', 0 FROM customer
  UNION ALL SELECT {_q(400000000, 's_suppkey')}, 'P3', {_q(200000000, 's_nationkey')}, 'uri', 0 FROM supplier
  UNION ALL SELECT {_q(300000000, 'o_custkey')}, 'P4', {_q(600000000, 'o_orderkey')}, 'uri', 0 FROM orders
  UNION ALL SELECT {_q(600000000, 'l_orderkey')}, 'P5', {_q(500000000, 'l_partkey')}, 'uri', CAST(l_linenumber AS INTEGER) FROM lineitem
  UNION ALL SELECT {_q(600000000, 'l_orderkey')}, 'P6', {_q(400000000, 'l_suppkey')}, 'uri', CAST(l_linenumber AS INTEGER) FROM lineitem
  UNION ALL SELECT {_q(600000000, 'o_orderkey')}, 'P7', o_orderstatus, 'literal', 0 FROM orders
  UNION ALL SELECT {_q(300000000, 'c_custkey')}, 'P8', c_mktsegment, 'literal', 0 FROM customer
),
kg_property AS (
  SELECT * FROM (VALUES {", ".join(f"('{p}', '{lbl}')" for p, lbl in PROPERTIES)}) AS v(p, plabel)
),
kg_label AS (
  SELECT id, 'en' AS lang, label, 0 AS ord FROM kg_entity
  UNION ALL SELECT {_q(500000000, 'p_partkey')}, 'en', p_type, 1 FROM part
  UNION ALL SELECT {_q(500000000, 'p_partkey')}, 'fr', p_brand, 2 FROM part
),
kg_rank AS (SELECT id, rank FROM kg_entity WHERE rank IS NOT NULL),
kg_freebase AS (
  SELECT {_q(300000000, 'c_custkey')} AS qid, '/m/n' || CAST(c_nationkey AS VARCHAR) AS fbid,
         CAST(c_custkey AS BIGINT) AS ord FROM customer
)
"""
