"""Named queries: ``name -> (callable(spark, sf_dir) -> DataFrame, oracle SQL)``.

Oracle SQL is DuckDB SQL over the driver tables (registered as views); it is
``None`` for queries SQL cannot express, which then get a rows-only check plus
a brute-force test in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from trellis.sources.kg_view import SQL_KG_CTE


@dataclass(frozen=True)
class Query:
    name: str
    ops: tuple[str, ...]
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, ops: str, sql: str | None = None, kg: bool = False):
    """Decorator. ``kg=True`` prepends the KG view CTEs to ``sql``, whose own
    CTE list (if any) must then start with a comma-free ``WITH``-less body."""

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        full = sql
        if sql is not None and kg:
            body = sql.strip()
            if body.upper().startswith("WITH RECURSIVE "):
                full = "WITH RECURSIVE " + SQL_KG_CTE + ",\n" + body[15:]
            elif body.upper().startswith("WITH "):
                full = "WITH " + SQL_KG_CTE + ",\n" + body[5:]
            else:
                full = "WITH " + SQL_KG_CTE + "\n" + body
        REGISTRY[name] = Query(name, tuple(ops.split()), fn, full)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # Importing the plan modules fills the registry.
    from trellis.plans import (  # noqa: F401
        dictionary, evaluate, graph, io, kg, link, linkpred, qa, runlog, sample, split, vector)

    return REGISTRY
