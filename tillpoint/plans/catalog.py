"""Registry of named queries: each has a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where SQL can express it, a DuckDB twin over the same driver tables.

Query names carry the SURVEY operator id they exercise (``p01_...``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: QueryFn
    sql: str | None
    ids: tuple[str, ...]
    note: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, ids: tuple[str, ...] | str, sql: str | None = None, note: str = ""):
    if isinstance(ids, str):
        ids = (ids,)

    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, tuple(ids), note)
        return fn
    return deco


MODULES = ("q_pivot", "q_ingest", "q_metrics", "q_customers", "q_discounts",
           "q_models", "q_stream", "q_scalars", "q_daily", "q_varied")


def load_all() -> dict[str, Query]:
    """Import the query modules (importing fills the registry)."""
    import importlib
    for m in MODULES:
        importlib.import_module(f"tillpoint.plans.{m}")
    return REGISTRY
