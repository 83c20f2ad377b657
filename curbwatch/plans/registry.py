"""The registered queries: name to (Spark plan, DuckDB statement)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Fixtures
from .oracle_base import sql

Plan = Callable[[Fixtures], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        PLANS[name] = plan
        if oracle is not None:
            SQL[name] = sql(oracle)
        return plan
    return add


def rounded(df: DataFrame, digits: int = 6, **names: str) -> DataFrame:
    """Round every double column so that two engines' last bits agree."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double":
            cols.append((F.round(F.col(f.name), digits) + 0.0).alias(f.name))
        elif f.dataType.typeName() in ("integer", "short", "byte"):
            cols.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import (  # noqa: F401
        queries_scoring, queries_events, queries_spatial, queries_graph, queries_sources, queries_learning, queries_records,
    )

    def bind(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: plan(Fixtures(spark, folder))

    return {n: bind(p) for n, p in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
