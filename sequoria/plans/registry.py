"""Named queries of the library and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sequoria.plans import archive_plans, model_plans, sequence_plans, session_plans, table_plans, update_plans, vector_plans

_MODULES = (session_plans, sequence_plans, vector_plans, table_plans, archive_plans, model_plans, update_plans)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
