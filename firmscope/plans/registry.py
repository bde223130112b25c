"""Registered queries: one Spark callable ``(spark, sf_dir) -> DataFrame`` and, where the
operator is SQL-expressible, one DuckDB oracle SQL string with the same column names.

Every query reads the driver's tables (through the stand-ins of ``sources.tables``) and
runs over them whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import q_ingest, q_intelligent, q_intent, q_leads, q_reporting, q_retrieval, q_search, q_streaming  # noqa: F401
