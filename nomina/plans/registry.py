"""Registry of named queries: a Spark plan plus (optionally) its SQL oracle.

A query is ``fn(spark, sf_dir) -> DataFrame``.  Its oracle is DuckDB SQL over
the driver tables; ``payroll`` is available as a CTE in every oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nomina.sources.tables import PAYROLL_SQL

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def with_payroll(sql: str) -> str:
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return "WITH " + PAYROLL_SQL.strip() + ",\n" + body[4:].lstrip()
    return "WITH " + PAYROLL_SQL.strip() + "\n" + body


def query(key: str, sql: str | None = None, payroll: bool = True):
    """Register ``fn`` under ``key``; ``sql`` is its DuckDB oracle (None = rows-only)."""

    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_payroll(sql) if payroll else sql.strip()
        return fn

    return deco
