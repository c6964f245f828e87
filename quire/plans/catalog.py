"""The registered queries: one per operator of the design inventory, each reading the
given tables (or data Spark derives from them) at ``sf_dir``, plus the equivalent SQL
that an independent engine runs on the same tables as a correctness oracle.

Queries are grouped by module; each module adds entries through ``register``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_all() -> None:
    """Import every query module (they register on import)."""
    from . import (q_audit, q_columns, q_detect, q_filters, q_keys, q_pipeline, q_profile, q_sources,  # noqa: F401
                   q_streaming)
