"""The query registry: each query is declared beside its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(spark, sf_dir)`` under ``name``; ``sql`` is what it is held against."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return register


def load() -> None:
    """Imports every module that declares queries."""
    from gridlark.plans import dashboard, detection, evidence, gates, handoff, index, stix, streams, workspace  # noqa: F401
