"""Name -> (query, oracle SQL) of everything registered outside the training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return register


def _load() -> None:
    from importlib import import_module

    for name in ("notices", "records", "pricing", "documents", "retrieval", "knowledge", "proposal", "state", "written", "gathered", "assembled", "presented"):
        import_module(f"bidlens.queries.{name}")


_load()
