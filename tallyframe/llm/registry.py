"""Queries of this package and the SQL they are compared with."""

from __future__ import annotations

from importlib import import_module
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

MODULES = [
    "pii", "packing", "chat", "spaced_seeds", "toxicity", "licenses", "neardup", "suffixes", "host_rules", "token_rollup",
    "simhash", "repair", "collocations",
]


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL where SQL can express it."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def load() -> None:
    for name in MODULES:
        import_module(f"tallyframe.llm.{name}")
