"""Registry of named queries, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

SECTIONS = (
    "flagship",
    "snapshots", "sets_joins", "splits", "series", "text_features", "table_features", "modelling", "text_models", "tree_models",
    "decisions", "metrics", "paired", "reports", "audits", "requests", "episodes", "monitors", "files",
)


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return register


def load_all() -> None:
    for section in SECTIONS:
        import_module(f"casemeter.plans.{section}")
