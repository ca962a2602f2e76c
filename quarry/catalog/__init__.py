"""Registry of the checked queries: one Spark job + (optionally) one DuckDB
oracle SQL per operator of the inventory.  ``__spark_entry__`` exposes it."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def load_all() -> None:
    from . import (q_dense, q_entities, q_entities2, q_eval, q_relational, q_search,  # noqa: F401
                   q_misc, q_models, q_pipelines, q_sources, q_text)
