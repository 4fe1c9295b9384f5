"""Registry of named queries: each has a Spark builder ``(spark, sf_dir) -> DataFrame`` and, where SQL can
state it, an equivalent DuckDB SQL text over the raw input tables (used as the correctness oracle)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, note: str = ""):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, note)
        return fn

    return deco
