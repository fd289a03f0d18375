"""Named queries of this subpackage and, where one exists, the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = (
    "quality",
    "suffix_dedup",
    "divergence",
    "fuzzy_lines",
    "window_dedup",
    "decontaminate",
    "jaccard",
    "quotes",
    "pieces",
    "personal",
    "packing",
    "phrases",
    "prefix_trie",
)


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    for name in MODULES:
        import_module(f"pixloom.llm.{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
