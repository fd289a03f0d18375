"""Named queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6
# Added before rounding: averages of short decimals often lie exactly on a tie, which
# summation order would break either way.
NUDGE = 1.3e-9


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, ties nudged up, negative zero removed."""
    changes = {
        f.name: F.round(F.col(f.name) + NUDGE, DIGITS) + F.lit(0.0)
        for f in df.schema.fields
        if f.dataType.typeName() == "double"
    }
    return df.withColumns(changes) if changes else df


def rnd(expr: str) -> str:
    """The same rounding in SQL."""
    return f"(round(({expr})::DOUBLE + {NUDGE}::DOUBLE, {DIGITS}) + 0.0::DOUBLE)"


def rnd_as(*names: str, source: str = "") -> str:
    return ", ".join(f"{rnd(source + n)} AS {n}" for n in names)
