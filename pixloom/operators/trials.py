"""Hyper-parameter grids, trial ranking, random batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixloom.functions.scalars import denormalise, draw_index, min_max_scale
from pixloom.operators.scale import blocked_rank

GRID_BLOCK = 1 << 16


def parameter_grid(lists: DataFrame) -> DataFrame:
    """All combinations of one row of value arrays.

    The combinations are numbered, block by block, and each number is decoded digit by digit into
    list positions, so rows are produced independently of each other.
    """
    names = lists.columns
    sizes = [F.size(n).cast("long") for n in names]
    total = sizes[0]
    for s in sizes[1:]:
        total = total * s
    zero = F.lit(0).cast("long")
    blocks = lists.withColumn("__total", total).withColumn(
        "__b", F.explode(F.sequence(zero, F.floor((F.col("__total") - 1) / GRID_BLOCK)))
    )
    first = F.col("__b") * GRID_BLOCK
    last = F.least(first + GRID_BLOCK, F.col("__total")) - 1
    numbered = blocks.repartition("__b").withColumn("__i", F.explode(F.sequence(first, last)))
    out, rest = [], F.col("__i")
    for name, size in zip(reversed(names), reversed(sizes), strict=True):
        out.append(F.element_at(name, (rest % size + 1).cast("int")).alias(name))
        rest = F.floor(rest / size)
    return numbered.select(F.col("__i").alias("trial"), *reversed(out))


def scale_grid(grid: DataFrame, bounds: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each parameter to [-1, 1] by the bounds of its list (one row: name_lo, name_hi)."""
    limits = {
        f"{n}_{side}": bounds.select(f"{n}_{side}").scalar() for n in names for side in ("lo", "hi")
    }
    return grid.withColumns(
        {n: min_max_scale(F.col(n), limits[f"{n}_lo"], limits[f"{n}_hi"]) for n in names}
    )


def list_bounds(lists: DataFrame) -> DataFrame:
    return lists.select(
        *[F.array_min(n).alias(f"{n}_lo") for n in lists.columns],
        *[F.array_max(n).alias(f"{n}_hi") for n in lists.columns],
    )


def denormalise_parameters(df: DataFrame, bounds: Mapping[str, tuple]) -> DataFrame:
    """Known parameters back to their range; other columns pass."""
    return df.withColumns({n: denormalise(F.col(n), lo, hi) for n, (lo, hi) in bounds.items()})


def rank_trials(trials: DataFrame, objective: str = "output", n: int | None = None) -> DataFrame:
    """Ascending objective; whole rows move together."""
    ordered = trials.orderBy(F.col(objective).asc(), *[c for c in trials.columns if c != objective])
    return ordered if n is None else ordered.limit(n)


def export_trials(
    trials: DataFrame,
    path: str,
    objective: str = "output",
    bounds: Mapping[str, tuple] | None = None,
) -> None:
    """Sorted CSV with a header, parameters in their own range when bounds are given."""
    table = trials if bounds is None else denormalise_parameters(trials, bounds)
    rank_trials(table, objective).write.mode("overwrite").option("header", True).csv(path)


def random_batch(df: DataFrame, n: int, seed: int, id_column: str, id_block: int = 4096):
    """``n`` uniform draws with replacement, by drawn row numbers and an equi-join."""
    numbered = blocked_rank(
        df, [], [("b", F.floor(F.col(id_column) / id_block))], [id_column], "__place"
    )
    size = df.agg(F.count(F.lit(1))).scalar()
    draws = df.sparkSession.range(n).select(
        F.col("id").alias("draw"), (draw_index(seed, "batch", size, F.col("id")) + 1).alias("__place")
    )
    return draws.join(numbered, "__place").drop("__place")
