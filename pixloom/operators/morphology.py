"""Binary morphology and local means over halo tiles.

A dense pixel grid is assumed (see ``pixels.densify``). An operator deals the pixels out once, by
image and tile with a halo as wide as all its steps reach, and runs its steps on the tiles with
running sums, so neither the number of steps nor the radius adds a shuffle and a very large image is
many tiles. ``radius`` is a radius: 3 means a 7x7 neighbourhood. A null mask is off, a null value 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixloom.operators.tiles import TILE, dense, map_tiles

_KEYS = ("image_id",)


def box_sum(planes: np.ndarray, half: int) -> np.ndarray:
    """Sum over the square of this half width around each cell, clamped at the border."""
    for axis in (1, 2):
        n = planes.shape[axis]
        total = np.zeros([s + (i == axis) for i, s in enumerate(planes.shape)], np.result_type(planes, np.int32))
        np.cumsum(planes, axis=axis, out=total[:, 1:] if axis == 1 else total[:, :, 1:])
        at = np.arange(n)
        planes = total.take(np.minimum(at + half + 1, n), axis) - total.take(np.maximum(at - half, 0), axis)
    return planes


def _steps(df: DataFrame, mask: str, steps: Sequence[tuple[str, int]]) -> DataFrame:
    steps = [(name, radius) for name, radius in steps if radius > 0]
    reach = sum(radius for _, radius in steps)
    if not steps:
        return df

    def change(planes, present):
        on = planes
        for name, radius in steps:
            full = 1 if name == "dilate" else (2 * radius + 1) ** 2
            on = (box_sum(on, radius) >= full) & present
        return on

    def work(starts, row, col, table):
        on = pc.fill_null(table.column(mask), False).to_numpy()
        return [dense(starts, row, col, on, change)]

    columns = df.columns
    out = map_tiles(df, _KEYS, work, [T.StructField(mask, T.BooleanType())], tile=max(TILE, reach), halo=reach)
    return out.select(*columns)


def dilate(df: DataFrame, mask: str, radius: int) -> DataFrame:
    return _steps(df, mask, [("dilate", radius)])


def erode(df: DataFrame, mask: str, radius: int) -> DataFrame:
    """Outside the image counts as off, so a border of ``radius`` always erodes."""
    return _steps(df, mask, [("erode", radius)])


def close(df: DataFrame, mask: str, radius: int) -> DataFrame:
    return _steps(df, mask, [("dilate", radius), ("erode", radius)])


def open_(df: DataFrame, mask: str, radius: int) -> DataFrame:
    return _steps(df, mask, [("erode", radius), ("dilate", radius)])


def close_open(df: DataFrame, mask: str, radius: int) -> DataFrame:
    return _steps(df, mask, [("dilate", radius), ("erode", 2 * radius), ("dilate", radius)])


def local_mean(df: DataFrame, value: str, window: int, out: str = "local_mean") -> DataFrame:
    """Mean over a window of half-width ``window div 2`` clamped at the border."""
    half = window // 2

    def work(starts, row, col, table):
        values = pc.fill_null(pc.cast(table.column(value), "double"), 0.0).to_numpy()
        mean = lambda planes, present: box_sum(planes, half) / np.maximum(box_sum(present, half), 1)
        return [dense(starts, row, col, values, mean)]

    return map_tiles(df, _KEYS, work, [T.StructField(out, T.DoubleType())], tile=max(TILE, half), halo=half)


def adaptive_threshold(
    df: DataFrame,
    value: str,
    window: int = 25,
    offset: float = 0.1,
    minimum: float = 0.0,
    out: str = "adaptive",
) -> DataFrame:
    """Strictly above the local mean plus offset and strictly above the minimum."""
    df = local_mean(df, value, window, "__mean")
    hit = (F.col(value) > F.col("__mean") + offset) & (F.col(value) > minimum)
    return df.withColumn(out, hit).drop("__mean")


def contour(df: DataFrame, mask: str, out: str = "contour") -> DataFrame:
    """Mask pixels with a 4-neighbour that is off or outside."""

    def change(on, present):
        wide = np.pad(on, ((0, 0), (1, 1), (1, 1)))
        solid = wide[:, :-2, 1:-1] & wide[:, 2:, 1:-1] & wide[:, 1:-1, :-2] & wide[:, 1:-1, 2:]
        return on & ~solid

    def work(starts, row, col, table):
        on = pc.fill_null(table.column(mask), False).to_numpy()
        return [dense(starts, row, col, on, change)]

    return map_tiles(df, _KEYS, work, [T.StructField(out, T.BooleanType())], halo=1)
