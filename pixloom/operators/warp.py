"""Marker correspondence and thin-plate-spline dewarping."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixloom.functions import raster
from pixloom.functions.geometry import tps_kernel
from pixloom.operators.components import detect_markers
from pixloom.operators.resample import map_images

MODES = ("corners_4", "grid_2x2", "grid_3x3", "auto", "preserve_relative")


def canonical_positions(
    markers: DataFrame,
    mode: str = "corners_4",
    size: tuple[int, int] | None = None,
    margin: float = 10.0,
    spacing: float | None = None,
) -> DataFrame:
    """Ideal (target_row, target_col) of each marker slot, per image.

    ``markers``: (image_id, marker, centroid_row, centroid_col). Without ``size``
    the canvas is taken from the outermost centroids. Layout modes give at most
    4 or 9 targets; further markers get none.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    image = W.partitionBy("image_id")
    row, col = F.col("centroid_row"), F.col("centroid_col")
    df = markers.select("image_id", "marker", "centroid_row", "centroid_col").withColumns(
        {
            "n": F.count(F.lit(1)).over(image),
            "r0": F.min(row).over(image),
            "r1": F.max(row).over(image),
            "c0": F.min(col).over(image),
            "c1": F.max(col).over(image),
        }
    )
    if size is None:
        height, width = F.ceil(F.col("r1") + 2 * margin), F.ceil(F.col("c1") + 2 * margin)
    else:
        height, width = F.lit(size[0]), F.lit(size[1])
    df = df.withColumns({"canvas_h": height.cast("double"), "canvas_w": width.cast("double")})
    h, w, slot = F.col("canvas_h"), F.col("canvas_w"), F.col("marker") - 1
    low = F.lit(float(margin))
    if mode == "corners_4":
        df = df.where(F.col("marker") <= 4)
        target_row = F.when(F.col("marker") <= 2, low).otherwise(h - margin)
        target_col = F.when(F.col("marker").isin(1, 4), low).otherwise(w - margin)
    elif mode in ("grid_2x2", "grid_3x3"):
        side = 2 if mode == "grid_2x2" else 3
        df = df.where(F.col("marker") <= side * side)
        step = (F.least(h, w) - 2 * margin) / (side - 1) if spacing is None else F.lit(spacing)
        target_row = F.floor(slot / side) * step + margin
        target_col = (slot % side) * step + margin
    elif mode == "auto":
        df = df.withColumns(
            {
                "nr": F.size(F.collect_set(F.rint(row)).over(image)),
                "nc": F.size(F.collect_set(F.rint(col)).over(image)),
            }
        )

        def snapped(value, lo, hi, n):
            step = (hi - lo) / (n - 1)
            place = F.when(step > 0, F.rint((value - lo) / step) * step).otherwise(0.0)
            return F.coalesce(place, F.lit(0.0)) + margin

        target_row = snapped(row, F.col("r0"), F.col("r1"), F.nullif(F.col("nr"), F.lit(1)))
        target_col = snapped(col, F.col("c0"), F.col("c1"), F.nullif(F.col("nc"), F.lit(1)))
    else:

        def stretched(value, lo, hi, extent):
            share = F.when(hi > lo, (value - lo) / (hi - lo)).otherwise(0.0)
            return share * (extent - 2 * margin) + margin

        target_row = stretched(row, F.col("r0"), F.col("r1"), h)
        target_col = stretched(col, F.col("c0"), F.col("c1"), w)
    return df.select(
        "image_id",
        F.col("marker").alias("target"),
        target_row.cast("double").alias("target_row"),
        target_col.cast("double").alias("target_col"),
        "canvas_h",
        "canvas_w",
    )


def match_spatial_order(markers: DataFrame, targets: DataFrame) -> DataFrame:
    """Both sides ranked by (row, col); equal ranks are pairs, the longer side is cut."""
    by_marker = W.partitionBy("image_id").orderBy("centroid_row", "centroid_col", "marker")
    by_target = W.partitionBy("image_id").orderBy("target_row", "target_col", "target")
    left = markers.withColumn("rank", F.row_number().over(by_marker))
    right = targets.withColumn("rank", F.row_number().over(by_target))
    return left.select("image_id", "rank", "marker", "centroid_row", "centroid_col").join(
        right.select("image_id", "rank", "target", "target_row", "target_col"),
        ["image_id", "rank"],
    ).drop("rank")


_PAIR = (
    "image_id {id}, marker int, centroid_row double, centroid_col double,"
    " target int, target_row double, target_col double"
)


def match_nearest_greedy(markers: DataFrame, targets: DataFrame) -> DataFrame:
    """In marker order, each takes the nearest target still free, of equally near ones the smallest.

    Distances are equal if they are to nine digits: a marker as far from two corners would otherwise be
    dealt by the last bit of a sum. A group holds one image's markers, at most twenty after ``top_markers``.
    """

    def pair(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("marker"), right.sort_values("target")
        spots = right[["target_row", "target_col"]].to_numpy(float)
        free = np.ones(len(right), dtype=bool)
        rows = []
        for m in left.itertuples():
            if not free.any():
                break
            d = np.round(np.hypot(spots[:, 0] - m.centroid_row, spots[:, 1] - m.centroid_col), 9)
            k = int(np.argmin(np.where(free, d, np.inf)))
            free[k] = False
            t = right.iloc[k]
            rows.append((key[0], m.marker, m.centroid_row, m.centroid_col,
                         int(t["target"]), spots[k, 0], spots[k, 1]))
        names = ["image_id", "marker", "centroid_row", "centroid_col",
                 "target", "target_row", "target_col"]
        return pd.DataFrame(rows, columns=names)

    kind = markers.schema["image_id"].dataType.simpleString()
    keyed = targets.select(
        F.col("image_id").alias("target_image"), "target", "target_row", "target_col"
    )
    return (
        markers.groupBy("image_id")
        .cogroup(keyed.groupBy("target_image"))
        .applyInPandas(pair, _PAIR.format(id=kind))
    )


def correspond(markers: DataFrame, targets: DataFrame, method: str = "spatial_order"):
    if method == "spatial_order":
        return match_spatial_order(markers, targets)
    if method == "nearest":
        return match_nearest_greedy(markers, targets)
    raise ValueError("method is 'spatial_order' or 'nearest'")


def fit_tps(points: DataFrame, regularisation: float = 0.0) -> DataFrame:
    """One small linear solve per image.

    ``points``: (image_id, from_row, from_col, to_row, to_col), at least three.
    The model holds the control points and, per output coordinate, one weight
    per point followed by the affine part (constant, row, col). Images with too
    few or collinear points get a status and no weights.
    """
    kind = points.schema["image_id"].dataType.simpleString()
    schema = (
        f"image_id {kind}, status string, ctrl_row array<double>, ctrl_col array<double>,"
        " w_row array<double>, w_col array<double>"
    )

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        src = pdf[["from_row", "from_col"]].to_numpy(float)
        dst = pdf[["to_row", "to_col"]].to_numpy(float)
        n = len(src)
        status, weights = "ok", None
        affine = np.column_stack([np.ones(n), src])
        if n < 3 or np.linalg.matrix_rank(affine) < 3:
            status = "too few points" if n < 3 else "collinear points"
        else:
            r = np.hypot(src[:, None, 0] - src[None, :, 0], src[:, None, 1] - src[None, :, 1])
            k = np.where(r < 1e-10, 0.0, r**2 * np.log(np.maximum(r, 1e-10)))
            k = k + regularisation * np.eye(n)
            top = np.hstack([k, affine])
            bottom = np.hstack([affine.T, np.zeros((3, 3))])
            system = np.vstack([top, bottom])
            try:
                weights = np.linalg.solve(system, np.vstack([dst, np.zeros((3, 2))]))
            except np.linalg.LinAlgError:
                status = "singular"
        return pd.DataFrame(
            {
                "image_id": [key[0]],
                "status": [status],
                "ctrl_row": [src[:, 0]],
                "ctrl_col": [src[:, 1]],
                "w_row": [None if weights is None else weights[:, 0]],
                "w_col": [None if weights is None else weights[:, 1]],
            }
        )

    return points.groupBy("image_id").applyInPandas(solve, schema)


def tps_value(row: Column, col: Column, weights: str) -> Column:
    """Affine part plus weighted kernels; model columns are on the same row."""
    n = F.size("ctrl_row")
    terms = F.zip_with(
        F.arrays_zip("ctrl_row", "ctrl_col"),
        F.slice(F.col(weights), F.lit(1), n),
        lambda p, w: w * tps_kernel(F.hypot(row - p["ctrl_row"], col - p["ctrl_col"])),
    )
    bent = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    part = [F.element_at(weights, -3), F.element_at(weights, -2), F.element_at(weights, -1)]
    return part[0] + part[1] * row + part[2] * col + bent


def apply_tps(points: DataFrame, model: DataFrame, row: str = "from_row", col: str = "from_col"):
    """Add (mapped_row, mapped_col) to points by their image's model."""
    joined = points.join(model.where("status = 'ok'"), "image_id")
    return joined.withColumns(
        {
            "mapped_row": tps_value(F.col(row), F.col(col), "w_row"),
            "mapped_col": tps_value(F.col(row), F.col(col), "w_col"),
        }
    ).drop("status", "ctrl_row", "ctrl_col", "w_row", "w_col")


def tps_residual(mapped: DataFrame) -> DataFrame:
    """Distance between mapped and wanted positions, per image."""
    d = F.hypot(F.col("mapped_row") - F.col("to_row"), F.col("mapped_col") - F.col("to_col"))
    return mapped.groupBy("image_id").agg(
        F.avg(d).alias("mean_residual"), F.max(d).alias("max_residual")
    )


def deformation(mapped: DataFrame) -> DataFrame:
    """Distance each position moves, per image."""
    d = F.hypot(F.col("mapped_row") - F.col("from_row"), F.col("mapped_col") - F.col("from_col"))
    return mapped.groupBy("image_id").agg(
        F.avg(d).alias("mean_displacement"), F.max(d).alias("max_displacement")
    )


def _warp(images, model, planes: Sequence[str], size, fill: float, method: str) -> DataFrame:
    joined = images.join(model.where("status = 'ok'"), "image_id")

    def change(stack, row):
        h, w = size if size is not None else stack[0].shape

        def at(rows, cols):
            src = []
            for name in ("w_row", "w_col"):
                weights = np.asarray(row[name], dtype=float)
                value = weights[-3] + weights[-2] * rows + weights[-1] * cols
                for k, (cr, cc) in enumerate(zip(row["ctrl_row"], row["ctrl_col"], strict=True)):
                    r = np.hypot(rows - cr, cols - cc)
                    value = value + weights[k] * np.where(
                        r < 1e-10, 0.0, r**2 * np.log(np.maximum(r, 1e-10))
                    )
                src.append(np.round(value, 9))
            return src

        return raster.remap(stack, h, w, at, method, fill)

    return map_images(joined, planes, ["image_id"], change)


def warp_images(images, model, planes, size=None, fill: float = 0.0) -> DataFrame:
    """Bilinear; ``model`` maps target positions to source positions."""
    return _warp(images, model, planes, size, fill, "bilinear")


def warp_masks(images, model, planes, size=None) -> DataFrame:
    """Nearest (half to even); off outside the source."""
    return _warp(images, model, planes, size, 0.0, "nearest")


def dewarp(
    images: DataFrame,
    pixels: DataFrame,
    planes: Sequence[str],
    mode: str = "corners_4",
    method: str = "spatial_order",
    size: tuple[int, int] | None = None,
    margin: float = 10.0,
    regularisation: float = 0.0,
    **detection,
) -> tuple[DataFrame, DataFrame]:
    """(warped images, status per image with residuals)."""
    markers = detect_markers(pixels, **detection)
    targets = canonical_positions(markers, mode, size, margin)
    pairs = correspond(markers, targets, method)
    points = pairs.select(
        "image_id",
        F.col("target_row").alias("from_row"),
        F.col("target_col").alias("from_col"),
        F.col("centroid_row").alias("to_row"),
        F.col("centroid_col").alias("to_col"),
    )
    model = fit_tps(points, regularisation)
    residuals = tps_residual(apply_tps(points, model))
    warped = warp_images(images, model, planes, size)
    status = (
        images.select("image_id")
        .join(model.select("image_id", "status"), "image_id", "left")
        .join(residuals, "image_id", "left")
        .fillna({"status": "no markers"})
    )
    return warped, status
