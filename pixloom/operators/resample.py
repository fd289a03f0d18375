"""Whole-image resampling: one planar image row in, one out, no shuffle.

Spark spreads the rows; a task takes Arrow batches of bounded bytes and reads the planes where they lie,
in their own type. New planes are made strip by strip (``raster.remap``). Everything that can be said
about positions before (windows, models, markers) arrives as columns of the row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixloom.functions import raster

BATCH_BYTES = 64 << 20  # to a task at a time; a larger image comes alone
OUT_BYTES = 8 << 20


def image_schema(df: DataFrame, planes: Sequence[str], keep: Sequence[str]) -> T.StructType:
    fields = [df.schema[c] for c in keep]
    fields += [T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType())]
    return T.StructType(fields + [T.StructField(p, df.schema[p].dataType) for p in planes])


def map_images(
    df: DataFrame,
    planes: Sequence[str],
    keep: Sequence[str],
    change: Callable[[list[np.ndarray], dict], np.ndarray | None],
) -> DataFrame:
    """Apply ``change(planes, row)`` to each image; ``None`` drops the row.

    The planes are read-only views (height, width) of the batch, ``row`` has the other columns.
    """
    planes, keep = list(planes), list(keep)
    schema = image_schema(df, planes, keep)
    names, numbers = schema.fieldNames(), [c for c in df.columns if c not in planes]
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def packed(batch: pa.RecordBatch, made: list) -> pa.RecordBatch:
        kept = batch.select(keep).take(pa.array([i for i, _ in made], pa.int64()))
        columns = list(kept.columns)
        columns += [pa.array([m.shape[axis] for _, m in made], pa.int32()) for axis in (1, 2)]
        ends = np.cumsum([0, *(m.shape[1] * m.shape[2] for _, m in made)])
        for k, p in enumerate(planes):
            flat = made[0][1][k].ravel() if len(made) == 1 else np.concatenate([m[k].ravel() for _, m in made])
            values = pa.array(flat, batch.schema.field(p).type.value_type)
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, size = [], 0
            flat = [batch.column(p).values.to_numpy(zero_copy_only=False) for p in planes]
            ends = [batch.column(p).offsets.to_numpy() for p in planes]
            for i, row in enumerate(batch.select(numbers).to_pylist()):
                shape = int(row["height"]), int(row["width"])
                views = [v[e[i] : e[i + 1]].reshape(shape) for v, e in zip(flat, ends, strict=True)]
                result = change(views, row)
                if result is not None:
                    made.append((i, result))
                    size += result.nbytes
                if size >= OUT_BYTES:
                    yield packed(batch, made)
                    made, size = [], 0
            if made:
                yield packed(batch, made)

    return df.mapInArrow(run, schema)


def resize(
    images: DataFrame,
    planes: Sequence[str],
    ratio: float | None = 0.25,
    size: tuple[int, int] | None = None,
    method: str = "bilinear",
) -> DataFrame:
    """By ratio (pixel centres aligned; 1 changes nothing) or to an explicit size.

    With an explicit size, bilinear keeps the corner pixels and nearest rounds
    the scaled position.
    """
    if size is None and ratio == 1:
        return images

    def change(stack, row):
        h, w = stack[0].shape
        if size is None:
            th, tw = max(1, int(np.ceil(h * ratio))), max(1, int(np.ceil(w * ratio)))
            at = lambda r, c: ((r - 0.5) * h / th + 0.5, (c - 0.5) * w / tw + 0.5)
        else:
            th, tw = size
            if method == "nearest":
                at = lambda r, c: (r * h / th, c * w / tw)
            else:
                at = lambda r, c: ((r - 1) * (h - 1) / max(th - 1, 1) + 1, (c - 1) * (w - 1) / max(tw - 1, 1) + 1)

        def within(rows, cols):
            rows, cols = at(rows, cols)
            return rows.clip(1, h), cols.clip(1, w)

        return raster.remap(stack, th, tw, within, method, 0.0)

    keep = [c for c in images.columns if c not in (*planes, "height", "width")]
    return map_images(images, planes, keep, change)


def _turn(stack: Sequence[np.ndarray], degrees: float) -> np.ndarray:
    """Clockwise about the centre on an enlarged canvas, grey outside."""
    if abs(degrees) < 0.1:
        return np.asarray(stack)
    h, w = stack[0].shape
    a = np.radians(degrees)
    cos, sin = np.cos(a), np.sin(a)
    corners = np.array([(y, x) for y in (1, h) for x in (1, w)], dtype=float)
    dy, dx = corners[:, 0] - (h + 1) / 2, corners[:, 1] - (w + 1) / 2
    turned_y, turned_x = dy * cos + dx * sin, dx * cos - dy * sin
    # Rounded first, so that quarter turns do not gain a pixel from noise.
    span_y = np.round(turned_y.max() - turned_y.min(), 9)
    span_x = np.round(turned_x.max() - turned_x.min(), 9)
    nh, nw = int(np.ceil(span_y)) + 1, int(np.ceil(span_x)) + 1

    def at(rows, cols):
        dy, dx = rows - (nh + 1) / 2, cols - (nw + 1) / 2
        return np.round(dy * cos - dx * sin + (h + 1) / 2, 9), np.round(dy * sin + dx * cos + (w + 1) / 2, 9)

    return raster.remap(stack, nh, nw, at, "bilinear", 0.5)


def rotate_any(images: DataFrame, planes: Sequence[str], degrees: float) -> DataFrame:
    """Any angle, positive is clockwise; below a tenth of a degree nothing changes."""
    keep = [c for c in images.columns if c not in (*planes, "height", "width")]
    return map_images(images, planes, keep, lambda stack, row: _turn(stack, degrees))


def marker_closeup(
    images: DataFrame,
    markers: DataFrame,
    planes: Sequence[str],
    mask_plane: str,
    degrees: float = 0.0,
) -> DataFrame:
    """Each image's first marker cut out along its box axes, long side horizontal; of a square, the side across.

    ``markers``: (image_id, centroid_row, centroid_col, corners). Positions off
    the image or off the marker mask are grey; an image without a marker gives a
    grey 100x100 placeholder.
    """
    planes = list(planes)
    joined = images.join(
        markers.select("image_id", "centroid_row", "centroid_col", "corners"), "image_id", "left"
    )

    def change(stack, row):
        colours = stack[:-1]
        if row["corners"] is None or len(row["corners"]) != 8:
            return np.full((len(planes) + 1, 100, 100), 0.5)
        c = np.asarray(row["corners"], dtype=float).reshape(4, 2)
        first, second = c[1] - c[0], c[2] - c[1]
        # Compared to nine digits: the sides of a square would otherwise be told apart by noise.
        if round(np.hypot(*first), 9) > round(np.hypot(*second), 9):
            long_side, short_side = first, -second
        else:
            long_side, short_side = second, -first
        w, h = np.hypot(*long_side), np.hypot(*short_side)
        out_h, out_w = max(1, int(round(round(h, 9)))), max(1, int(round(round(w, 9))))
        u = long_side / w if w > 1e-9 else np.array([0.0, 1.0])
        v = short_side / h if h > 1e-9 else np.array([1.0, 0.0])

        def at(rows, cols):
            lr, lc = rows - out_h / 2.0, cols - out_w / 2.0
            src_r, src_c = (row[f"centroid_{n}"] + lc * u[k] + lr * v[k] for k, n in enumerate(("row", "col")))
            return np.round(src_r, 9), np.round(src_c, 9)

        on = raster.remap(stack[-1:], out_h, out_w, at, "nearest", 0.0)
        cut = np.where(on > 0.5, raster.remap(colours, out_h, out_w, at, "bilinear", 0.5), 0.5)
        cut = _turn(np.concatenate([cut, on]), degrees)
        return np.rot90(cut, k=-1, axes=(1, 2))

    return map_images(joined, [*planes, mask_plane], ["image_id"], change).drop(mask_plane)


@dataclass(frozen=True)
class Linear:
    """A step that maps offsets (x, y) from the centre by a 2x2 matrix made from the row's parameters."""

    matrix: Callable[[dict], np.ndarray]


@dataclass(frozen=True)
class Effect:
    """A step that makes new planes: ``apply(planes, row, colours)``, the first ``colours`` being colours."""

    apply: Callable[[np.ndarray, dict, int], np.ndarray]


def _elastic(stack: np.ndarray, row: dict, colours: int) -> np.ndarray:
    """The same smooth field for all planes."""
    h, w = stack[0].shape
    field = raster.displacement(
        h, w, int(row["elastic_grid_h"]), int(row["elastic_grid_w"]), row["elastic_scale"],
        row["elastic_sigma"], int(row["elastic_iterations"]), int(row["random_seed"]) & 0x7FFFFFFF,
    )

    def at(rows, cols):
        strip = slice(int(rows[0, 0]) - 1, int(rows[-1, 0]))
        return (rows + field[0, strip]).clip(1, h), (cols + field[1, strip]).clip(1, w)

    return raster.remap(stack, h, w, at, "bilinear", 0.0)


def _jitter(stack: np.ndarray, row: dict, colours: int) -> np.ndarray:
    stack[:colours] = np.clip(stack[:colours] * row["brightness_factor"] + row["saturation_offset"], 0, 1)
    return stack


def _blur(stack: np.ndarray, row: dict, colours: int) -> np.ndarray:
    for k in range(colours):
        stack[k] = raster.smooth(stack[k : k + 1], int(row["blur_kernel_size"]), row["blur_sigma"])[0]
    return stack


# Steps by name; a user's own Linear or Effect objects stand beside them in a list.
STEPS: dict[str, Linear | Effect] = {
    "scale": Linear(lambda row: np.eye(2) * row["scale_factor"]),
    "shear_x": Linear(lambda row: raster.shear(x=row["shear_x_angle"])),
    "shear_y": Linear(lambda row: raster.shear(y=row["shear_y_angle"])),
    "rotate": Linear(lambda row: raster.turn(row["rotation_angle"])),
    "flip": Linear(lambda row: raster.mirror(row["flip_type"])),
    "elastic": Effect(_elastic),
    "jitter": Effect(_jitter),
    "blur": Effect(_blur),
}
GEOMETRY = ("scale", "shear_x", "shear_y", "rotate", "flip")
CROP_FIRST = ("flip", "shear_x", "shear_y", "rotate", "scale")
POST = ("elastic", "jitter", "blur")


def resolved(steps: Sequence[str | Linear | Effect]) -> list[Linear | Effect]:
    unknown = [s for s in steps if not isinstance(s, (Linear, Effect)) and s not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps: {unknown}")
    return [STEPS[s] if isinstance(s, str) else s for s in steps]


def run_steps(stack: Sequence[np.ndarray], row: dict, steps: Sequence[Linear | Effect], binary: int) -> np.ndarray:
    """Apply steps in order; matrices that follow each other are one resampling. The last ``binary`` planes are rounded."""
    h, w = stack[0].shape
    pending, fresh = np.eye(2), False
    out: Sequence[np.ndarray] = stack

    def resampled():
        inverse = np.linalg.inv(pending)

        def at(rows, cols):
            dx, dy = cols - (w + 1) / 2, rows - (h + 1) / 2
            src_c = inverse[0, 0] * dx + inverse[0, 1] * dy + (w + 1) / 2
            src_r = inverse[1, 0] * dx + inverse[1, 1] * dy + (h + 1) / 2
            return np.round(src_r, 9), np.round(src_c, 9)

        return raster.remap(out, h, w, at, "bilinear", 0.0)

    def rounded_masks(planes):
        if binary:
            planes[-binary:] = np.rint(planes[-binary:])
        return planes

    for step in steps:
        if isinstance(step, Linear):
            pending, fresh = step.matrix(row) @ pending, True
            continue
        if fresh:
            out = rounded_masks(resampled())
            pending, fresh = np.eye(2), False
        elif out is stack:
            out = np.array(stack)
        out = rounded_masks(step.apply(out, row, len(out) - binary))
    return rounded_masks(resampled()) if fresh else np.asarray(out)


def apply_steps(
    images: DataFrame, planes: Sequence[str], steps: Sequence[str | Linear | Effect], binary: int, keep: Sequence[str]
) -> DataFrame:
    """Any list of steps with the parameters of each row, for image and masks alike, in one pass."""
    chosen = resolved(steps)
    return map_images(images, planes, keep, lambda stack, row: run_steps(stack, row, chosen, binary))


def geometric(images: DataFrame, planes: Sequence[str], binary: int, keep: Sequence[str]):
    """Apply the drawn geometry of each row to image and masks alike."""
    return apply_steps(images, planes, GEOMETRY, binary, keep)


def post_effects(images: DataFrame, planes: Sequence[str], colours: int, keep: Sequence[str]):
    """Elastic distortion of all planes; jitter and blur of the colour planes only."""
    return apply_steps(images, planes, POST, len(planes) - colours, keep)


def crop(images: DataFrame, planes: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Cut the window (crop_y, crop_x, crop_h, crop_w) of each row, with array slices only."""
    rows = F.sequence(F.col("crop_y"), F.col("crop_y") + F.col("crop_h") - 1)

    def cut(p: str):
        return F.flatten(
            F.transform(
                rows,
                lambda r: F.slice(F.col(p), (r - 1) * F.col("width") + F.col("crop_x"),
                                  F.col("crop_w")),
            )
        ).alias(p)

    # The planes are cut before the sizes are renamed: both are called "width".
    cut_planes = images.select(
        *keep,
        *[F.col(c) for c in ("crop_h", "crop_w") if c not in keep],
        *[cut(p) for p in planes],
    )
    return cut_planes.select(
        *keep,
        F.col("crop_h").cast("int").alias("height"),
        F.col("crop_w").cast("int").alias("width"),
        *planes,
    )
