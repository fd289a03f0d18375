"""Segmentation losses, confusion counts and tiles.

Predictions are pixels with ``logits`` and ``truth`` arrays in class order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: spacing of 32-bit floats at one.
EPSILON = 2.0**-23


def _scored(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """Softmax probabilities ``__p0..``, truths ``__y0..`` and raw outputs ``__z0..``.

    One projection per step: each value is used several times by the next step, so
    the exponentials are computed once per pixel and class.
    """
    given = [f"__{k}{i}" for k in "yz" for i in range(n)]
    raw = df.select(
        *keys,
        *[F.col("truth")[i].alias(f"__y{i}") for i in range(n)],
        *[F.col("logits")[i].alias(f"__z{i}") for i in range(n)],
    )
    top = F.greatest(*[F.col(f"__z{i}") for i in range(n)])
    exps = raw.select(
        *keys, *given, *[F.exp(F.col(f"__z{i}") - top).alias(f"__e{i}") for i in range(n)]
    )
    total = sum(F.col(f"__e{i}") for i in range(n))
    return exps.select(
        *keys, *given, *[(F.col(f"__e{i}") / total).alias(f"__p{i}") for i in range(n)]
    )


@dataclass(frozen=True)
class Metric:
    """A measure of one pixel and how the pixels of a group are summed up.

    ``pixel`` gets the probabilities, the truths and the raw outputs of all classes as columns.
    """

    pixel: Callable[[list[Column], list[Column], list[Column]], Column]
    over: Callable[[Column], Column] = F.avg


METRICS: dict[str, Callable[..., Metric]] = {}


def metric(name: str):
    """Register a maker of metrics under a name; one of the same name is replaced."""

    def register(make: Callable[..., Metric]) -> Callable[..., Metric]:
        METRICS[name] = make
        return make

    return register


def _entropy(weights: Sequence[float] | None, gamma: float | None) -> Metric:
    def pixel(p, y, z):
        if weights is not None and len(weights) != len(p):
            raise ValueError(f"{len(weights)} weights for {len(p)} classes")
        total = F.lit(0.0)
        for i in range(len(p)):
            term = -y[i] * F.ln(p[i] + EPSILON) * (1.0 if weights is None else weights[i])
            total = total + (term if gamma is None else term * F.pow(1.0 - p[i], F.lit(gamma)))
        return total

    return Metric(pixel)


@metric("cross_entropy")
def plain_entropy() -> Metric:
    return _entropy(None, None)


@metric("weighted_cross_entropy")
def weighted_entropy(weights: Sequence[float]) -> Metric:
    return _entropy(weights, None)


@metric("focal_cross_entropy")
def focal_entropy(weights: Sequence[float], gamma: float = 2.0) -> Metric:
    return _entropy(weights, gamma)


@metric("quadratic_error")
def squares() -> Metric:
    """Squares of raw outputs against truth, no softmax, summed over the pixels."""
    return Metric(lambda p, y, z: sum(F.pow(a - b, 2) for a, b in zip(z, y, strict=True)), F.sum)


def evaluate(
    df: DataFrame, n: int, metrics: Mapping[str, Metric] | Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Any number of metrics in one pass and one aggregation.

    ``metrics`` maps output names to metrics, or names registered makers that need no arguments.
    """
    if not isinstance(metrics, Mapping):
        unknown = [m for m in metrics if m not in METRICS]
        if unknown:
            raise ValueError(f"unknown metrics: {unknown}")
        metrics = {m: METRICS[m]() for m in metrics}
    keys = list(keys)
    columns = [[F.col(f"__{k}{i}") for i in range(n)] for k in "pyz"]
    return _scored(df, n, keys).groupBy(*keys).agg(*[m.over(m.pixel(*columns)).alias(name) for name, m in metrics.items()])


def cross_entropy(df: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    return evaluate(df, n, {"cross_entropy": plain_entropy()}, keys)


def weighted_cross_entropy(df: DataFrame, weights: Sequence[float], keys: Sequence[str] = ()):
    return evaluate(df, len(weights), {"weighted_cross_entropy": weighted_entropy(weights)}, keys)


def focal_cross_entropy(
    df: DataFrame, weights: Sequence[float], gamma: float = 2.0, keys: Sequence[str] = ()
) -> DataFrame:
    return evaluate(df, len(weights), {"focal_cross_entropy": focal_entropy(weights, gamma)}, keys)


def quadratic_error(df: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Summed squares of raw outputs against truth, no softmax."""
    return evaluate(df, n, {"quadratic_error": squares()}, keys)


def _per_class(df, classes, threshold: float, keys, measures) -> DataFrame:
    """One aggregation over all classes, then one row per class.

    ``measures(hit, real)`` maps output names to aggregates.
    """
    keys = list(keys)
    n = len(classes)
    flags = _scored(df, n, keys).select(
        *keys,
        *[(F.col(f"__p{i}") > threshold).alias(f"__h{i}") for i in range(n)],
        *[(F.col(f"__y{i}") > threshold).alias(f"__r{i}") for i in range(n)],
    )
    columns = []
    for i, c in enumerate(classes):
        named = measures(F.col(f"__h{i}"), F.col(f"__r{i}"))
        fields = [F.lit(c).alias("class"), *[v.alias(k) for k, v in named.items()]]
        columns.append(F.struct(*fields).alias(f"__c{i}"))
    wide = flags.groupBy(*keys).agg(*columns)
    rows = F.array(*[F.col(f"__c{i}") for i in range(n)])
    return wide.select(*keys, F.explode(rows).alias("e")).select(*keys, "e.*")


def confusion(
    df: DataFrame, classes: Sequence[str], threshold: float = 0.5, keys: Sequence[str] = ()
) -> DataFrame:
    def measures(hit, real):
        return {
            "tp": F.count_if(hit & real),
            "tn": F.count_if(~hit & ~real),
            "fp": F.count_if(hit & ~real),
            "fn": F.count_if(~hit & real),
        }

    return _per_class(df, classes, threshold, keys, measures)


def iou_loss(
    df: DataFrame,
    classes: Sequence[str],
    threshold: float = 0.5,
    keys: Sequence[str] = (),
    mode: str = "class",
) -> DataFrame:
    """1 - tp / (tp + fp + fn) per class; an empty union gives 1.

    ``mode="reference"`` averages the ratio pixel by pixel: one pixel outside the
    union makes the mean undefined, hence 1.
    """
    keys = list(keys)
    if mode == "class":
        counts = confusion(df, classes, threshold, keys)
        union = F.col("tp") + F.col("fp") + F.col("fn")
        loss = F.when(union > 0, 1.0 - F.col("tp") / union).otherwise(1.0)
        return counts.select(*keys, "class", loss.alias("iou_loss"))
    if mode != "reference":
        raise ValueError("mode is 'class' or 'reference'")

    def measures(hit, real):
        missed = F.avg(F.when(hit & real, 0.0).otherwise(1.0))
        return {"iou_loss": F.when(F.bool_and(hit | real), missed).otherwise(1.0)}

    return _per_class(df, classes, threshold, keys, measures)


def iou_losses(
    df: DataFrame, classes: Sequence[str], threshold: float = 0.5, keys: Sequence[str] = ()
) -> DataFrame:
    """Both forms of the loss in one pass: ``iou_loss`` by class, ``elementwise`` pixel by pixel."""

    def measures(hit, real):
        tp, union = F.count_if(hit & real), F.count_if(hit | real)
        missed = F.avg(F.when(hit & real, 0.0).otherwise(1.0))
        return {
            "iou_loss": F.when(union > 0, 1.0 - tp / union).otherwise(1.0),
            "elementwise": F.when(F.bool_and(hit | real), missed).otherwise(1.0),
        }

    return _per_class(df, classes, threshold, keys, measures)


def validation_score(
    df: DataFrame, classes: Sequence[str], threshold: float = 0.5, image: str = "image_id"
) -> DataFrame:
    """Class losses summed per image, averaged over images."""
    per_class = iou_loss(df, classes, threshold, [image])
    per_image = per_class.groupBy(image).agg(F.sum("iou_loss").alias("loss"))
    return per_image.agg(F.avg("loss").alias("score"))


def tile(
    pixels: DataFrame, tile_h: int, tile_w: int, complete_only: bool = False
) -> DataFrame:
    """Add non-overlapping tile numbers and positions inside the tile.

    ``complete_only`` keeps full tiles; this needs only the image size columns.
    """
    out = pixels.withColumns(
        {
            "tile_row": F.floor((F.col("row") - 1) / tile_h).cast("int"),
            "tile_col": F.floor((F.col("col") - 1) / tile_w).cast("int"),
            "in_row": ((F.col("row") - 1) % tile_h + 1).cast("int"),
            "in_col": ((F.col("col") - 1) % tile_w + 1).cast("int"),
        }
    )
    if complete_only:
        out = out.where(
            ((F.col("tile_row") + 1) * tile_h <= F.col("height"))
            & ((F.col("tile_col") + 1) * tile_w <= F.col("width"))
        )
    return out


def patch_scores(df: DataFrame, size: int, weights: Sequence[float]) -> DataFrame:
    """Weighted loss of each complete patch, and their sum per image."""
    tiled = tile(df, size, size, complete_only=True)
    patches = weighted_cross_entropy(tiled, weights, ["image_id", "tile_row", "tile_col"])
    return patches.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_patches"),
        F.sum("weighted_cross_entropy").alias("score"),
    )
