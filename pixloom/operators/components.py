"""Connected components and their measures, for all images of a table at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixloom.functions.geometry import major_axis_angle
from pixloom.operators.morphology import adaptive_threshold, close_open
from pixloom.operators.pixels import in_region, white_band, with_brightness
from pixloom.operators.tiles import TILE, map_tiles
from pixloom.session import cut_lineage, remove, written

# Column-major position of a pixel as one number; rows stay below 2**20.
_STRIDE = 1 << 20


def _local_nodes(starts: np.ndarray, row: np.ndarray, col: np.ndarray, reach: int) -> np.ndarray:
    """For each mask pixel of complete tiles the index of the first pixel, down the columns, of its part.

    Pixels become vertical runs; runs of neighbouring columns that touch are joined by taking the
    smaller root and jumping to it until nothing changes.
    """
    tile = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(row))))
    high, wide = int(row.max()) + 4, int(col.max()) + 2
    line = (tile * wide + col) * high
    order = np.argsort(line + row, kind="stable")
    at = (line + row)[order]
    begin = np.ones(len(at), bool)
    begin[1:] = np.diff(at) > 1
    run = np.cumsum(begin) - 1
    first = np.flatnonzero(begin)
    lo, hi = at[first], at[np.append(first[1:], len(at)) - 1]
    # the lines leave free rows behind, so a look to the next line never meets another one
    below = np.searchsorted(hi, lo + high - reach)
    above = np.searchsorted(lo, hi + high + reach, "right")
    count = np.maximum(above - below, 0)
    a = np.repeat(np.arange(len(lo)), count)
    b = np.arange(int(count.sum())) + np.repeat(below - (np.cumsum(count) - count), count)
    same = lo[b] // high // wide == lo[a] // high // wide
    a, b = a[same], b[same]
    root = np.arange(len(lo))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    out = np.zeros(len(row), np.int64)
    out[order] = order[first[root[run]]]
    return out


def _contract(edges: DataFrame, keys: list[str], turn: int) -> tuple[DataFrame, DataFrame]:
    """One round: each node points to the neighbour of smallest priority, if smaller
    than its own, pointers jump once, and edges are rewritten between the targets.

    Priorities are hashes drawn anew each round. Node numbers would serve too, but a
    long winding region is a chain of rising numbers and would shrink by only a few
    nodes per round; with hashes every round removes a fixed share of the nodes.
    """

    def ranked(node: str) -> Column:
        return F.struct(F.xxhash64(F.col(node), F.lit(turn)).alias("h"), F.col(node).alias("n"))

    parent = edges.groupBy(*keys, F.col("a").alias("n")).agg(F.min(ranked("b")).alias("low"))
    parent = parent.select(*keys, "n", F.least(ranked("n"), F.col("low"))["n"].alias("p"))
    up = parent.select(*keys, F.col("n").alias("p"), F.col("p").alias("pp"))
    parent = parent.join(up, [*keys, "p"]).select(*keys, "n", F.col("pp").alias("p"))
    for side in ("a", "b"):
        moved = parent.select(*keys, F.col("n").alias(side), F.col("p").alias("__to"))
        edges = edges.join(moved, [*keys, side]).drop(side).withColumnRenamed("__to", side)
    edges = edges.where(F.col("a") != F.col("b")).distinct()
    return parent, edges


def _seams(parts: DataFrame, keys: list[str], reach: int, tile: int) -> DataFrame:
    """Pairs (a, b) of parts that touch across a border of tiles, in both directions."""
    edge = lambda axis: (F.col(axis) % tile).isin(0, 1)
    border = parts.where(edge("row") | edge("col")).select(*keys, "row", "col", "__node")
    steps = [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if reach else [])
    number = lambda axis: F.floor((F.col(axis) - 1) / tile)
    to = F.explode(F.array(*[F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in steps]))
    moved = border.select(*keys, F.col("__node").alias("a"), number("row").alias("__r"), number("col").alias("__c"), to.alias("to"))
    moved = moved.select(*keys, "a", "__r", "__c", "to.row", "to.col").where(
        (number("row") != F.col("__r")) | (number("col") != F.col("__c"))
    )
    met = moved.join(border.withColumnRenamed("__node", "b"), [*keys, "row", "col"]).select(*keys, "a", "b").distinct()
    return met.unionByName(met.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))


def _stitched(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, __node, __comp) of all parts in ``edges``; rounds are written, old ones removed."""
    spark = edges.sparkSession
    edges, old = written(edges, "seams")
    nodes, old_nodes = written(edges.select(*keys, F.col("a").alias("__node"), F.col("a").alias("__comp")).distinct(), "stitches")
    turn = 0
    while not edges.isEmpty():
        parent, left = _contract(edges, keys, turn)
        step = parent.select(*keys, F.col("n").alias("__comp"), F.col("p").alias("__p"))
        moved = nodes.join(step, [*keys, "__comp"], "left").select(*keys, "__node", F.coalesce("__p", "__comp").alias("__comp"))
        nodes, new_nodes = written(moved, "stitches")
        edges, new = written(left, "seams")
        remove(spark, old, old_nodes)
        old, old_nodes, turn = new, new_nodes, turn + 1
    return nodes


def label_components(
    mask_pixels: DataFrame, connectivity: int = 4, keys: Sequence[str] = ("image_id",), tile: int = TILE
) -> DataFrame:
    """Add ``label`` (1..n per image) to mask pixels.

    Labels are ranks of the components' first pixel in column-major order. Pixels are dealt out once, by
    tile; a task joins the runs within its tiles. Only parts that touch a border of tiles go on as
    edges, and rounds of hooking every part to a neighbour contract those until none is left, in about
    log(parts) rounds. The parts' labels are then joined back to the pixels.
    """
    keys = list(keys)
    reach = {4: 0, 8: 1}[connectivity]

    def nodes_of(starts, row, col, table):
        first = _local_nodes(starts, row, col, reach)
        code = table.column("col").to_numpy().astype(np.int64) * _STRIDE + table.column("row").to_numpy()
        return [code[first]]

    columns = [c for c in mask_pixels.columns if c != "label"]
    dealt = map_tiles(mask_pixels.select(*columns), keys, nodes_of, [T.StructField("__node", T.LongType())], tile=tile)
    parts, _ = written(dealt, "parts")
    nodes = parts.select(*keys, "__node").distinct()
    stitched = _stitched(_seams(parts, keys, reach, tile), keys)
    nodes = nodes.join(stitched, [*keys, "__node"], "left").withColumn("__comp", F.coalesce("__comp", "__node"))
    heads = nodes.groupBy(*keys, "__comp").agg(F.min("__node").alias("__first"))
    label = F.row_number().over(W.partitionBy(*keys).orderBy("__first"))
    ranked = heads.withColumn("label", label).drop("__first")
    labelled = nodes.join(ranked, [*keys, "__comp"]).drop("__comp")
    return parts.join(labelled, [*keys, "__node"]).drop("__node")


def component_stats(
    labelled: DataFrame, min_area: int = 0, keys: Sequence[str] = ("image_id",)
) -> DataFrame:
    """Size, centroid and upright bounds; components below ``min_area`` are dropped."""
    return (
        labelled.groupBy(*keys, "label")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.avg("row").alias("centroid_row"),
            F.avg("col").alias("centroid_col"),
            F.min("row").alias("r_min"),
            F.max("row").alias("r_max"),
            F.min("col").alias("c_min"),
            F.max("col").alias("c_max"),
        )
        .where(F.col("size") >= min_area)
    )


def oriented_boxes(
    labelled: DataFrame,
    min_area: int = 0,
    keys: Sequence[str] = ("image_id",),
    aggregates: dict[str, Column] | None = None,
) -> DataFrame:
    """Box along the principal axes of each component (population covariance).

    Extents are differences of pixel centres. ``width`` runs along the major axis.
    A zero extent is flagged ``degenerate``; aspect ratio is then 1 and density 0.
    """
    keys = list(keys)
    n = F.count(F.lit(1)).cast("double")
    row, col = F.col("row").cast("double"), F.col("col").cast("double")
    sr, sc = F.sum(row), F.sum(col)
    moments = (
        labelled.groupBy(*keys, "label")
        .agg(
            F.count(F.lit(1)).alias("size"),
            (sr / n).alias("centroid_row"),
            (sc / n).alias("centroid_col"),
            # n * sum(xy) - sum(x) * sum(y): exact for whole-number coordinates.
            (n * F.sum(row * row) - sr * sr).alias("__rr"),
            (n * F.sum(row * col) - sr * sc).alias("__rc"),
            (n * F.sum(col * col) - sc * sc).alias("__cc"),
            *[expr.alias(name) for name, expr in (aggregates or {}).items()],
        )
        .where(F.col("size") >= min_area)
        .withColumn("angle", major_axis_angle(F.col("__rr"), F.col("__rc"), F.col("__cc")))
        .drop("__rr", "__rc", "__cc")
    )
    axes = moments.select(*keys, "label", "centroid_row", "centroid_col", "angle")
    dr, dc = F.col("row") - F.col("centroid_row"), F.col("col") - F.col("centroid_col")
    along = dr * F.sin("angle") + dc * F.cos("angle")
    across = dr * F.cos("angle") - dc * F.sin("angle")
    extents = (
        labelled.select(*keys, "label", "row", "col")
        .join(axes, [*keys, "label"])
        .groupBy(*keys, "label")
        .agg(
            F.min(along).alias("a0"),
            F.max(along).alias("a1"),
            F.min(across).alias("b0"),
            F.max(across).alias("b1"),
        )
    )
    boxes = moments.join(extents, [*keys, "label"])
    clean = lambda v: F.when(F.abs(v) < 1e-9, F.lit(0.0)).otherwise(v)
    boxes = boxes.withColumns(
        {
            "width": clean(F.col("a1") - F.col("a0")),
            "height": clean(F.col("b1") - F.col("b0")),
        }
    )
    shorter = F.least("width", "height")
    return boxes.withColumns(
        {
            "degenerate": shorter <= 0,
            "aspect_ratio": F.when(shorter > 0, F.greatest("width", "height") / shorter).otherwise(
                1.0
            ),
            "density": F.when(
                shorter > 0, F.col("size") / (F.col("width") * F.col("height"))
            ).otherwise(0.0),
            "corners": _corners(),
        }
    ).drop("a0", "a1", "b0", "b1")


def _corners() -> Column:
    """Eight numbers: (row, col) of the four box corners."""
    flat = []
    for p, q in (("a0", "b0"), ("a1", "b0"), ("a1", "b1"), ("a0", "b1")):
        a, b = F.col(p), F.col(q)
        flat.append(F.col("centroid_row") + a * F.sin("angle") + b * F.cos("angle"))
        flat.append(F.col("centroid_col") + a * F.cos("angle") - b * F.sin("angle"))
    return F.array(*flat)


def component_score(
    preferred_aspect_ratio: float = 5.0, weights: Sequence[float] = (0.5, 0.3, 0.2)
) -> Column:
    """Brightness, capped density and closeness to the preferred aspect ratio."""
    closeness = F.exp(
        -F.abs(F.col("aspect_ratio") - preferred_aspect_ratio) / preferred_aspect_ratio
    )
    return (
        weights[0] * F.col("mean_brightness")
        + weights[1] * F.least(F.col("density"), F.lit(1.0))
        + weights[2] * closeness
    )


def best_component(
    boxes: DataFrame, preferred_aspect_ratio: float = 5.0, keys: Sequence[str] = ("image_id",)
) -> DataFrame:
    """Best-scoring component per image; the first label wins ties, the score must be positive."""
    scored = boxes.withColumn("score", component_score(preferred_aspect_ratio)).where("score > 0")
    best = F.struct(F.col("score"), -F.col("label"))
    columns = F.struct(*[c for c in scored.columns if c not in keys])
    return scored.groupBy(*keys).agg(F.max_by(columns, best).alias("b")).select(*keys, "b.*")


def renumber_labels(labelled: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Labels 1..n in scan order of each component's first pixel."""
    keys = list(keys)
    first = labelled.groupBy(*keys, "label").agg(
        F.min(F.col("col").cast("long") * _STRIDE + F.col("row")).alias("__first")
    )
    order = W.partitionBy(*keys).orderBy("__first")
    table = first.withColumn("__new", F.row_number().over(order)).drop("__first")
    joined = labelled.join(table, [*keys, "label"])
    return joined.withColumn("label", F.col("__new").cast("int")).drop("__new")


def top_markers(
    boxes: DataFrame, n: int = 20, keys: Sequence[str] = ("image_id",)
) -> DataFrame:
    """The first ``n`` labels of an image, then ordered by size (largest first)."""
    keys = list(keys)
    by_label = W.partitionBy(*keys).orderBy("label")
    by_size = W.partitionBy(*keys).orderBy(F.col("size").desc(), "label")
    kept = boxes.withColumn("__k", F.row_number().over(by_label)).where(F.col("__k") <= n)
    return kept.withColumn("marker", F.row_number().over(by_size)).drop("__k")


def find_components(
    pixels: DataFrame,
    threshold: float = 0.7,
    radius: int = 3,
    min_area: int = 100,
    region: tuple[Column, Column, Column, Column] | None = None,
) -> DataFrame:
    """White components: threshold, closing and opening, labels, stats, area cut."""
    mask = white_band(threshold)
    if region is not None:
        mask = mask & in_region(*region)
    masked = close_open(
        pixels.select("image_id", "row", "col", mask.alias("m")), "m", radius
    ).where("m")
    return component_stats(label_components(masked), min_area)


def white_region(
    pixels: DataFrame,
    threshold: float = 0.7,
    threshold_upper: float = 1.0,
    min_area: int = 100,
    preferred_aspect_ratio: float = 5.0,
    radius: int = 3,
    region: tuple[Column, Column, Column, Column] | None = None,
    adaptive: bool = False,
    window: int = 25,
    offset: float = 0.1,
) -> DataFrame:
    """The best white component of every image, or why there is none.

    One row per image; ``status`` is ``found``, ``no_component`` or ``too_small``.
    """
    inside = in_region(*region) if region is not None else F.lit(True)
    base = with_brightness(pixels)
    if adaptive:
        base = adaptive_threshold(base, "brightness", window, offset, threshold, "m")
        if threshold_upper < 1.0:
            base = base.withColumn("m", F.col("m") & (F.col("brightness") <= threshold_upper))
    else:
        base = base.withColumn("m", white_band(threshold, threshold_upper))
    base = base.withColumn("inside", inside).withColumn("m", F.col("m") & F.col("inside"))
    base = base.select("image_id", "row", "col", "r", "g", "b", "m", "inside")
    if radius > 0:
        base = close_open(base, "m", radius).withColumn("m", F.col("m") & F.col("inside"))
    labelled = cut_lineage(label_components(base.where("m").drop("m", "inside")))
    bright = F.avg((F.col("r") + F.col("g") + F.col("b")) / 3.0)
    boxes = oriented_boxes(labelled, min_area, aggregates={"mean_brightness": bright})
    best = best_component(boxes, preferred_aspect_ratio)
    counts = labelled.groupBy("image_id").agg(
        F.countDistinct("label").cast("long").alias("num_components")
    )
    scope = pixels.where(inside) if region is not None else pixels
    frame = pixels.groupBy("image_id").agg(F.count(F.lit(1)).alias("total_pixels")).join(
        scope.groupBy("image_id").agg(
            F.min("row").alias("rr0"), F.max("row").alias("rr1"),
            F.min("col").alias("cc0"), F.max("col").alias("cc1"),
        ),
        "image_id",
        "left",
    )
    out = frame.join(counts, "image_id", "left").join(best, "image_id", "left")
    clipped = F.transform(
        F.col("corners"),
        lambda v, i: F.when(
            i % 2 == 0,
            F.least(F.greatest(v, F.col("rr0").cast("double")), F.col("rr1").cast("double")),
        ).otherwise(
            F.least(F.greatest(v, F.col("cc0").cast("double")), F.col("cc1").cast("double"))
        ),
    )
    components = F.coalesce("num_components", F.lit(0))
    return out.select(
        "image_id",
        F.when(components == 0, F.lit("no_component"))
        .when(F.col("label").isNull(), F.lit("too_small"))
        .otherwise(F.lit("found"))
        .alias("status"),
        components.alias("num_components"),
        F.col("label"),
        F.coalesce("size", F.lit(0)).alias("size"),
        (F.coalesce("size", F.lit(0)) / F.col("total_pixels") * 100.0).alias("white_pct"),
        F.coalesce("density", F.lit(0.0)).alias("density"),
        F.coalesce("aspect_ratio", F.lit(0.0)).alias("aspect_ratio"),
        F.coalesce("angle", F.lit(0.0)).alias("angle"),
        F.col("score"),
        clipped.alias("corners"),
    )


def detect_markers(
    pixels: DataFrame,
    threshold: float = 0.7,
    radius: int = 3,
    min_area: int = 100,
    max_markers: int = 20,
    region: tuple[Column, Column, Column, Column] | None = None,
    aspect_range: tuple[float, float] | None = None,
    min_density: float | None = None,
) -> DataFrame:
    """Up to ``max_markers`` components per image with their oriented boxes.

    The aspect and density filters are off unless given.
    """
    mask = white_band(threshold)
    if region is not None:
        mask = mask & in_region(*region)
    marked = pixels.withColumn("m", mask)
    masked = close_open(marked.select("image_id", "row", "col", "m"), "m", radius).where("m")
    boxes = oriented_boxes(label_components(masked), min_area)
    if aspect_range is not None:
        boxes = boxes.where(F.col("aspect_ratio").between(*aspect_range))
    if min_density is not None:
        boxes = boxes.where(F.col("density") >= min_density)
    return top_markers(boxes, max_markers)
