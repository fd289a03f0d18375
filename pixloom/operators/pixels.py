"""Pixel-table projections and filters (one row per pixel)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixloom import schema as S
from pixloom.functions import colour, geometry
from pixloom.functions.scalars import round_half_even

# "Inside mask" rules met in the data; each is a named preset.
MASK_RULES = {
    "class": lambda r, g, b: r > 0.5,
    "any_over_0.1": lambda r, g, b: (r > 0.1) | (g > 0.1) | (b > 0.1),
    "sum_over_1.5": lambda r, g, b: (r + g + b) > 1.5,
    "any_over_0.01": lambda r, g, b: (r > 0.01) | (g > 0.01) | (b > 0.01),
    "any_over_0": lambda r, g, b: (r > 0) | (g > 0) | (b > 0),
}


def in_mask(rule: str, r: Column, g: Column, b: Column) -> Column:
    return MASK_RULES[rule](r, g, b)


def valid_images(images: DataFrame, planes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Split into rows whose planes all hold height*width values, and the rest with a reason."""
    expected = F.col("height") * F.col("width")
    ok = F.lit(True)
    for plane in planes:
        ok = ok & F.coalesce(F.size(plane) == expected, F.lit(False))
    good = images.where(ok)
    bad = images.where(~ok).withColumn("reason", F.lit("channel size differs from height*width"))
    return good, bad


def to_pixels(images: DataFrame, planes: Sequence[str] | None = None) -> DataFrame:
    """Planar image rows to one row per pixel; positions are row-major, 1-based."""
    if planes is None:
        planes = [c for c in images.columns if c not in ("image_id", "height", "width")]
    zipped = images.select(
        "image_id",
        "height",
        "width",
        F.posexplode(F.arrays_zip(*[F.col(p) for p in planes])).alias("pos", "px"),
    )
    return zipped.select(
        "image_id",
        (F.floor(F.col("pos") / F.col("width")) + 1).cast("int").alias("row"),
        (F.col("pos") % F.col("width") + 1).cast("int").alias("col"),
        "height",
        "width",
        *[F.col(f"px.{p}").cast("double").alias(p) for p in planes],
    )


def to_images(pixels: DataFrame, planes: Sequence[str]) -> DataFrame:
    """Back to planar rows. A group is one image, whose size a single file bounds."""
    packed = F.array_sort(F.collect_list(F.struct("row", "col", *planes)))

    def plane(name: str):
        return F.transform("px", lambda s: s[name].cast("float")).alias(name)

    return (
        pixels.groupBy("image_id")
        .agg(
            F.max("row").alias("height"),
            F.max("col").alias("width"),
            packed.alias("px"),
        )
        .select(
            "image_id",
            "height",
            "width",
            *[plane(p) for p in planes],
        )
    )


def densify(pixels: DataFrame, dims: DataFrame, fill: dict[str, object]) -> DataFrame:
    """Add the missing grid positions of each image, with default values."""
    grid = dims.select(
        "image_id",
        "height",
        "width",
        F.explode(F.sequence(F.lit(1), F.col("height"))).alias("row"),
    ).select("*", F.explode(F.sequence(F.lit(1), F.col("width"))).alias("col"))
    values = [c for c in pixels.columns if c not in ("image_id", "row", "col", "height", "width")]
    return grid.join(
        pixels.select("image_id", "row", "col", *values), ["image_id", "row", "col"], "left"
    ).fillna(fill)


def class_index(name: Column) -> Column:
    """Name to 1..5; unknown is 0."""
    return F.coalesce(F.array_position(F.array(*[F.lit(c) for c in S.CLASSES]), name), F.lit(0))


def index_class(index: Column) -> Column:
    """1..5 to name; anything else is NULL."""
    return F.when(
        index.between(1, len(S.CLASSES)),
        F.element_at(F.array(*[F.lit(c) for c in S.CLASSES]), index.cast("int")),
    )


def translate(name: Column) -> Column:
    """Display name of a class or channel; unknown names are NULL."""
    table = {**S.CLASS_NAMES_DE, **S.CHANNEL_NAMES_DE}
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[name]


def class_mask(p: Column, threshold: float = 0.5) -> Column:
    return p > threshold


def to_foreground(df: DataFrame) -> DataFrame:
    """Collapse the four wound classes into one."""
    total = F.col(S.p_col(S.FOREGROUND_CLASSES[0]))
    for c in S.FOREGROUND_CLASSES[1:]:
        total = total + F.col(S.p_col(c))
    kept = [c for c in df.columns if c not in S.P_COLUMNS]
    return df.select(*kept, total.alias("p_foreground"), "p_background")


def dominant_class(threshold: float = 0.5) -> Column:
    """Largest class, earlier class on ties, only when it exceeds the threshold."""
    top = F.greatest(*S.P_COLUMNS)
    pick = F.when(F.col(S.P_COLUMNS[0]) == top, F.lit(S.CLASSES[0]))
    for name, col in list(zip(S.CLASSES, S.P_COLUMNS, strict=True))[1:]:
        pick = pick.when(F.col(col) == top, F.lit(name))
    return F.when(top > threshold, pick)


def binarise_round(df: DataFrame, binary: Sequence[str] = S.P_COLUMNS) -> DataFrame:
    """Binary channels to 0/1 (half to even); continuous channels unchanged."""
    return df.withColumns({c: round_half_even(F.col(c)) for c in binary})


def clip_to_polygon(df: DataFrame, polygon: Column) -> DataFrame:
    """Class values outside the polygon become 0; background is its complement."""
    inside = F.when(polygon > 0.5, F.lit(1.0)).otherwise(F.lit(0.0))
    changes = {S.p_col(c): F.col(S.p_col(c)) * inside for c in S.FOREGROUND_CLASSES}
    changes["p_background"] = 1.0 - inside
    return df.withColumns(changes)


def apply_mask(df: DataFrame, mask: Column) -> DataFrame:
    """Black outside the mask."""
    return df.withColumns({c: F.when(mask, F.col(c)).otherwise(0.0) for c in S.PIXEL_CHANNELS})


def mask_by_image(pixels: DataFrame, masks: DataFrame, rule: str = "sum_over_1.5") -> DataFrame:
    """Join image and mask pixels; images whose sizes differ yield no rows."""
    sized = masks.select(
        "image_id",
        "row",
        "col",
        F.col("height").alias("m_height"),
        F.col("width").alias("m_width"),
        in_mask(rule, F.col("r"), F.col("g"), F.col("b")).alias("in_mask"),
    )
    joined = pixels.join(sized, ["image_id", "row", "col"]).where(
        (F.col("height") == F.col("m_height")) & (F.col("width") == F.col("m_width"))
    )
    return apply_mask(joined, F.col("in_mask")).drop("m_height", "m_width", "in_mask")


def white_band(lo: float = 0.7, hi: float = 1.0) -> Column:
    """All channels at least ``lo`` and, when ``hi`` is below 1, at most ``hi``."""
    band = (F.col("r") >= lo) & (F.col("g") >= lo) & (F.col("b") >= lo)
    if hi < 1.0:
        band = band & (F.col("r") <= hi) & (F.col("g") <= hi) & (F.col("b") <= hi)
    return band


def with_brightness(df: DataFrame, out: str = "brightness") -> DataFrame:
    return df.withColumn(out, colour.brightness(F.col("r"), F.col("g"), F.col("b")))


def with_lch(df: DataFrame) -> DataFrame:
    light, chroma, hue = colour.rgb_to_lch(F.col("r"), F.col("g"), F.col("b"))
    return df.withColumns({"l": light, "c": chroma, "h": hue})


def with_hsv(df: DataFrame) -> DataFrame:
    hue, saturation, value = colour.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    return df.withColumns({"hue": hue, "sat": saturation, "val": value})


def overlay_last_wins(hits: DataFrame) -> DataFrame:
    """One class per pixel: the polygon latest in the list."""
    return hits.groupBy("image_id", "row", "col").agg(
        F.max_by("class", "list_pos").alias("class")
    )


def colourise(df: DataFrame, palette: str = "shape") -> DataFrame:
    """RGB per pixel as the class-weighted sum of the palette."""
    colours = S.PALETTES[palette]
    out = []
    for channel, name in enumerate(S.PIXEL_CHANNELS):
        terms = [F.col(S.p_col(c)) * colours[c][channel] for c in S.CLASSES]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        out.append(total.alias(f"c{name}"))
    return df.select("image_id", "row", "col", *out)


def gallery_rgba(df: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Gallery rule: scar+necrosis red, redness green, hematoma blue, clear elsewhere."""
    r = F.col("p_scar") + F.col("p_necrosis")
    g, b = F.col("p_redness"), F.col("p_hematoma")
    a = F.when((r > 0) | (g > 0) | (b > 0), F.lit(alpha)).otherwise(0.0)
    return df.select(
        "image_id", "row", "col", r.alias("cr"), g.alias("cg"), b.alias("cb"), a.alias("ca")
    )


def mask_rgba(mask: Column, rgb: Sequence[float], alpha: float) -> list[Column]:
    """A flat colour where the mask holds, clear elsewhere."""
    return [F.when(mask, F.lit(float(v))).otherwise(0.0) for v in (*rgb, alpha)]


def rotate90(df: DataFrame, direction: str = "cw") -> DataFrame:
    row, col = geometry.rotate90(
        F.col("row"), F.col("col"), F.col("height"), F.col("width"), direction
    )
    return df.withColumns(
        {
            "row": row.cast("int"),
            "col": col.cast("int"),
            "height": F.col("width"),
            "width": F.col("height"),
        }
    )


def in_region(r_min: Column, r_max: Column, c_min: Column, c_max: Column) -> Column:
    """Inside the box after clamping it to the image."""

    def clamp_to(value, size):
        return F.greatest(F.lit(1), F.least(value, F.col(size)))

    return F.col("row").between(clamp_to(r_min, "height"), clamp_to(r_max, "height")) & F.col(
        "col"
    ).between(clamp_to(c_min, "width"), clamp_to(c_max, "width"))


def restrict_region(df: DataFrame, r_min: Column, r_max: Column, c_min: Column, c_max: Column):
    return df.where(in_region(r_min, r_max, c_min, c_max))


def join_class_masks(inputs: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Input images with all their class masks of matching size; the rest with a reason.

    ``masks`` is long: (image_id, class, height, width, plane).
    """
    wide = masks.groupBy("image_id").agg(
        *[
            F.max(F.when(F.col("class") == c, F.col("plane"))).alias(S.p_col(c))
            for c in S.CLASSES
        ],
        F.countDistinct("class").alias("n_classes"),
        F.min("height").alias("h0"),
        F.max("height").alias("h1"),
        F.min("width").alias("w0"),
        F.max("width").alias("w1"),
    )
    joined = inputs.join(wide, "image_id", "left")
    complete = F.coalesce(F.col("n_classes") == len(S.CLASSES), F.lit(False))
    sized = (
        (F.col("h0") == F.col("height"))
        & (F.col("h1") == F.col("height"))
        & (F.col("w0") == F.col("width"))
        & (F.col("w1") == F.col("width"))
    )
    helper = ["n_classes", "h0", "h1", "w0", "w1"]
    good = joined.where(complete & sized).drop(*helper)
    bad = joined.where(~complete | ~F.coalesce(sized, F.lit(False))).select(
        "image_id",
        F.when(~complete, F.lit("missing class mask"))
        .otherwise(F.lit("mask size differs from input"))
        .alias("reason"),
    )
    return good, bad
