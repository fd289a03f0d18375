"""Colour measurement and correction jobs over the pixel table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixloom import schema as S
from pixloom.functions import colour
from pixloom.operators.pixels import MASK_RULES, in_mask, with_hsv, with_lch
from pixloom.operators.scale import exact_medians
from pixloom.operators.stats import histogram
from pixloom.session import cut_lineage

LCH = ("l", "c", "h")


HUE_MEANS = ("linear", "circular")


def circular_mean(degrees: Column) -> Column:
    """Direction of the summed unit vectors, 0 to 360; NULL where they cancel out or there are none."""
    x, y = F.avg(F.cos(F.radians(degrees))), F.avg(F.sin(F.radians(degrees)))
    return F.when(F.hypot(x, y) > 1e-9, F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)))


def _mean(measure: str, value: Column, hue: str) -> Column:
    if hue not in HUE_MEANS:
        raise ValueError(f"hue is one of {HUE_MEANS}")
    return circular_mean(value) if measure == "h" and hue == "circular" else F.avg(value)


def _lch_summary(values: DataFrame, keys: Sequence[str], hue: str = "linear") -> DataFrame:
    return exact_medians(
        values,
        keys,
        {v: f"{v}_median" for v in LCH},
        {**{f"{v}_mean": _mean(v, F.col(v), hue) for v in LCH}, "pixel_count": F.count("l")},
    ).drop(*[f"n_{v}" for v in LCH])


def _fill_absent(frame: DataFrame, measured: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Absent groups keep NULL measures and a pixel count of 0."""
    return frame.join(measured, list(keys), "left").fillna({"pixel_count": 0})


def class_lch(
    pixels: DataFrame,
    classes: Sequence[str] = S.FOREGROUND_CLASSES,
    threshold: float = 0.5,
    hue: str = "linear",
) -> DataFrame:
    """L, C, h medians and means per image and class under the class mask.

    ``hue`` chooses the mean of the hue: of the numbers, or of the directions (``circular``).
    A class is a column of each measure, NULL off its mask, so one group per image serves all classes and
    a class that an image lacks needs no further pass: NULL measures, a pixel count of 0.
    """
    wanted = [c for c in classes if c != "background"]
    coloured = with_lch(pixels.select("image_id", "r", "g", "b", *[S.p_col(c) for c in wanted]))
    names = {c: {v: f"{v}_{c}" for v in LCH} for c in wanted}
    values = coloured.select(
        "image_id", *[F.when(F.col(S.p_col(c)) > threshold, F.col(v)).alias(n) for c in wanted for v, n in names[c].items()]
    )
    flat = [n for c in wanted for n in names[c].values()]
    measured = exact_medians(values, ["image_id"], {n: f"{n}_median" for n in flat}, {f"{n}_mean": _mean(v, F.col(n), hue) for c in wanted for v, n in names[c].items()})
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("class"),
                F.col(f"n_{names[c]['l']}").alias("pixel_count"),
                *[F.col(f"{n}_{m}").alias(f"{v}_{m}") for m in ("mean", "median") for v, n in names[c].items()],
            )
            for c in wanted
        ]
    )
    long = measured.select("image_id", F.explode(rows).alias("e"))
    return long.select("image_id", "e.class", *[f"e.{v}_mean" for v in LCH], "e.pixel_count", *[f"e.{v}_median" for v in LCH])


def polygon_lch(hits: DataFrame, polygons: DataFrame, hue: str = "linear") -> DataFrame:
    """The same inside each polygon; ``hits`` are pixels already matched to polygons."""
    measured = _lch_summary(
        with_lch(hits).select("image_id", "polygon_id", *LCH), ["image_id", "polygon_id"], hue
    )
    frame = polygons.select("image_id", "polygon_id")
    return _fill_absent(frame, measured, ["image_id", "polygon_id"])


def mask_lch(pixels: DataFrame, mask: Column, hue: str = "linear") -> DataFrame:
    """The same under a single mask; the class is named ``polygon_region``."""
    # Values off the mask are NULL, so images without a mask keep their row.
    values = with_lch(pixels).select(
        "image_id", *[F.when(mask, F.col(v)).alias(v) for v in LCH]
    )
    return _lch_summary(values, ["image_id"], hue).withColumn("class", F.lit("polygon_region"))


def hsv_profile(pixels: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Median hue (degrees), saturation and value (percent) of non-black pixels."""
    keys = list(keys)
    is_lit = in_mask("any_over_0", F.col("r"), F.col("g"), F.col("b"))
    values = with_hsv(pixels).select(
        *keys, *[F.when(is_lit, F.col(c)).alias(c) for c in ("hue", "sat", "val")]
    )
    medians = exact_medians(
        values, keys, {"hue": "h_median", "sat": "s_median", "val": "v_median"}
    ).fillna(0.0)
    return medians.select(
        *keys,
        (F.col("h_median") * 360.0).alias("h_median_deg"),
        (F.col("s_median") * 100.0).alias("s_median_pct"),
        (F.col("v_median") * 100.0).alias("v_median_pct"),
        F.col("n_hue").alias("n_pixels"),
    )


def white_point(pixels: DataFrame, rule: str = "any_over_0.01") -> DataFrame:
    """XYZ of the median linear colour per image; images without lit pixels get D65."""
    if rule not in MASK_RULES:
        raise ValueError(f"unknown mask rule {rule}")
    is_lit = in_mask(rule, F.col("r"), F.col("g"), F.col("b"))
    values = pixels.select(
        "image_id",
        *[
            F.when(is_lit, colour.srgb_to_linear(F.col(c))).alias(f"lin_{c}")
            for c in S.PIXEL_CHANNELS
        ],
    )
    out = exact_medians(
        values, ["image_id"], {f"lin_{c}": f"m_{c}" for c in S.PIXEL_CHANNELS}
    )
    xyz = colour.mat_vec(colour.SRGB_TO_XYZ, [F.col(f"m_{c}") for c in S.PIXEL_CHANNELS])
    fallback = colour.ILLUMINANTS["D65"]
    return out.select(
        "image_id",
        *[
            F.coalesce(v, F.lit(d)).alias(f"white_{n}")
            for n, v, d in zip("xyz", xyz, fallback, strict=True)
        ],
        F.col("n_lin_r").alias("white_pixels"),
    )


def white_balance(
    pixels: DataFrame,
    whites: DataFrame,
    reference: str = "D65",
    preserve_luminance: bool = False,
) -> DataFrame:
    """Adapt each image from its own white to the reference white.

    Three gains, then nine matrix entries, are computed once per image on the small
    white table and joined to the pixels by image.
    """
    src = [F.col(f"white_{n}") for n in "xyz"]
    if preserve_luminance:
        src = colour.normalise_white(*src)
    ref = [F.lit(v) for v in colour.ILLUMINANTS[reference]]
    gain = ["__k0", "__k1", "__k2"]
    gains = whites.select(
        "image_id",
        *[k.alias(n) for k, n in zip(colour.bradford_scale(src, ref), gain, strict=True)],
    )
    matrix = colour.rgb_gain_matrix([F.col(n) for n in gain])
    names = [[f"__m{i}{j}" for j in range(3)] for i in range(3)]
    table = gains.select(
        "image_id", *[matrix[i][j].alias(names[i][j]) for i in range(3) for j in range(3)]
    )
    joined = pixels.join(table, "image_id")
    balanced = colour.white_balance_rgb(
        [F.col(c) for c in S.PIXEL_CHANNELS], [[F.col(n) for n in row] for row in names]
    )
    flat = [n for row in names for n in row]
    return joined.withColumns(
        dict(zip(S.PIXEL_CHANNELS, balanced, strict=True))
    ).drop(*flat)


def balance_phases(pixels: DataFrame, ruler: Column, region: Column, reference: str = "D65"):
    """Pixels of the full image and the region, before and after balancing."""
    tagged = pixels.withColumn("__region", region)
    whites = white_point(pixels.where(ruler))
    frame = pixels.select("image_id").distinct()
    fallback = colour.ILLUMINANTS["D65"]
    whites = frame.join(whites, "image_id", "left").fillna(
        {f"white_{n}": v for n, v in zip("xyz", fallback, strict=True)}
    )
    # One row per image, read by every pass below: kept instead of measured again.
    whites = cut_lineage(whites)
    after = white_balance(tagged, whites, reference).withColumn("phase", F.lit("after"))
    before = tagged.withColumn("phase", F.lit("before"))
    both = before.unionByName(after)
    scopes = F.when(F.col("__region"), F.array(F.lit("full"), F.lit("region"))).otherwise(
        F.array(F.lit("full"))
    )
    return both.withColumn("scope", F.explode(scopes)).drop("__region")


def balance_report(pixels: DataFrame, ruler: Column, region: Column, reference: str = "D65"):
    """HSV medians by image, phase and scope."""
    return hsv_profile(
        balance_phases(pixels, ruler, region, reference), ["image_id", "phase", "scope"]
    )


def balance_histograms(
    pixels: DataFrame, ruler: Column, region: Column, reference: str = "D65", bins: int = 50
) -> DataFrame:
    """Densities of hue, saturation and value by image, phase and scope."""
    phases = with_hsv(
        balance_phases(pixels, ruler, region, reference).where(
            in_mask("any_over_0", F.col("r"), F.col("g"), F.col("b"))
        )
    )
    values = F.array(
        *[
            F.struct(F.lit(n).alias("component"), F.col(n).alias("v"))
            for n in ("hue", "sat", "val")
        ]
    )
    long = phases.select("image_id", "phase", "scope", F.explode(values).alias("e")).select(
        "image_id", "phase", "scope", "e.component", "e.v"
    )
    return histogram(long, "v", bins, ["image_id", "phase", "scope", "component"], "pdf", 0.0, 1.0)
