"""Dataset statistics: class areas, channel moments, outliers, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixloom import schema as S
from pixloom.operators.scale import exact_percentiles, join_on


def per_image_class_areas(pixels: DataFrame) -> DataFrame:
    """Wide: one row per image with the five class areas and the pixel count."""
    return pixels.groupBy("image_id").agg(
        *[F.sum(S.p_col(c)).alias(c) for c in S.CLASSES],
        F.count(F.lit(1)).alias("pixels"),
    )


def unpivot_classes(df: DataFrame, value: str, classes: Sequence[str] = S.CLASSES) -> DataFrame:
    """Class columns to (class, value) rows; no shuffle."""
    kept = [c for c in df.columns if c not in classes]
    pairs = F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias(value)) for c in classes])
    return df.select(*kept, F.explode(pairs).alias("e")).select(*kept, "e.class", f"e.{value}")


def class_area_stats(pixels: DataFrame) -> DataFrame:
    """Per class: total, mean and sample std over images, share of the summed means."""
    areas = per_image_class_areas(pixels)
    one = areas.agg(
        *[
            F.struct(
                F.lit(c).alias("class"),
                F.sum(c).alias("total_area"),
                F.avg(c).alias("mean_area"),
                F.stddev_samp(c).alias("std_area"),
            ).alias(c)
            for c in S.CLASSES
        ],
        F.sum("pixels").alias("total_pixels"),
        F.count(F.lit(1)).alias("n_images"),
    )
    mean_total = sum(F.col(f"{c}.mean_area") for c in S.CLASSES)
    rows = one.select(
        "total_pixels",
        "n_images",
        mean_total.alias("mean_total"),
        F.explode(F.array(*S.CLASSES)).alias("e"),
    )
    return rows.select(
        "e.class",
        "e.total_area",
        "e.mean_area",
        "e.std_area",
        F.try_divide(F.col("e.mean_area"), F.col("mean_total")).alias("normalised"),
        "total_pixels",
        "n_images",
    )


def class_shares(pixels: DataFrame) -> DataFrame:
    """Per image and class: area over the summed class areas, when that sum is positive."""
    areas = per_image_class_areas(pixels).drop("pixels")
    total = sum(F.col(c) for c in S.CLASSES)
    shares = areas.withColumn("__t", total).where("__t > 0")
    shares = shares.select("image_id", *[(F.col(c) / F.col("__t")).alias(c) for c in S.CLASSES])
    return unpivot_classes(shares, "share")


def source_profile(pixels: DataFrame) -> DataFrame:
    """Class percentages of the pixel count, per source image."""
    areas = per_image_class_areas(pixels)
    return areas.select(
        F.col("image_id").alias("source_index"),
        *[(F.col(c) / F.col("pixels") * 100.0).alias(f"{c}_percentage") for c in S.CLASSES],
        F.col("pixels").alias("total_pixels"),
    )


def foreground_pct(pixels: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    total = sum(F.col(S.p_col(c)) for c in S.FOREGROUND_CLASSES)
    return pixels.groupBy(*keys).agg(
        (F.sum(total) / F.count(F.lit(1)) * 100.0).alias("foreground_pct")
    )


def ref_skewness(value, minimum_n: int = 2) -> Column:
    """Third central moment over the cubed sample std; undefined is 0."""
    value = F.col(value) if isinstance(value, str) else value
    n = F.count(value)
    raw = F.skewness(value) * F.pow((n - 1) / n, F.lit(1.5))
    return F.when(n >= minimum_n, F.coalesce(raw, F.lit(0.0))).otherwise(F.lit(0.0))


def channel_stats_by_image(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg(
        *[F.avg(c).alias(f"{c}_mean") for c in S.PIXEL_CHANNELS],
        *[F.stddev_samp(c).alias(f"{c}_std") for c in S.PIXEL_CHANNELS],
        *[ref_skewness(c).alias(f"{c}_skew") for c in S.PIXEL_CHANNELS],
    )


def channel_stats(pixels: DataFrame) -> DataFrame:
    """Global: mean and sample std of the image means, mean of the image skews."""
    per_image = channel_stats_by_image(pixels)
    return per_image.agg(
        *[F.avg(f"{c}_mean").alias(f"{c}_mean") for c in S.PIXEL_CHANNELS],
        *[F.stddev_samp(f"{c}_mean").alias(f"{c}_std") for c in S.PIXEL_CHANNELS],
        *[F.avg(f"{c}_skew").alias(f"{c}_skew") for c in S.PIXEL_CHANNELS],
        F.count(F.lit(1)).alias("n_images"),
    )


def channel_correlation(pixels: DataFrame) -> DataFrame:
    """Pearson r between channel means over images."""
    means = pixels.groupBy("image_id").agg(*[F.avg(c).alias(c) for c in S.PIXEL_CHANNELS])
    return means.agg(
        F.corr("r", "g").alias("corr_rg"),
        F.corr("r", "b").alias("corr_rb"),
        F.corr("g", "b").alias("corr_gb"),
    )


def masked_channel_stats(pixels: DataFrame, mask: Column, prefix: str = "") -> DataFrame:
    """Per image over masked pixels; images without any give zeros, skew needs n > 2."""
    masked = {c: F.when(mask, F.col(c)) for c in S.PIXEL_CHANNELS}
    zero = F.lit(0.0)
    return pixels.groupBy("image_id").agg(
        *[F.coalesce(F.avg(v), zero).alias(f"{prefix}{c}_mean") for c, v in masked.items()],
        *[F.coalesce(F.stddev_samp(v), zero).alias(f"{prefix}{c}_std") for c, v in masked.items()],
        *[ref_skewness(v, 3).alias(f"{prefix}{c}_skew") for c, v in masked.items()],
        F.count_if(mask).alias(f"{prefix}pixel_count"),
    )


def iqr_outliers(
    df: DataFrame, value: str, keys: Sequence[str] = (), factor: float = 1.5, exact: bool = True
) -> DataFrame:
    """Rows with an ``is_outlier`` flag: strictly outside the quartile fences."""
    keys = list(keys)
    if exact:
        fences = exact_percentiles(df, keys, {value: [("q1", 0.25), ("q3", 0.75)]})
    else:
        ranks = F.percentile_approx(value, [0.25, 0.75], 10_000)
        fences = df.groupBy(*keys).agg(ranks.alias("q"))
        fences = fences.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    fences = fences.select(
        *keys,
        (F.col("q1") - factor * (F.col("q3") - F.col("q1"))).alias("lower"),
        (F.col("q3") + factor * (F.col("q3") - F.col("q1"))).alias("upper"),
    )
    if keys:
        joined = join_on(df, fences, keys)
    else:
        joined = df.withColumns(
            {"lower": fences.select("lower").scalar(), "upper": fences.select("upper").scalar()}
        )
    return joined.withColumn(
        "is_outlier", (F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper"))
    )


def outlier_summary(flagged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return flagged.groupBy(*keys).agg(
        F.count_if("is_outlier").alias("n_outliers"),
        (F.count_if("is_outlier") / F.count(F.lit(1)) * 100.0).alias("outlier_pct"),
    )


def histogram(
    df: DataFrame,
    value: str,
    bins: int,
    keys: Sequence[str] = (),
    mode: str = "count",
    lo: float | None = None,
    hi: float | None = None,
) -> DataFrame:
    """Equal-width bins, empty ones included; the maximum falls into the last bin.

    Without ``lo``/``hi`` each key uses its own range. ``mode="pdf"`` divides by
    count and width. Values outside a given range are counted in bins -1 (below)
    and ``bins`` (above), which appear only where there are such values.
    """
    keys = list(keys)
    grouped = keys or ["__all"]
    data = df if keys else df.withColumn("__all", F.lit(0))
    data = data.where(F.col(value).isNotNull()).select(
        *grouped, F.col(value).cast("double").alias("__x")
    )
    if lo is None or hi is None:
        bounds = data.groupBy(*grouped).agg(
            F.min("__x").alias("__lo"), F.max("__x").alias("__hi")
        )
        data = join_on(data, bounds, grouped)
    else:
        bounds = data.select(*grouped).distinct()
        bounds = bounds.withColumns({"__lo": F.lit(float(lo)), "__hi": F.lit(float(hi))})
        data = data.withColumns({"__lo": F.lit(float(lo)), "__hi": F.lit(float(hi))})
    width = (F.col("__hi") - F.col("__lo")) / bins
    raw = F.when(width > 0, F.floor((F.col("__x") - F.col("__lo")) / width)).otherwise(0)
    inside = F.least(raw, F.lit(bins - 1))
    place = F.when(F.col("__x") < F.col("__lo"), -1).when(F.col("__x") > F.col("__hi"), bins)
    counted = (
        data.withColumn("bin", place.otherwise(inside).cast("int"))
        .groupBy(*grouped, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = bounds.select(
        *grouped,
        "__lo",
        width.alias("__w"),
        F.explode(F.sequence(F.lit(-1), F.lit(bins))).alias("bin"),
    )
    full = join_on(frame, counted, [*grouped, "bin"], "left")
    full = full.where(F.col("bin").between(0, bins - 1) | F.col("n").isNotNull()).fillna({"n": 0})
    full = full.withColumn("bin_start", F.col("__lo") + F.col("bin") * F.col("__w"))
    out = [*keys, "bin", "bin_start", "n"]
    if mode == "pdf":
        totals = counted.groupBy(*grouped).agg(F.sum("n").alias("__n"))
        full = join_on(full, totals, grouped).withColumn(
            "density",
            F.when(F.col("__w") > 0, F.col("n") / (F.col("__n") * F.col("__w"))).otherwise(0.0),
        )
        out.append("density")
    return full.select(*out)


def region_vs_full_channels(pixels: DataFrame, region: Column, bins: int = 50) -> DataFrame:
    """Channel moments of the full image beside those of the region, long by scope."""
    full = masked_channel_stats(pixels, F.lit(True)).withColumn("scope", F.lit("full"))
    part = masked_channel_stats(pixels, region).withColumn("scope", F.lit("region"))
    return full.unionByName(part)


def region_vs_full_histograms(pixels: DataFrame, region: Column, bins: int = 50) -> DataFrame:
    """Fixed-range channel histograms per image for both scopes in one pass."""
    scopes = F.when(region, F.array(F.lit("full"), F.lit("region"))).otherwise(
        F.array(F.lit("full"))
    )
    values = F.array(
        *[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in S.PIXEL_CHANNELS]
    )
    long = (
        pixels.select("image_id", F.explode(scopes).alias("scope"), values.alias("vs"))
        .select("image_id", "scope", F.explode("vs").alias("e"))
        .select("image_id", "scope", "e.channel", "e.v")
    )
    return histogram(long, "v", bins, ["image_id", "scope", "channel"], "count", 0.0, 1.0)


def bbox_summary(components: DataFrame) -> DataFrame:
    """Per class mean and sample std of width, height, aspect ratio; absent classes give zeros."""
    zero = F.lit(0.0)
    measures = ("width", "height", "aspect_ratio")
    found = components.groupBy("class").agg(
        *[F.avg(m).alias(f"mean_{m}") for m in measures],
        *[F.stddev_samp(m).alias(f"std_{m}") for m in measures],
        F.count(F.lit(1)).alias("num_components"),
    )
    names = [c for c in S.FOREGROUND_CLASSES]
    frame = components.sparkSession.createDataFrame([(c,) for c in names], "class string")
    joined = frame.join(found, "class", "left")
    return joined.select(
        "class",
        *[F.coalesce(f"mean_{m}", zero).alias(f"mean_{m}") for m in measures],
        *[
            F.when(F.coalesce(F.col("num_components"), F.lit(0)) == 0, zero)
            .otherwise(F.col(f"std_{m}"))
            .alias(f"std_{m}")
            for m in measures
        ],
        F.coalesce("num_components", F.lit(0)).alias("num_components"),
    )


def bbox_slope(components: DataFrame) -> DataFrame:
    """Least-squares line height ~ width per class, for at least two boxes of varying width."""
    fitted = components.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"),
        F.var_pop("width").alias("var_width"),
        F.covar_pop("width", "height").alias("cov"),
        F.avg("width").alias("mean_width"),
        F.avg("height").alias("mean_height"),
    )
    slope = F.when((F.col("n") >= 2) & (F.col("var_width") > 0), F.col("cov") / F.col("var_width"))
    return fitted.select(
        "class",
        "n",
        slope.alias("slope"),
        (F.col("mean_height") - slope * F.col("mean_width")).alias("intercept"),
    )
