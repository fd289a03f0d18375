"""Reports over augmentation lineage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixloom import schema as S
from pixloom.operators.augment import DEFAULT_DISTRIBUTION
from pixloom.operators.stats import histogram

RANGED = (
    "scale_factor rotation_angle shear_x_angle shear_y_angle brightness_factor"
    " saturation_offset blur_sigma size_multiplier patch_height patch_width"
).split()


def augmentation_summary(lineage: DataFrame) -> DataFrame:
    """Everything the dashboard shows, in one pass and one row."""
    n = F.count(F.lit(1))
    return lineage.agg(
        n.alias("n_samples"),
        F.countDistinct("source_index").alias("n_sources_used"),
        *[F.min(c).alias(f"min_{c}") for c in RANGED],
        *[F.max(c).alias(f"max_{c}") for c in RANGED],
        *[F.count_if(F.col("target_class") == c).alias(f"n_{c}") for c in S.CLASSES],
        *[F.avg(f"{c}_percentage").alias(f"mean_{c}_percentage") for c in S.CLASSES],
        F.avg("size_multiplier").alias("mean_multiplier"),
        F.avg("growth_iterations").alias("mean_iterations"),
        F.avg("actual_fg_percentage").alias("mean_fg_percentage"),
        F.count_if("max_size_reached").alias("n_max_size"),
        (F.count_if("max_size_reached") / n * 100.0).alias("pct_max_size"),
    )


def source_usage(lineage: DataFrame) -> DataFrame:
    return lineage.groupBy("source_index").agg(F.count(F.lit(1)).alias("uses"))


def target_vs_actual(lineage: DataFrame, distribution: Mapping[str, float] | None = None):
    """Per class: wanted samples round(pct/100*N), half to even, and the actual number."""
    distribution = DEFAULT_DISTRIBUTION if distribution is None else distribution
    one = lineage.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("target_class") == c).alias(c) for c in distribution],
    )
    rows = [
        F.struct(
            F.lit(c).alias("class"),
            F.rint(F.col("n") * pct / 100.0).cast("long").alias("target"),
            F.col(c).alias("actual"),
        )
        for c, pct in distribution.items()
    ]
    return one.select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def coverage_spread(lineage: DataFrame) -> DataFrame:
    """Mean, sample std, min and max of each class percentage over all samples."""
    one = lineage.agg(
        *[
            F.struct(
                F.lit(c).alias("class"),
                F.avg(f"{c}_percentage").alias("mean_pct"),
                F.stddev_samp(f"{c}_percentage").alias("std_pct"),
                F.min(f"{c}_percentage").alias("min_pct"),
                F.max(f"{c}_percentage").alias("max_pct"),
            ).alias(c)
            for c in S.CLASSES
        ]
    )
    return one.select(F.explode(F.array(*S.CLASSES)).alias("e")).select("e.*")


def coverage_by_target(lineage: DataFrame) -> DataFrame:
    """Mean coverage of a class among the samples targeted at it; none gives 0."""
    one = lineage.agg(
        *[
            F.struct(
                F.lit(c).alias("class"),
                F.coalesce(
                    F.avg(F.when(F.col("target_class") == c, F.col(f"{c}_percentage"))),
                    F.lit(0.0),
                ).alias("coverage"),
            ).alias(c)
            for c in S.CLASSES
        ]
    )
    return one.select(F.explode(F.array(*S.CLASSES)).alias("e")).select("e.*")


def growth_stats(lineage: DataFrame) -> DataFrame:
    """Share of every multiplier and of every iteration count."""
    pairs = F.array(
        F.struct(F.lit("multiplier").alias("kind"), F.col("size_multiplier").alias("value")),
        F.struct(F.lit("iterations").alias("kind"), F.col("growth_iterations").alias("value")),
    )
    counts = (
        lineage.select(F.explode(pairs).alias("e"))
        .groupBy("e.kind", "e.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(W.partitionBy("kind"))
    return counts.select("kind", "value", "n", (F.col("n") / total * 100.0).alias("pct"))


def stacked_composition(lineage: DataFrame) -> DataFrame:
    """Cumulative class percentages of each sample in class order."""
    total = F.lit(0.0)
    parts = []
    for i, c in enumerate(S.CLASSES, start=1):
        lower = total
        total = total + F.col(f"{c}_percentage")
        parts.append(
            F.struct(
                F.lit(i).alias("class_index"),
                F.lit(c).alias("class"),
                lower.alias("lower"),
                total.alias("upper"),
            )
        )
    return lineage.select("augmented_index", F.explode(F.array(*parts)).alias("e")).select(
        "augmented_index", "e.*"
    )


def parameter_histograms(lineage: DataFrame, bins: Mapping[str, int] | None = None) -> DataFrame:
    """Histograms of the drawn parameters, long by parameter, each on its own range."""
    bins = bins or {"scale_factor": 20, "rotation_angle": 36, "shear_x_angle": 20,
                    "shear_y_angle": 20, "brightness_factor": 10, "saturation_offset": 10,
                    "blur_sigma": 10}
    out = None
    for name, count in bins.items():
        part = histogram(lineage, name, count).withColumn("parameter", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
