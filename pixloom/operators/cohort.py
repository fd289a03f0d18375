"""Per-patient colour timelines and their cohort statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixloom.functions.scalars import nan_to_null, parse_date
from pixloom.operators.scale import exact_percentiles
from pixloom.operators.visits import visit_ordinal

MEASURES = ("l", "c", "h")
SCALES = {"l": 100.0, "c": 150.0, "h": 360.0}


def datable_visits(visits: DataFrame) -> DataFrame:
    """Visits whose text date parses; the others are dropped before numbering."""
    return visits.withColumn("visit_date", parse_date(F.col("visit_date"))).where(
        F.col("visit_date").isNotNull()
    )


def patient_timeline(visits: DataFrame, lch: DataFrame) -> DataFrame:
    """Numbered visits with the class colours of their image.

    Visits whose image was not measured are dropped before numbering.
    """
    measured = lch.select(F.col("image_id").alias("image_index")).distinct()
    kept = visits.join(measured, "image_index", "left_semi")
    numbered = visit_ordinal(kept.select("image_index", "patient_id", "visit_date"))
    return numbered.join(lch.withColumnRenamed("image_id", "image_index"), "image_index")


def patient_timeline_polygon(visits: DataFrame, images: DataFrame, lch: DataFrame) -> DataFrame:
    """Same over one region mask; a visit without a mask keeps its number, with no colours."""
    known = images.select(F.col("image_id").alias("image_index")).distinct()
    kept = visits.join(known, "image_index", "left_semi")
    numbered = visit_ordinal(kept.select("image_index", "patient_id", "visit_date"))
    joined = numbered.join(
        lch.withColumnRenamed("image_id", "image_index"), "image_index", "left"
    )
    return joined.fillna({"pixel_count": 0, "class": "polygon_region"})


def failed_patients(visits: DataFrame, timeline: DataFrame) -> DataFrame:
    """Patients of the ledger without any usable visit."""
    return (
        visits.select("patient_id")
        .distinct()
        .join(timeline.select("patient_id").distinct(), "patient_id", "left_anti")
    )


def cohort_stats(timeline: DataFrame, mode: str = "all") -> DataFrame:
    """Per class and timepoint over patients: mean, sample std, exact quartiles.

    Missing measures (NULL or NaN) are ignored. ``mode="reference"`` cuts all
    series to the length of the first patient's.
    """
    data = timeline.select(
        "patient_id", "class", "t", *[nan_to_null(F.col(f"{m}_median")).alias(m) for m in MEASURES]
    )
    if mode == "reference":
        lengths = data.groupBy("patient_id").agg(F.max("t").alias("n"))
        length = lengths.agg(F.min_by("n", "patient_id").alias("n"))
        data = data.where(F.col("t") <= length.scalar())
    wanted = {
        m: [(f"{m}_q25", 0.25), (f"{m}_median", 0.5), (f"{m}_q75", 0.75)] for m in MEASURES
    }
    extra = {"n": F.count(F.lit(1))}
    for m in MEASURES:
        extra[f"{m}_mean"] = F.avg(m)
        extra[f"{m}_std"] = F.stddev_samp(m)
    return exact_percentiles(data, ["class", "t"], wanted, extra)


def cohort_table(stats: DataFrame) -> DataFrame:
    """Display rows: T-label and mean/std with one decimal, ``---`` when absent."""

    def shown(column: str):
        text = F.format_string("%.1f", F.bround(column, 1))
        return F.when(F.col(column).isNull(), F.lit("---")).otherwise(text)

    cells = {f"{m}_{s}": shown(f"{m}_{s}") for m in MEASURES for s in ("mean", "std")}
    return stats.select(
        "class",
        F.concat(F.lit("T"), F.col("t").cast("string")).alias("timepoint"),
        *[v.alias(k) for k, v in cells.items()],
    )


def cohort_bands(stats: DataFrame) -> DataFrame:
    """Measures scaled to 0..1: mean +- std band and quartile band, long by measure.

    Timepoints where any member is missing are dropped.
    """
    parts = []
    for m in MEASURES:
        s = SCALES[m]
        mean, std = F.col(f"{m}_mean") / s, F.col(f"{m}_std") / s
        parts.append(
            F.struct(
                F.lit(m).alias("measure"),
                mean.alias("mean"),
                (mean - std).alias("lower"),
                (mean + std).alias("upper"),
                (F.col(f"{m}_median") / s).alias("median"),
                (F.col(f"{m}_q25") / s).alias("q25"),
                (F.col(f"{m}_q75") / s).alias("q75"),
            )
        )
    exploded = stats.select("class", "t", F.explode(F.array(*parts)).alias("e"))
    return exploded.select("class", "t", "e.*").dropna()


def trajectories(timeline: DataFrame) -> DataFrame:
    """Scaled points per patient and class; incomplete points are dropped."""
    return timeline.select(
        "patient_id",
        "class",
        "t",
        *[(nan_to_null(F.col(f"{m}_median")) / SCALES[m]).alias(m) for m in MEASURES],
    ).dropna()
