"""Visit ledger: validation, edits, ordinals, gaps, population counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixloom.functions.scalars import DATE_PATTERN, day_difference, or_empty, parse_date
from pixloom.operators.scale import blocked_rank

ID_BLOCK = 1 << 16
INFO_LIMIT = 500


def clean_visits(raw: DataFrame) -> DataFrame:
    """Rows with a numeric patient id; missing texts become empty."""
    return (
        raw.withColumn("patient_id", F.col("patient_id").try_cast("int"))
        .where(F.col("patient_id").isNotNull())
        .withColumns({c: or_empty(F.col(c)) for c in ("filename", "visit_date", "info")})
    )


def visit_problem(
    date: Column, patient: Column, info: Column, profile: str = "optional_date", today=None
) -> Column:
    """First reason a ledger row is invalid, or NULL. ``today`` defaults to the current date."""
    today = F.current_date() if today is None else today
    parsed = parse_date(date)
    number = F.trim(patient).try_cast("int")
    empty_ok = profile == "optional_date"
    date_missing = F.coalesce(date, F.lit("")) == ""
    reason = F.when(date_missing & F.lit(not empty_ok), F.lit("date format"))
    reason = reason.when(~date_missing & ~date.rlike(DATE_PATTERN), F.lit("date format"))
    reason = reason.when(~date_missing & parsed.isNull(), F.lit("not a date"))
    reason = reason.when(~date_missing & (parsed > today), F.lit("date in future"))
    reason = reason.when(F.coalesce(F.trim(patient), F.lit("")) == "", F.lit("patient missing"))
    reason = reason.when(number.isNull(), F.lit("patient not a number"))
    reason = reason.when(number <= 0, F.lit("patient not positive"))
    return reason.when(F.length(info) > INFO_LIMIT, F.lit("info too long"))


def validate_visits(
    df: DataFrame, profile: str = "optional_date", today=None
) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``reason``)."""
    checked = df.withColumn(
        "reason",
        visit_problem(
            F.col("visit_date"), F.col("patient_id").cast("string"), F.col("info"), profile, today
        ),
    )
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


def stamp_visits(new: DataFrame, now=None) -> DataFrame:
    """New rows carry the same creation and update time."""
    now = F.current_timestamp() if now is None else now
    return new.withColumns({"created_at": now, "updated_at": now})


def append_visit(df: DataFrame, new: DataFrame, now=None) -> DataFrame:
    return df.unionByName(stamp_visits(new, now).select(*df.columns))


def upsert_visits(df: DataFrame, changes: DataFrame, now=None) -> DataFrame:
    """Replace the changed fields by image, keep ``created_at``, add unknown images.

    ``changes`` has at most one row per image; NULL fields keep the old value.
    """
    now = F.current_timestamp() if now is None else now
    fields = [c for c in changes.columns if c != "image_index"]
    renamed = changes.select(
        "image_index", *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__changed")
    )
    joined = df.join(renamed, "image_index", "full_outer")
    changed = F.coalesce(F.col("__changed"), F.lit(False))
    out = []
    for c in df.columns:
        if c == "created_at":
            out.append(F.coalesce(F.col(c), now).alias(c))
        elif c == "updated_at":
            out.append(F.when(changed, now).otherwise(F.col(c)).alias(c))
        elif c in fields:
            out.append(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def latest_versions(df: DataFrame, key: str = "image_index", version: str = "updated_at"):
    """One row per key, the most recent version."""
    rest = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(rest, version).alias("r")).select(key, "r.*")


def find_visit(df: DataFrame, wanted: DataFrame, position: str) -> DataFrame:
    """First ledger row of each wanted image, with a ``found`` flag."""
    fields = [c for c in df.columns if c != "image_index"]
    first = df.groupBy("image_index").agg(F.min_by(F.struct(*fields), position).alias("v"))
    return wanted.join(first, "image_index", "left").select(
        "image_index", F.col("v").isNotNull().alias("found"), "v.*"
    )


def join_images(visits: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(visits with their image, visits whose image is missing)."""
    keyed = images.withColumnRenamed("image_id", "image_index")
    return visits.join(keyed, "image_index"), visits.join(keyed, "image_index", "left_anti")


def visit_ordinal(visits: DataFrame, out: str = "t") -> DataFrame:
    """T1, T2, ... by (date, image) per patient; many visits of one patient are
    numbered in (date, id block) pieces, never in one task."""
    return blocked_rank(
        visits,
        ["patient_id"],
        [("d", F.col("visit_date")), ("b", F.floor(F.col("image_index") / ID_BLOCK))],
        ["visit_date", "image_index"],
        out,
    )


def visit_gaps(ordered: DataFrame) -> DataFrame:
    """Whole days between consecutive visits; ``gap`` g lies between T(g) and T(g+1)."""
    later = ordered.select(
        "patient_id", (F.col("t") - 1).alias("t"), F.col("visit_date").alias("next_date")
    )
    return ordered.join(later, ["patient_id", "t"]).select(
        "patient_id",
        F.col("t").alias("gap"),
        day_difference(F.col("next_date"), F.col("visit_date")).alias("days"),
    )


def gap_histogram(gaps: DataFrame) -> DataFrame:
    """One-day bins per gap number; empty days between the extremes are listed with 0."""
    counted = gaps.groupBy("gap", "days").agg(F.count(F.lit(1)).alias("n"))
    frame = (
        counted.groupBy("gap")
        .agg(F.min("days").alias("lo"), F.max("days").alias("hi"))
        .select("gap", F.explode(F.sequence("lo", "hi")).alias("days"))
    )
    return frame.join(counted, ["gap", "days"], "left").fillna({"n": 0})


def image_counts(visits: DataFrame) -> DataFrame:
    return visits.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_images"))


def filter_exact_count(counts: DataFrame, n: int) -> DataFrame:
    """Patients with exactly ``n`` images; ``n`` <= 0 keeps all."""
    return counts if n <= 0 else counts.where(F.col("n_images") == n)


def count_of_counts(counts: DataFrame) -> DataFrame:
    """Patients per image count (2 and more), plus all patients as count 0."""
    grouped = counts.groupBy("n_images").agg(F.count(F.lit(1)).alias("n_patients"))
    listed = grouped.where(F.col("n_images") >= 2)
    whole = grouped.agg(
        F.lit(0).cast("long").alias("n_images"),
        F.coalesce(F.sum("n_patients"), F.lit(0)).alias("n_patients"),
    )
    return whole.unionByName(listed)


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
