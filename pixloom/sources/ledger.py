"""Visit ledger and polygon documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixloom import schema as S
from pixloom.operators.polygons import FILE_PREFIX, mask_filename
from pixloom.operators.visits import clean_visits, stamp_visits

READ_VERSIONS = (2, 3)
WRITE_VERSION = 3


def read_visits(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Rows with a numeric patient id; missing texts are empty."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).schema(S.VISIT_SCHEMA)
    return clean_visits(reader.load(path))


def write_visit(new: DataFrame, path: str) -> None:
    """Append new rows stamped with the current time."""
    stamp_visits(new).write.mode("append").parquet(path)


def read_polygons(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """(one row per polygon, documents refused for their version) of JSON lines, as written here.

    Defaults: empty class name, sample number 1; colours and mask file stay NULL.
    """
    return explode_polygons(spark.read.schema(S.POLYGON_DOCUMENT).json(glob))


def read_polygon_files(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """The same of files that hold one document each, spread over any number of lines."""
    documents = spark.read.option("multiLine", True).schema(S.POLYGON_DOCUMENT).json(glob)
    return explode_polygons(documents)


def explode_polygons(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    known = F.coalesce(F.col("version").isin(*READ_VERSIONS), F.lit(False))
    rows = documents.where(known).select(
        F.col("image_index").alias("image_id"),
        "version",
        F.posexplode("polygons").alias("list_pos", "p"),
    )
    polygons = rows.select(
        "image_id",
        "version",
        (F.col("list_pos") + 1).alias("list_pos"),
        F.col("p.id").alias("polygon_id"),
        F.col("p.class").alias("class"),
        F.coalesce("p.class_name", F.lit("")).alias("class_name"),
        F.coalesce("p.sample_number", F.lit(1)).alias("sample_number"),
        F.col("p.vertices").alias("vertices"),
        F.coalesce("p.complete", F.lit(False)).alias("complete"),
        F.col("p.lch_data").alias("lch_data"),
        F.col("p.mask_file").alias("mask_file"),
    )
    return polygons, documents.where(~known).select("image_index", "version")


def polygon_documents(polygons: DataFrame, prefix: str = FILE_PREFIX) -> DataFrame:
    """One document per image in the written version; mask file names are derived."""
    entry = F.struct(
        "list_pos",
        F.col("polygon_id").alias("id"),
        "class",
        "class_name",
        "sample_number",
        "vertices",
        "complete",
        "lch_data",
        mask_filename(F.col("image_id"), F.col("class_name"), F.col("polygon_id"), prefix).alias(
            "mask_file"
        ),
    )
    listed = polygons.groupBy("image_id").agg(F.array_sort(F.collect_list(entry)).alias("ps"))
    return listed.select(
        F.lit(WRITE_VERSION).alias("version"),
        F.col("image_id").alias("image_index"),
        F.lit("separate_files").alias("mask_format"),
        F.transform("ps", lambda p: p.dropFields("list_pos")).alias("polygons"),
    )


def write_polygons(polygons: DataFrame, path: str, prefix: str = FILE_PREFIX) -> None:
    polygon_documents(polygons, prefix).write.mode("overwrite").json(path)


def write_augmented(
    samples: DataFrame,
    lineage: DataFrame,
    path: str,
    save_hook=None,
    excluded: DataFrame | None = None,
) -> None:
    """Sample pixels by target class, lineage, and a one-row run summary.

    ``save_hook`` may transform the sample table before it is written.
    """
    out = samples if save_hook is None else save_hook(samples)
    lineage.write.mode("overwrite").parquet(f"{path}/lineage")
    out.write.mode("overwrite").partitionBy("target_class").parquet(f"{path}/samples")
    counts = lineage.groupBy("target_class").agg(F.count(F.lit(1)).alias("n"))
    summary = counts.agg(
        F.map_from_entries(F.collect_list(F.struct("target_class", "n"))).alias("distribution"),
        F.sum("n").alias("n_samples"),
        F.current_timestamp().alias("created_at"),
    )
    none = F.lit(0).cast("long")
    n_excluded = none if excluded is None else excluded.agg(F.count(F.lit(1))).scalar()
    summary = summary.withColumn("n_excluded", n_excluded)
    summary.write.mode("overwrite").parquet(f"{path}/summary")


def read_augmented_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/lineage"), spark.read.parquet(f"{path}/summary")


def read_augmented_sample(spark: SparkSession, path: str, sample_id: str) -> DataFrame:
    """Pixels of one sample; the class in the id prunes the partitions."""
    target = sample_id.rsplit("-", 1)[0]
    df = spark.read.parquet(f"{path}/samples")
    return df.where((F.col("target_class") == target) & (F.col("sample_id") == sample_id))
