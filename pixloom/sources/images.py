"""Image folders, raw dense arrays and Parquet datasets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixloom import schema as S
from pixloom.operators.pixels import clip_to_polygon, join_class_masks, to_pixels

DEFAULT_PREFIX = "image"
INPUT_KIND = "raw_adj"


def _path_pattern(prefix: str, ext: str) -> str:
    """<prefix>_NNN/<prefix>_NNN_<kind>.<ext>"""
    return rf"{prefix}_(\d{{3,}})/{prefix}_(\d{{3,}})_(.+)\.{ext}$"


def _named(df: DataFrame, path: Column, prefix: str, ext: str) -> DataFrame:
    pattern = _path_pattern(prefix, ext)
    return df.where(path.rlike(pattern)).select(
        F.regexp_extract(path, pattern, 2).cast("int").alias("image_id"),
        F.regexp_extract(path, pattern, 3).alias("kind"),
        "*",
    )


def scan_images(
    spark: SparkSession, root: str, kind: str | None = None, ext: str = "png",
    prefix: str = DEFAULT_PREFIX,
) -> DataFrame:
    """Decoded files of the folder convention: (image_id, kind, image)."""
    name = f"*_{kind}.{ext}" if kind else f"*.{ext}"
    files = (
        spark.read.format("image")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .load(root)
    )
    named = _named(files, F.col("image.origin"), prefix, ext)
    return named if kind is None else named.where(F.col("kind") == kind)


def inventory(
    spark: SparkSession, root: str, ext: str = "png", prefix: str = DEFAULT_PREFIX
) -> DataFrame:
    """Names and sizes only; file contents are pruned from the scan."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*.{ext}")
        .load(root)
        .select("path", "length")
    )
    named = _named(files, F.col("path"), prefix, ext)
    return named.withColumn("name", F.element_at(F.split("path", "/"), -1))


def _readable() -> Column:
    size = F.col("image.height") * F.col("image.width") * F.col("image.nChannels")
    return (F.col("image.nChannels") > 0) & (F.octet_length("image.data") == size) & (size > 0)


def unreadable(images: DataFrame) -> DataFrame:
    """(image_id, reason) of the files that could not be decoded."""
    bad = images.where(~F.coalesce(_readable(), F.lit(False)))
    return bad.select("image_id", F.concat(F.lit("unreadable file "), "kind").alias("reason"))


def decode_channels(images: DataFrame) -> DataFrame:
    """Bytes to row-major planes in 0..1; colour bytes come blue first, grey fills all three.

    Files that hold no picture are left out; ``unreadable`` lists them.
    """
    schema = (
        "image_id int, kind string, height int, width int,"
        " r array<float>, g array<float>, b array<float>"
    )
    flat = images.where(_readable()).select(
        "image_id", "kind", "image.height", "image.width", "image.nChannels", "image.data"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x in batch.itertuples(index=False):
                raw = np.frombuffer(x.data, dtype=np.uint8).reshape(-1, x.nChannels)
                planes = raw.astype(np.float32) / np.float32(255.0)
                b, g, r = (planes[:, min(i, x.nChannels - 1)] for i in range(3))
                if x.nChannels == 1:
                    r = g = b = planes[:, 0]
                rows.append((x.image_id, x.kind, x.height, x.width, r, g, b))
            yield pd.DataFrame(
                rows, columns=["image_id", "kind", "height", "width", "r", "g", "b"]
            )

    return flat.mapInPandas(run, schema)


def load_single(
    spark: SparkSession, root: str, kind: str, ext: str = "png", prefix: str = DEFAULT_PREFIX
) -> DataFrame:
    return decode_channels(scan_images(spark, root, kind, ext, prefix))


def load_pairs(
    spark: SparkSession,
    root: str,
    classes: Sequence[str] = S.CLASSES,
    ext: str = "png",
    prefix: str = DEFAULT_PREFIX,
) -> tuple[DataFrame, DataFrame]:
    """(input planes with one mask plane per class, images refused with a reason)."""
    # the kind decides before any plane is made
    files = scan_images(spark, root, None, ext, prefix)
    wanted = files.where(F.col("kind").isin(INPUT_KIND, *[f"seg_{c}" for c in classes]))
    inputs = decode_channels(files.where(F.col("kind") == INPUT_KIND)).drop("kind")
    masks = decode_channels(files.where(F.col("kind").isin(*[f"seg_{c}" for c in classes])))
    long = masks.select(
        "image_id",
        F.regexp_replace("kind", "^seg_", "").alias("class"),
        "height",
        "width",
        F.col("r").alias("plane"),
    )
    pairs, refused = join_class_masks(inputs, long)
    faulty = unreadable(wanted).dropDuplicates(["image_id"])
    others = refused.join(faulty.select("image_id"), "image_id", "left_anti")
    return pairs, others.unionByName(faulty, allowMissingColumns=True)


def write_dataset(df: DataFrame, path: str, dataset: str, mode: str = "append") -> None:
    """Parquet partitioned by dataset name; sizes are ordinary columns."""
    df.withColumn("dataset", F.lit(dataset)).write.mode(mode).partitionBy("dataset").parquet(path)


def read_dataset(
    spark: SparkSession, path: str, dataset: str, n: int | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(the first n ids, expected ids that are missing); lazily scanned."""
    df = spark.read.parquet(path).where(F.col("dataset") == dataset).drop("dataset")
    if n is None:
        return df, None
    wanted = spark.range(1, n + 1).select(F.col("id").cast("int").alias("image_id"))
    first = df.where(F.col("image_id").between(1, n))
    return first, wanted.join(first.select("image_id"), "image_id", "left_anti")


def read_dense_bin(
    spark: SparkSession,
    glob: str,
    dims: tuple[int, int, int] = (756, 1008, 3),
    dtype: str = "uint8",
    id_pattern: str = r"_(\d{3,})[^/]*$",
) -> DataFrame:
    """Raw column-major arrays to row-major planes; bytes become 0..1."""
    h, w, c = dims
    size = h * w * c * np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").load(glob)
    flat = files.select(
        F.regexp_extract("path", id_pattern, 1).cast("int").alias("image_id"), "length", "content"
    )
    schema = (
        "image_id int, height int, width int, planes array<array<float>>, problem string"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x in batch.itertuples(index=False):
                if x.length != size:
                    rows.append((x.image_id, h, w, None, f"expected {size} bytes"))
                    continue
                cube = np.frombuffer(x.content, dtype=dtype).reshape(dims, order="F")
                cube = cube.astype(np.float32)
                if dtype == "uint8":
                    cube = cube / np.float32(255.0)
                rows.append((x.image_id, h, w, [cube[:, :, k].ravel() for k in range(c)], None))
            yield pd.DataFrame(
                rows, columns=["image_id", "height", "width", "planes", "problem"]
            )

    return flat.mapInPandas(run, schema)


def verify_dataset(
    expected: DataFrame, files: DataFrame, shown: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(one verdict row, the missing ids, the first ``shown`` if that is given).

    ``expected``: (image_id); ``files``: (image_id, length), where a NULL or
    non-positive id is invalid metadata.
    """
    valid = files.where(F.col("image_id") > 0)
    missing = expected.join(valid.select("image_id"), "image_id", "left_anti")
    totals = files.agg(
        F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_bytes"),
        F.count_if(F.col("image_id").isNull() | (F.col("image_id") <= 0)).alias("n_invalid"),
    )
    n_missing = missing.agg(F.count(F.lit(1))).scalar()
    verdict = totals.select(
        n_missing.alias("n_missing"),
        "n_invalid",
        "total_bytes",
        ((n_missing == 0) & (F.col("n_invalid") == 0)).alias("ok"),
    )
    return verdict, missing if shown is None else missing.orderBy("image_id").limit(shown)


def skip_existing(todo: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids still to make, number skipped)."""
    rest = todo.join(done.select("image_id"), "image_id", "left_anti")
    skipped = todo.join(done.select("image_id").distinct(), "image_id", "left_semi")
    return rest, skipped.agg(F.count(F.lit(1)).alias("n_skipped"))


def generate_polygon_dataset(
    spark: SparkSession,
    root: str,
    path: str,
    dataset: str = "polygon",
    ext: str = "png",
    prefix: str = DEFAULT_PREFIX,
    polygon_kind: str = "polygon_mask",
) -> tuple[DataFrame, DataFrame]:
    """Clip every pair to its polygon mask and save it as pixels.

    Returns (foreground % per image, errors). A faulty image becomes an error
    row and does not stop the others.
    """
    pairs, refused = load_pairs(spark, root, S.CLASSES, ext, prefix)
    masks = load_single(spark, root, polygon_kind, ext, prefix).select(
        "image_id", F.col("height").alias("mh"), F.col("width").alias("mw"),
        F.col("r").alias("polygon"),
    )
    joined = pairs.join(masks, "image_id", "left")
    sized = F.coalesce((F.col("mh") == F.col("height")) & (F.col("mw") == F.col("width")),
                       F.lit(False))
    no_mask = joined.where(~sized).select(
        "image_id",
        F.when(F.col("mh").isNull(), F.lit("no polygon mask"))
        .otherwise(F.lit("polygon mask size differs"))
        .alias("reason"),
    )
    planes = [*S.PIXEL_CHANNELS, *S.P_COLUMNS, "polygon"]
    pixels = to_pixels(joined.where(sized).drop("mh", "mw"), planes)
    clipped = clip_to_polygon(pixels, F.col("polygon")).drop("polygon")
    write_dataset(clipped, path, dataset)
    saved, _ = read_dataset(spark, path, dataset)
    fg = sum(F.col(S.p_col(c)) for c in S.FOREGROUND_CLASSES)
    shares = saved.groupBy("image_id").agg(
        (F.sum(fg) / F.count(F.lit(1)) * 100.0).alias("foreground_pct")
    )
    return shares, refused.unionByName(no_mask)
