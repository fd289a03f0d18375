"""Registered queries: supplied tables written as files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixloom import schema as S
from pixloom.operators import trials
from pixloom.plans import proxies as X
from pixloom.plans.registry import query, rnd, rounded
from pixloom.session import scratch_path
from pixloom.sources import dense, images as I, ledger
from pixloom.streaming import telemetry


@query(
    "dense_round_trip",
    f"""WITH {X.PX} SELECT image_id, y AS "row", x AS col,
    {", ".join(f"{rnd(f'round_even({c} * 255, 0) / 255')} AS {c}" for c in 'rgb')} FROM px""",
)
def dense_round_trip(spark, sf):
    """Every picture as a file of bytes, read back by ranges that end within files."""
    path = scratch_path(spark, "dense")
    px = X.pixels(spark, sf)
    dense.write_dense(px, path, S.PIXEL_CHANNELS)
    back = dense.dense_pixels(dense.read_dense(spark, path, split_bytes=5000), S.PIXEL_CHANNELS)
    # bytes are read as 32-bit floats; six digits of the nearest 255th are the same
    exact = {c: F.rint(F.col(c) * 255.0) / 255.0 for c in S.PIXEL_CHANNELS}
    return rounded(back.withColumns(exact))


@query(
    "dataset_round_trip",
    f"""WITH {X.PX}, ids AS (SELECT unnest(range(1, 301))::INT AS image_id),
    sums AS (SELECT image_id::INT AS image_id, 'found' AS status, count(*) AS n, {rnd('sum(r)')} AS r_sum FROM px
      WHERE image_id BETWEEN 1 AND 300 AND image_id % 7 <> 3 GROUP BY image_id)
    SELECT image_id, status, n, r_sum FROM sums UNION ALL
    SELECT image_id, 'missing', 0, NULL FROM ids ANTI JOIN sums USING (image_id)""",
)
def dataset_round_trip(spark, sf):
    """A dataset with gaps: what its first 300 ids hold, and which of them are missing."""
    path = scratch_path(spark, "dataset")
    known = X.images(spark, sf).where(F.col("image_id") % 7 != 3)
    I.write_dataset(known.withColumn("image_id", F.col("image_id").cast("int")), path, "wounds")
    first, missing = I.read_dataset(spark, path, "wounds", 300)
    found = first.select(
        "image_id", F.lit("found").alias("status"), F.size("r").cast("long").alias("n"),
        F.aggregate("r", F.lit(0.0), lambda a, v: a + v).alias("r_sum"),
    )
    lacking = missing.select(
        "image_id", F.lit("missing").alias("status"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("r_sum")
    )
    return rounded(found.unionByName(lacking))


@query(
    "trials_csv",
    f"""SELECT l_orderkey, l_linenumber, {rnd('((l_discount / 2) + 0.5) * (0.001 - 0.00001) + 0.00001')} AS rate,
    {rnd('l_extendedprice')} AS output FROM lineitem""",
)
def trials_csv(spark, sf):
    """All trials as a sorted CSV, parameters in their own range, and read again."""
    path = scratch_path(spark, "trials")
    table = X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_discount").cast("double").alias("rate"), F.col("l_extendedprice").cast("double").alias("output")
    )
    trials.export_trials(table, path, bounds={"rate": (0.00001, 0.001)})
    return rounded(spark.read.schema(table.schema).option("header", True).csv(path))


@query(
    "augmented_round_trip",
    f"""WITH {X.LINEAGE} SELECT target_class, count(*) AS n, {rnd('sum(scale_factor * 2)')} AS total,
    (SELECT count(*) FROM lineage) AS n_samples, (SELECT count(*) FROM supplier WHERE s_suppkey < 4) AS n_excluded
    FROM lineage GROUP BY target_class""",
)
def augmented_round_trip(spark, sf):
    """An augmented set written with a hook on its samples: counts from the summary, sums from the samples."""
    path = scratch_path(spark, "augmented")
    lineage = X.lineage(spark, sf).withColumn("sample_id", F.concat_ws("-", "target_class", "augmented_index"))
    samples = lineage.select("sample_id", "target_class", F.lit(1).alias("row"), F.lit(1).alias("col"), F.col("scale_factor").alias("v"))
    excluded = X.table(spark, sf, "supplier").where("s_suppkey < 4").select(F.col("s_suppkey").alias("source_index"))
    ledger.write_augmented(samples, lineage, path, lambda df: df.withColumn("v", F.col("v") * 2), excluded)
    known, summary = ledger.read_augmented_metadata(spark, path)
    counts = summary.select("n_samples", "n_excluded", F.explode("distribution").alias("target_class", "n"))
    sums = spark.read.parquet(f"{path}/samples").join(known, "sample_id", "left_semi")
    totals = sums.groupBy("target_class").agg(F.sum("v").alias("total"))
    return rounded(counts.join(totals, "target_class").select("target_class", "n", "total", "n_samples", "n_excluded"))


@query("ingested_files", f"SELECT vec_id AS image_id, {X.CELLS * 3}::BIGINT AS length FROM embeddings")
def ingested_files(spark, sf):
    """Picture files that arrive in two lots; the second run of the stream takes only the new ones."""
    path = scratch_path(spark, "ingest")
    px = X.pixels(spark, sf)
    for lot in range(2):
        dense.write_dense(px.where(F.col("image_id") % 2 == lot), f"{path}/in", S.PIXEL_CHANNELS)
        files = telemetry.ingest_stream(spark, f"{path}/in", "bin", 2000).select("path", "length")
        seen = telemetry.run_to_table(files, f"{path}/out", f"{path}/state")
    return seen.select(F.regexp_extract("path", r"image_(\d+)\.bin$", 1).cast("long").alias("image_id"), "length")
