"""Polygon annotations: rasterising, edits, mask file bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixloom.functions.geometry import point_in_polygon, polygon_bounds, scale_vertices
from pixloom.functions.scalars import pad3

BAND = 32
FILE_PREFIX = "image"


def pixels_in_polygons(pixels: DataFrame, polygons: DataFrame, band: int = BAND) -> DataFrame:
    """Pixels inside each polygon of their image, polygon columns attached.

    The bounding box is cut into bands of rows, so the join is an equi-join on
    (image, band) that spreads a large image over many tasks; the box and the
    exact test follow as filters.
    """
    x0, x1, y0, y1 = polygon_bounds(F.col("vertices"))
    boxed = polygons.where(F.size("vertices") >= 3).withColumns(
        {
            "__c0": F.floor(x0).cast("int"),
            "__c1": F.ceil(x1).cast("int"),
            "__r0": F.greatest(F.floor(y0), F.lit(1)).cast("int"),
            "__r1": F.ceil(y1).cast("int"),
        }
    )
    bands = boxed.where(F.col("__r1") >= F.col("__r0")).withColumn(
        "__band",
        F.explode(
            F.sequence(
                F.floor(F.col("__r0") / band).cast("int"), F.floor(F.col("__r1") / band).cast("int")
            )
        ),
    )
    banded = pixels.withColumn("__band", F.floor(F.col("row") / band).cast("int"))
    joined = banded.join(bands, ["image_id", "__band"]).where(
        F.col("row").between(F.col("__r0"), F.col("__r1"))
        & F.col("col").between(F.col("__c0"), F.col("__c1"))
    )
    inside = point_in_polygon(
        F.col("col").cast("double"), F.col("row").cast("double"), F.col("vertices")
    )
    return joined.where(inside).drop("__band", "__c0", "__c1", "__r0", "__r1", "vertices")


def rasterise_all(polygons: DataFrame, pixels: DataFrame, scale: Column | float = 1.0):
    """(mask pixels, outcome per image).

    Incomplete polygons and those with fewer than three vertices are skipped;
    polygons covering no pixel are failed; the rest are saved.
    """
    usable = F.coalesce(F.col("complete"), F.lit(False)) & (F.size("vertices") >= 3)
    scaled = polygons.where(usable).withColumn(
        "vertices", scale_vertices(F.col("vertices"), scale, scale)
    )
    hits = pixels_in_polygons(pixels.select("image_id", "row", "col"), scaled)
    masks = hits.select("image_id", "polygon_id", "class", "list_pos", "row", "col")
    covered = masks.groupBy("image_id", "polygon_id").agg(F.count(F.lit(1)).alias("area"))
    status = (
        polygons.withColumn("usable", usable)
        .select("image_id", "polygon_id", "usable")
        .join(covered, ["image_id", "polygon_id"], "left")
    )
    outcome = status.groupBy("image_id").agg(
        F.count_if(F.col("usable") & F.col("area").isNotNull()).alias("saved"),
        F.count_if(~F.col("usable")).alias("skipped"),
        F.count_if(F.col("usable") & F.col("area").isNull()).alias("failed"),
        F.coalesce(F.sum("area"), F.lit(0)).alias("mask_pixels"),
    )
    return masks, outcome.withColumn("ok", F.col("failed") == 0)


def cached_colour(polygons: DataFrame) -> DataFrame:
    """Per image and class: colours of the last complete polygon that has them."""
    usable = polygons.where(F.col("complete") & F.col("lch_data").isNotNull())
    return usable.groupBy("image_id", "class").agg(F.max_by("lch_data", "list_pos").alias("lch"))


def folder_name(image_index: Column, prefix: str = FILE_PREFIX) -> Column:
    return F.concat(F.lit(prefix + "_"), pad3(image_index))


def mask_filename(
    image_index: Column, class_name: Column, polygon_id: Column, prefix: str = FILE_PREFIX
) -> Column:
    return F.concat(
        folder_name(image_index, prefix),
        F.lit("_polygon_"),
        class_name,
        F.lit("_"),
        polygon_id.cast("string"),
        F.lit(".png"),
    )


def parse_mask_filename(name: Column, prefix: str = FILE_PREFIX) -> Column:
    """Struct (image_index, class_name, polygon_id); NULL when the name does not match.

    The class name may itself contain underscores.
    """
    pattern = rf"^{prefix}_(\d{{3,}})_polygon_(.+)_(\d+)\.png$"
    parsed = F.struct(
        F.regexp_extract(name, pattern, 1).cast("int").alias("image_index"),
        F.regexp_extract(name, pattern, 2).alias("class_name"),
        F.regexp_extract(name, pattern, 3).cast("int").alias("polygon_id"),
    )
    return F.when(name.rlike(pattern), parsed)


def folder_of(name: Column, prefix: str = FILE_PREFIX) -> Column:
    """Folder of a file name; NULL when the digits are missing."""
    found = F.regexp_extract(name, rf"({prefix}_\d{{3,}})", 1)
    return F.when(found != "", found)


def mask_format(polygons: DataFrame, files: DataFrame, images: DataFrame) -> DataFrame:
    """Per image: separate_files (by record, then by file name) > single_file > none."""
    recorded = polygons.groupBy("image_id").agg(
        F.bool_or(F.col("mask_file").isNotNull()).alias("recorded")
    )
    named = files.groupBy("image_id").agg(
        F.bool_or(F.col("name").rlike(r"_polygon_.+_\d+\.png$")).alias("separate"),
        F.bool_or(F.col("name").rlike(r"_polygon_mask\.png$")).alias("single"),
    )
    joined = images.select("image_id").join(recorded, "image_id", "left").join(
        named, "image_id", "left"
    )
    off = F.lit(False)
    return joined.select(
        "image_id",
        F.when(
            F.coalesce("recorded", off) | F.coalesce("separate", off), F.lit("separate_files")
        )
        .when(F.coalesce("single", off), F.lit("single_file"))
        .otherwise(F.lit("none"))
        .alias("mask_format"),
    )


def resolve_mask_source(images: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """First available mask per image, in the given order, with its source kept.

    Each source is (name, table of image_id, path).
    """
    out = images.select("image_id")
    picks = []
    for name, table in sources:
        column = f"__{name}"
        out = out.join(table.select("image_id", F.col("path").alias(column)), "image_id", "left")
        picks.append((name, column))
    path = F.coalesce(*[F.col(c) for _, c in picks])
    source = F.lit(None).cast("string")
    for name, column in reversed(picks):
        source = F.when(F.col(column).isNotNull(), F.lit(name)).otherwise(source)
    return out.select("image_id", path.alias("path"), source.alias("source"))


def rename_plan(polygons: DataFrame, files: DataFrame, prefix: str = FILE_PREFIX) -> DataFrame:
    """Recorded name to expected name, with status unchanged / renamed / missing."""
    expected = mask_filename(F.col("image_id"), F.col("class_name"), F.col("polygon_id"), prefix)
    plan = polygons.select(
        "image_id",
        "polygon_id",
        F.coalesce("mask_file", expected).alias("old_name"),
        expected.alias("new_name"),
    )
    present = files.select(F.col("name").alias("old_name"), F.lit(True).alias("present"))
    joined = plan.join(present.distinct(), "old_name", "left")
    return joined.select(
        "image_id",
        "polygon_id",
        "old_name",
        "new_name",
        F.when(F.col("old_name") == F.col("new_name"), F.lit("unchanged"))
        .when(F.col("present").isNull(), F.lit("missing"))
        .otherwise(F.lit("renamed"))
        .alias("status"),
    )


def attach_mask_files(polygons: DataFrame, files: DataFrame, prefix: str = FILE_PREFIX):
    """(polygons with an existing mask file, polygons whose file is missing)."""
    derived = mask_filename(F.col("image_id"), F.col("class_name"), F.col("polygon_id"), prefix)
    keyed = polygons.withColumn("name", F.coalesce("mask_file", derived))
    known = files.select("name", "path").dropDuplicates(["name"])
    return keyed.join(known, "name"), keyed.join(known, "name", "left_anti")


def _judged_edits(ids: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits that hold, rejected ones with ``reason``)."""
    image = ["image_id"]
    edits = changes.where(F.col("action") != "add").select(
        *image,
        "seq",
        "action",
        "id",
        "new_id",
        F.col("class").alias("__class"),
        F.col("vertices").alias("__vertices"),
    )
    wanted = edits.join(ids.withColumn("__exists", F.lit(True)), [*image, "id"], "left")
    clash = ids.select(*image, F.col("id").alias("new_id"), F.lit(True).alias("__clash"))
    wanted = wanted.join(clash, [*image, "new_id"], "left")
    renumber = F.col("action") == "renumber"
    reason = (
        F.when(renumber & (F.coalesce(F.col("new_id"), F.lit(0)) <= 0), F.lit("id not positive"))
        .when(
            renumber & F.col("__clash").isNotNull() & (F.col("new_id") != F.col("id")),
            F.lit("id in use"),
        )
        .when(F.col("__exists").isNull(), F.lit("polygon not found"))
    )
    judged = wanted.withColumn("reason", reason)
    # edits that meet: the first valid one of a polygon, then the first to ask for an id
    valid = F.col("reason").isNull().cast("int")
    nth = F.row_number().over(W.partitionBy("image_id", "id", valid).orderBy("seq"))
    judged = judged.withColumn("__nth", nth).withColumn(
        "reason", F.coalesce("reason", F.when(F.col("__nth") > 1, F.lit("polygon already edited")))
    )
    asks = F.when(F.col("reason").isNull() & renumber, F.col("new_id"))
    judged = judged.withColumn("__asks", asks)
    nth = F.row_number().over(W.partitionBy("image_id", "__asks").orderBy("seq"))
    judged = judged.withColumn("__nth", nth).withColumn(
        "reason",
        F.coalesce("reason", F.when(F.col("__asks").isNotNull() & (F.col("__nth") > 1), F.lit("id in use"))),
    )
    rejects = judged.where("reason IS NOT NULL").select(*image, "seq", "action", "id", "reason")
    good = judged.where("reason IS NULL").select(
        *image, "id", "action", F.when(renumber, F.col("new_id")).alias("new_id"), "__class", "__vertices"
    )
    return good, rejects


def edit_polygons(polygons: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply one batch of edits; returns (polygons, rejected changes with ``reason``).

    ``changes``: (image_id, seq, action, id, new_id, class, vertices) with action
    add / remove / replace / recolour / renumber. Edits of one batch refer to the
    ids before the batch. Of several edits of one polygon, and of several renumbers
    to one id, the first by ``seq`` holds and the others are rejected. Adds keep a
    requested id that is free before and after the edits; the others continue after
    the largest id of the image, renumbered ones included.
    """
    image = ["image_id"]
    ids = polygons.select(*image, "id")
    good, rejects = _judged_edits(ids, changes)
    after = ids.unionByName(good.where("new_id IS NOT NULL").select(*image, F.col("new_id").alias("id")))
    after = after.distinct()
    top = after.groupBy(*image).agg(F.max("id").alias("__top"))

    adds = changes.where(F.col("action") == "add")
    taken = after.select(*image, "id", F.lit(True).alias("__taken"))
    adds = adds.join(taken, [*image, "id"], "left")
    first_ask = F.row_number().over(W.partitionBy("image_id", "id").orderBy("seq")) == 1
    adds = adds.withColumn(
        "__keep", F.col("id").isNotNull() & F.col("__taken").isNull() & first_ask
    )
    kept_top = adds.groupBy(*image).agg(
        F.max(F.when(F.col("__keep"), F.col("id"))).alias("__ktop")
    )
    adds = adds.join(top, image, "left").join(kept_top, image, "left")
    order = F.row_number().over(W.partitionBy("image_id", "__keep").orderBy("seq"))
    base = F.greatest(
        F.coalesce("__top", F.lit(0)), F.coalesce("__ktop", F.lit(0))
    )
    added = adds.select(
        *image,
        F.when(F.col("__keep"), F.col("id")).otherwise((base + order).cast("int")).alias("id"),
        "class",
        "vertices",
    )

    current = polygons.join(good, [*image, "id"], "left")
    act = F.coalesce("action", F.lit("keep"))
    edited = current.where(act != "remove").select(
        *image,
        F.when(act == "renumber", F.col("new_id")).otherwise(F.col("id")).alias("id"),
        F.when(act == "replace", F.coalesce("__class", "class"))
        .otherwise(F.col("class"))
        .alias("class"),
        F.when(act == "replace", F.coalesce("__vertices", "vertices"))
        .otherwise(F.col("vertices"))
        .alias("vertices"),
        F.when(act.isin("replace", "recolour"), F.lit(None)).otherwise(F.col("lch_data")).alias(
            "lch_data"
        ),
    )
    missing = added.withColumn("lch_data", F.lit(None).cast(polygons.schema["lch_data"].dataType))
    return edited.unionByName(missing), rejects
