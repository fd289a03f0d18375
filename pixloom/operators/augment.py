"""Class-balanced augmentation as table jobs with full lineage.

Every random choice is a hash of (seed, name, ids): the same sample is drawn
under any partitioning and after any task retry.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixloom import schema as S
from pixloom.functions.scalars import clamp, draw_index, uniform
from pixloom.operators import resample
from pixloom.operators.pixels import to_pixels
from pixloom.operators.scale import blocked_cumsum, blocked_rank, uniform_rank
from pixloom.session import cut_lineage, written

# Default target distribution, foreground limits, elastic constants, cycle.
DEFAULT_DISTRIBUTION = {
    "scar": 15.0,
    "redness": 15.0,
    "hematoma": 30.0,
    "necrosis": 5.0,
    "background": 35.0,
}
FG_THRESHOLDS = {
    "scar": 50.0,
    "redness": 50.0,
    "hematoma": 50.0,
    "necrosis": 50.0,
    "background": 100.0,
}
OTHER_FG_THRESHOLD = 50.0
MAX_MULTIPLIER = 4
ELASTIC = {
    "elastic_grid_h": 8,
    "elastic_grid_w": 8,
    "elastic_scale": 0.2,
    "elastic_sigma": 2.0,
    "elastic_iterations": 1,
}
CLASS_CYCLE = {"scar": 6, "redness": 5, "hematoma": 1, "necrosis": 3}
PLANES = (*S.PIXEL_CHANNELS, *S.P_COLUMNS)
CANDIDATES = 20
SOURCE_BUCKETS = 4096
ATTEMPT_BLOCK = 4096

LINEAGE_COLUMNS = (
    "augmented_index source_index timestamp random_seed target_class"
    " smart_crop_x_start smart_crop_y_start smart_crop_width smart_crop_height"
    " scale_factor shear_x_angle shear_y_angle rotation_angle flip_type"
    " final_crop_y_start final_crop_x_start final_crop_height final_crop_width"
    " elastic_grid_h elastic_grid_w elastic_scale elastic_sigma elastic_iterations"
    " brightness_factor saturation_offset blur_kernel_size blur_sigma"
    " scar_percentage redness_percentage hematoma_percentage necrosis_percentage"
    " background_percentage size_multiplier patch_height patch_width fg_threshold_used"
    " actual_fg_percentage growth_iterations max_size_reached intermediate_height"
    " intermediate_width"
).split()


def class_value(table: Mapping[str, float], class_column: Column, default: float) -> Column:
    value = F.lit(float(default))
    for name, v in table.items():
        value = F.when(class_column == name, F.lit(float(v))).otherwise(value)
    return value


def quota(totals: DataFrame, distribution: Mapping[str, float] | None = None) -> DataFrame:
    """Samples per class for each row's ``total``, largest first.

    Halves round to even; what rounding leaves goes to background.
    """
    distribution = dict(DEFAULT_DISTRIBUTION if distribution is None else distribution)
    if abs(sum(distribution.values()) - 100.0) >= 0.01:
        raise ValueError("distribution must sum to 100")
    counts = {
        c: F.rint(F.col("total") * pct / 100.0).cast("long") for c, pct in distribution.items()
    }
    used = sum(counts.values())
    rows = [
        F.struct(
            F.lit(c).alias("class"),
            (n + F.when(F.lit(c == "background"), F.col("total") - used).otherwise(0)).alias(
                "count"
            ),
        )
        for c, n in counts.items()
    ]
    kept = [c for c in totals.columns]
    out = totals.select(*kept, F.explode(F.array(*rows)).alias("e")).select(*kept, "e.*")
    return out.orderBy(F.col("count").desc(), "class")


def draw_parameters(
    df: DataFrame,
    seed: int,
    ids: Sequence[str],
    intermediate: tuple[int, int],
    target: tuple[int, int],
) -> DataFrame:
    """Add the parameters of each sample, drawn from their grids."""
    key = [F.col(c) for c in ids]

    def step(name: str, first: float, by: float, count: int) -> Column:
        return F.round(draw_index(seed, name, count, *key) * by + first, 4)

    flips = F.array(F.lit("flipx"), F.lit("flipy"), F.lit("noop"))
    drawn = {
        "random_seed": (uniform(seed, "seed", *key) * float(1 << 52)).cast("long"),
        "scale_factor": step("scale", 0.9, 0.01, 21),
        "shear_x_angle": step("shear_x", -10.0, 0.1, 201),
        "shear_y_angle": step("shear_y", -10.0, 0.1, 201),
        "rotation_angle": step("rotation", 1.0, 0.1, 3591),
        "flip_type": flips[draw_index(seed, "flip", 3, *key).cast("int")],
        "final_crop_y_start": (
            draw_index(seed, "crop_y", max(1, intermediate[0] - target[0] + 1), *key) + 1
        ).cast("int"),
        "final_crop_x_start": (
            draw_index(seed, "crop_x", max(1, intermediate[1] - target[1] + 1), *key) + 1
        ).cast("int"),
        "final_crop_height": F.lit(target[0]),
        "final_crop_width": F.lit(target[1]),
        **{name: F.lit(v) for name, v in ELASTIC.items()},
        "brightness_factor": step("brightness", 0.8, 0.1, 5),
        "saturation_offset": step("saturation", -0.2, 0.1, 5),
        "blur_kernel_size": (draw_index(seed, "kernel", 3, *key) * 2 + 3).cast("int"),
        "blur_sigma": step("sigma", 1.0, 0.1, 21),
    }
    return df.withColumns(drawn)


def source_intervals(
    profile: DataFrame, classes: Sequence[str] = S.CLASSES, excluded: DataFrame | None = None
) -> DataFrame:
    """Per class the share (lo, hi] of every source; weight is its class % + 0.01."""
    usable = profile
    if excluded is not None:
        usable = profile.join(excluded.select("source_index"), "source_index", "left_anti")
    weights = usable.select(
        "source_index",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("target_class"),
                        (F.col(f"{c}_percentage") + 0.01).alias("weight"),
                    )
                    for c in classes
                ]
            )
        ).alias("e"),
    ).select("source_index", "e.target_class", "e.weight")
    running = blocked_cumsum(weights, F.col("weight"), "source_index", ["target_class"])
    total = weights.groupBy("target_class").agg(F.sum("weight").alias("total"))
    return running.join(total, "target_class").select(
        "source_index",
        "target_class",
        ((F.col("cum") - F.col("weight")) / F.col("total")).alias("lo"),
        (F.col("cum") / F.col("total")).alias("hi"),
    )


def pick_source(draws: DataFrame, intervals: DataFrame, u: str = "u") -> DataFrame:
    """Add the first source whose cumulative share reaches ``u``.

    Shares and draws meet in equal buckets of [0, 1], an equi-join; a hair of
    slack covers the rounding of neighbouring shares.
    """
    slack = 1e-12

    def bucket(x: Column) -> Column:
        return F.floor(clamp(x, 0.0, 1.0 - slack) * SOURCE_BUCKETS).cast("int")

    spread = intervals.withColumn(
        "__b", F.explode(F.sequence(bucket(F.col("lo") - slack), bucket(F.col("hi") + slack)))
    )
    placed = draws.withColumn("__u", clamp(F.col(u), slack, 1.0 - slack)).withColumn(
        "__b", bucket(F.col("__u"))
    )
    rest = [c for c in draws.columns]
    joined = placed.join(spread, ["target_class", "__b"]).where(
        (F.col("lo") - slack < F.col("__u")) & (F.col("__u") <= F.col("hi") + slack)
    )
    return joined.groupBy(*rest).agg(
        F.min_by("source_index", F.struct("hi", "source_index")).alias("source_index")
    )


def class_pixels(pixels: DataFrame, class_name: str, threshold: float = 0.5) -> DataFrame:
    return pixels.where(F.col(S.p_col(class_name)) > threshold).select("image_id", "row", "col")


def class_integral(pixels: DataFrame) -> DataFrame:
    """Summed-area table of every class plane."""
    by_col = W.partitionBy("image_id", "row").orderBy("col").rowsBetween(W.unboundedPreceding, 0)
    by_row = W.partitionBy("image_id", "col").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    across = pixels.select(
        "image_id", "row", "col", *[F.sum(p).over(by_col).alias(p) for p in S.P_COLUMNS]
    )
    return across.select(
        "image_id", "row", "col", *[F.sum(p).over(by_row).alias(p) for p in S.P_COLUMNS]
    )


def _p_of(class_column: Column) -> Column:
    value = F.lit(None).cast("double")
    for c in S.CLASSES:
        value = F.when(class_column == c, F.col(S.p_col(c))).otherwise(value)
    return value


@dataclass(frozen=True)
class CropIndex:
    """What choosing windows needs of the pixels: image sizes, numbered class pixels and summed areas."""

    dims: DataFrame
    members: DataFrame
    sizes: DataFrame
    sums: DataFrame

    def kept(self) -> CropIndex:
        """Written once to the shared folder, ordered by source, so that later look-ups never see the pixels."""

        def keep(df: DataFrame, name: str) -> DataFrame:
            return written(df.repartition("source_index").sortWithinPartitions("source_index"), name)[0]

        return CropIndex(*(keep(getattr(self, n), n) for n in ("dims", "members", "sizes", "sums")))


def crop_index(pixels: DataFrame) -> CropIndex:
    dims = pixels.groupBy(F.col("image_id").alias("source_index")).agg(
        F.max("row").alias("h"), F.max("col").alias("w")
    )
    members = pixels.select(
        F.col("image_id").alias("source_index"),
        "row",
        "col",
        F.explode(
            F.filter(
                F.array(
                    *[F.when(F.col(S.p_col(c)) > 0.5, F.lit(c)) for c in S.FOREGROUND_CLASSES]
                ),
                lambda c: c.isNotNull(),
            )
        ).alias("target_class"),
    )
    numbered = blocked_rank(
        members, ["source_index", "target_class"], [("b", F.col("row"))], ["row", "col"], "place"
    )
    sizes = members.groupBy("source_index", "target_class").agg(F.count(F.lit(1)).alias("n"))
    sums = class_integral(pixels).withColumnRenamed("image_id", "source_index")
    return CropIndex(dims, numbered, sizes, sums)


def smart_crop(
    pixels: DataFrame | CropIndex,
    samples: DataFrame,
    size: tuple[int, int],
    seed: int,
    candidates: int = CANDIDATES,
) -> DataFrame:
    """Add the crop window (crop_x, crop_y, crop_w, crop_h) of each sample.

    ``samples``: (sample_id, source_index, target_class, ...). Up to 20 pixels of
    the class are drawn by number, windows are centred on them and clamped, and
    the richest one wins, the earlier on ties. Background and absent classes
    get a random window; an image smaller than the window is used whole. Who
    crops more than once hands over a kept ``crop_index`` instead of pixels.
    """
    index = pixels if isinstance(pixels, CropIndex) else crop_index(pixels)
    ch, cw = size
    base = samples.join(index.dims, "source_index")
    fits = (F.col("h") >= ch) & (F.col("w") >= cw)
    wanted = base.where(fits & (F.col("target_class") != "background"))
    chosen = (
        wanted.select("sample_id", "source_index", "target_class", "h", "w")
        .join(index.sizes, ["source_index", "target_class"])
        .withColumn(
            "k",
            F.explode(F.sequence(F.lit(1), F.least(F.lit(candidates), F.col("n")).cast("int"))),
        )
        .withColumn(
            "place", draw_index(seed, "centre", F.col("n"), F.col("sample_id"), F.col("k")) + 1
        )
        .join(index.members, ["source_index", "target_class", "place"])
    )
    windows = chosen.select(
        "sample_id",
        "source_index",
        "target_class",
        "k",
        clamp(F.col("col") - cw // 2, 1, F.col("w") - cw + 1).alias("x"),
        clamp(F.col("row") - ch // 2, 1, F.col("h") - ch + 1).alias("y"),
    )
    corners = F.array(
        *[
            F.struct(
                (F.col("y") + dy).alias("row"), (F.col("x") + dx).alias("col"), F.lit(s).alias("s")
            )
            for dy, dx, s in (
                (ch - 1, cw - 1, 1.0),
                (-1, cw - 1, -1.0),
                (ch - 1, -1, -1.0),
                (-1, -1, 1.0),
            )
        ]
    )
    lookups = windows.withColumn("e", F.explode(corners)).select(
        "sample_id", "source_index", "target_class", "k", "x", "y", "e.row", "e.col", "e.s"
    )
    sums = (
        lookups.join(index.sums, ["source_index", "row", "col"])
        .groupBy("sample_id", "k", "x", "y")
        .agg(F.sum(F.col("s") * _p_of(F.col("target_class"))).alias("mass"))
    )
    share = F.round(F.col("mass") / (ch * cw) * 100.0, 9)
    best = sums.groupBy("sample_id").agg(
        F.max_by(F.struct("x", "y", share.alias("pct")), F.struct(share, -F.col("k"))).alias("b")
    )
    out = base.join(best, "sample_id", "left")
    random_x = draw_index(seed, "window_x", F.greatest(F.col("w") - cw + 1, F.lit(1)),
                          F.col("sample_id")) + 1
    random_y = draw_index(seed, "window_y", F.greatest(F.col("h") - ch + 1, F.lit(1)),
                          F.col("sample_id")) + 1

    def pick(whole, best_value, random_value):
        return F.when(~fits, whole).otherwise(F.coalesce(best_value, random_value)).cast("int")

    return out.select(
        *samples.columns,
        pick(F.lit(1), F.col("b.x"), random_x).alias("crop_x"),
        pick(F.lit(1), F.col("b.y"), random_y).alias("crop_y"),
        F.when(fits, F.lit(cw)).otherwise(F.col("w")).cast("int").alias("crop_w"),
        F.when(fits, F.lit(ch)).otherwise(F.col("h")).cast("int").alias("crop_h"),
    )


def intermediate_size(base: tuple[int, int], max_multiplier: int) -> tuple[int, int]:
    """Room for a turned patch of the largest size: twice as long, a fifth to spare."""
    return tuple(int(round(b * max_multiplier * 2 * 1.2)) for b in base)


def intermediate_size_column(base: Column, max_multiplier: Column) -> Column:
    return F.rint(base * max_multiplier * 2 * 1.2).cast("int")


def grow_patch(
    pixels: DataFrame,
    base: tuple[int, int],
    max_multiplier: int = MAX_MULTIPLIER,
    thresholds: Mapping[str, float] | None = None,
    keys: Sequence[str] = ("sample_id", "target_class"),
) -> DataFrame:
    """Smallest centred patch whose foreground share is within the class limit.

    All sizes are summed in one pass. Without a passing size the largest that
    fits is kept; an image too small for the first size gets ``status`` too_small.
    """
    thresholds = FG_THRESHOLDS if thresholds is None else thresholds
    bh, bw = base
    tried = F.array(*[F.lit(m) for m in range(1, max_multiplier + 1)])
    top = lambda size, patch: F.floor((size - patch) / 2)
    h, w, m = F.col("height"), F.col("width"), F.col("m")
    inside = (
        (bh * m <= h)
        & (bw * m <= w)
        & F.col("row").between(top(h, bh * m) + 1, top(h, bh * m) + bh * m)
        & F.col("col").between(top(w, bw * m) + 1, top(w, bw * m) + bw * m)
    )
    fg = sum(F.col(S.p_col(c)) for c in S.FOREGROUND_CLASSES)
    n = F.nullif(F.count_if(inside), F.lit(0))
    share = lambda v: F.sum(F.when(inside, v)) / n * 100.0
    # Pixels outside are summed as nothing, not filtered: a sample that no size fits keeps its row.
    sizes = (
        pixels.withColumn("m", F.explode(tried))
        .groupBy(*keys, "m")
        .agg(
            n.alias("__n"),
            share(fg).alias("fg"),
            *[share(F.col(S.p_col(c))).alias(f"{c}_percentage") for c in S.CLASSES],
        )
    )
    limit = class_value(thresholds, F.col("target_class"), OTHER_FG_THRESHOLD)
    fits, passing = F.col("__n") > 0, F.col("fg") <= limit
    shape = F.struct("m", "fg", *[f"{c}_percentage" for c in S.CLASSES])
    picked = sizes.groupBy(*keys).agg(
        F.min_by(shape, F.when(fits & passing, F.col("m"))).alias("first"),
        F.max_by(shape, F.when(fits, F.col("m"))).alias("largest"),
    )
    out = picked.withColumn("c", F.coalesce("first", "largest"))
    multiplier = F.coalesce(F.col("c.m"), F.lit(1))
    ran_out = F.col("first").isNull() & (multiplier < max_multiplier)
    return out.select(
        *keys,
        F.when(F.col("c").isNull(), F.lit("too_small")).otherwise(F.lit("ok")).alias("status"),
        multiplier.alias("size_multiplier"),
        (multiplier * bh).alias("patch_height"),
        (multiplier * bw).alias("patch_width"),
        limit.alias("fg_threshold_used"),
        F.col("c.fg").alias("actual_fg_percentage"),
        F.when(F.col("c").isNull(), F.lit(1))
        .otherwise(multiplier + F.when(ran_out, 1).otherwise(0))
        .alias("growth_iterations"),
        F.coalesce((multiplier >= max_multiplier) & (F.col("c.fg") > limit), F.lit(False)).alias(
            "max_size_reached"
        ),
        *[F.col(f"c.{c}_percentage").alias(f"{c}_percentage") for c in S.CLASSES],
    )


def quality_gate(samples: DataFrame, profile: DataFrame) -> DataFrame:
    """Keep background; others need at least max(0.5, 0.3 x the source's share) of their class."""
    source = profile.select(
        "source_index", *[F.col(f"{c}_percentage").alias(f"__src_{c}") for c in S.CLASSES]
    )
    joined = samples.join(source, "source_index")
    own = F.lit(None).cast("double")
    src = F.lit(None).cast("double")
    for c in S.CLASSES:
        is_c = F.col("target_class") == c
        own = F.when(is_c, F.col(f"{c}_percentage")).otherwise(own)
        src = F.when(is_c, F.col(f"__src_{c}")).otherwise(src)
    ok = (F.col("target_class") == "background") | (
        own >= F.greatest(F.lit(0.5), src * 0.3)
    )
    return joined.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop(
        *[f"__src_{c}" for c in S.CLASSES]
    )


def _candidates(spark: SparkSession, plan: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Attempt rows (sample_id, target_class, attempt) for class -> (first, count)."""
    parts = None
    for name, (first, count) in plan.items():
        part = spark.range(first, first + count).select(
            F.concat(F.lit(name + "-"), F.col("id").cast("string")).alias("sample_id"),
            F.lit(name).alias("target_class"),
            F.col("id").alias("attempt"),
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def sample_pixels(
    lineage: DataFrame, images: DataFrame, post: bool, binary: int = len(S.CLASSES), planes: Sequence[str] = PLANES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Pixels of the intermediate sample of each lineage row: crop, geometry, post effects.

    Geometry and effects run in one Arrow pass over the joined rows. Who judges masks only asks for their
    ``planes``; the last ``binary`` are masks. Columns of the lineage to ``keep`` follow every pixel.
    """
    planes, ids = list(planes), ["sample_id", "target_class", *keep]
    drawn = [c for c in lineage.columns if c not in planes]
    source = images.select(F.col("image_id").alias("source_index"), "height", "width", *planes)
    joined = lineage.join(source, "source_index")
    cropped = resample.crop(joined, planes, drawn)
    steps = resample.GEOMETRY + (resample.POST if post else ())
    made = resample.apply_steps(cropped, planes, steps, binary, ids)
    pixels = to_pixels(made.select(F.struct(*ids).alias("image_id"), "height", "width", *planes), planes)
    return pixels.select(*[F.col(f"image_id.{c}").alias(c) for c in ids], "row", "col", "height", "width", *planes)


def balanced_dataset(
    images: DataFrame,
    pixels: DataFrame,
    profile: DataFrame,
    counts: Mapping[str, int],
    seed: int,
    base: tuple[int, int],
    max_multiplier: int = MAX_MULTIPLIER,
    thresholds: Mapping[str, float] | None = None,
    excluded: DataFrame | None = None,
    oversample: float = 2.0,
    attempt_factor: int = 100,
    created_at=None,
    allow_short: bool = False,
) -> tuple[DataFrame, list[dict]]:
    """(lineage of the accepted samples in shuffled order, log of the rounds).

    Candidates are made in rounds, as many as the acceptance seen so far suggests;
    the gate keeps the good ones and the lowest attempt numbers fill the quota.
    The result does not depend on partitioning. A class stops when its quota is
    full or after ``attempt_factor`` times its quota; a quota not filled by then
    is an error unless ``allow_short``. Only per-class counts come to the driver.
    """
    spark = images.sparkSession
    window = intermediate_size(base, max_multiplier)
    intervals = cut_lineage(source_intervals(profile, S.CLASSES, excluded))
    if intervals.isEmpty():
        raise ValueError("every source is excluded")
    index = crop_index(pixels).kept()
    lacking = {c: int(n) for c, n in counts.items() if n > 0}
    used, passed = dict.fromkeys(lacking, 0), dict.fromkeys(lacking, 0)
    stages, log = [], []
    while lacking:
        plan = {}
        for c, n in lacking.items():
            room = attempt_factor * int(counts[c]) - used[c]
            rate = passed[c] / used[c] if used[c] else 1.0
            wanted = n * oversample / max(rate, 1.0 / attempt_factor)
            plan[c] = (used[c], min(room, max(8, int(wanted))))
        attempts = _candidates(spark, plan).withColumn(
            "u", uniform(seed, "source", F.col("sample_id"))
        )
        picked = pick_source(attempts, intervals).drop("u")
        drawn = draw_parameters(picked, seed, ["sample_id"], window, base)
        framed = cut_lineage(smart_crop(index, drawn, window, seed))
        grown = grow_patch(
            sample_pixels(framed, images, post=False, planes=S.P_COLUMNS), base, max_multiplier, thresholds
        )
        judged = cut_lineage(
            quality_gate(framed.join(grown, ["sample_id", "target_class"]), profile)
        )
        good = judged.where(F.col("accepted") & (F.col("status") == "ok"))
        ranked = blocked_rank(
            good,
            ["target_class"],
            [("b", F.floor(F.col("attempt") / ATTEMPT_BLOCK))],
            ["attempt"],
            "place",
        )
        rates = good.groupBy("target_class").agg(F.count(F.lit(1)).alias("n")).collect()
        for r in rates:
            passed[r["target_class"]] += r["n"]
        need = class_value(lacking, F.col("target_class"), 0.0)
        stage = cut_lineage(ranked.where(F.col("place") <= need).drop("place"))
        found = {
            r["target_class"]: r["count"] for r in stage.groupBy("target_class").count().collect()
        }
        stages.append(stage)
        still = {}
        for c, n in lacking.items():
            used[c] += plan[c][1]
            got = found.get(c, 0)
            log.append({"class": c, "attempts": plan[c][1], "accepted": got, "needed": n})
            if n > got and used[c] < attempt_factor * int(counts[c]):
                still[c] = n - got
            elif n > got and not allow_short:
                raise RuntimeError(f"{c}: {n - got} of {counts[c]} not filled in {used[c]} attempts")
        lacking = still
    lineage = stages[0] if stages else None
    for stage in stages[1:]:
        lineage = lineage.unionByName(stage)
    return _finish_lineage(lineage, seed, window, created_at), log


def _finish_lineage(stage: DataFrame, seed: int, window, created_at=None) -> DataFrame:
    """Final column set; ``augmented_index`` follows a hash shuffle of the samples."""
    order = uniform(seed, "shuffle", F.col("sample_id"))
    shuffled = uniform_rank(stage.withColumn("__o", order), "__o", ["sample_id"], "augmented_index")
    stamp = F.current_timestamp() if created_at is None else created_at
    out = shuffled.withColumns(
        {
            "timestamp": stamp,
            "smart_crop_x_start": F.col("crop_x"),
            "smart_crop_y_start": F.col("crop_y"),
            "smart_crop_width": F.col("crop_w"),
            "smart_crop_height": F.col("crop_h"),
            "final_crop_y_start": _centred("crop_h", "patch_height"),
            "final_crop_x_start": _centred("crop_w", "patch_width"),
            "final_crop_height": F.col("patch_height"),
            "final_crop_width": F.col("patch_width"),
            "intermediate_height": F.col("crop_h"),
            "intermediate_width": F.col("crop_w"),
        }
    )
    return out.select("sample_id", *LINEAGE_COLUMNS)


def _centred(size: str, patch: str) -> Column:
    return (F.floor((F.col(size) - F.col(patch)) / 2) + 1).cast("int")


def render_samples(lineage: DataFrame, images: DataFrame) -> DataFrame:
    """Final pixels of each accepted sample: effects applied, centre patch kept, renumbered."""
    renamed = lineage.withColumns(
        {
            "crop_x": F.col("smart_crop_x_start"),
            "crop_y": F.col("smart_crop_y_start"),
            "crop_w": F.col("smart_crop_width"),
            "crop_h": F.col("smart_crop_height"),
        }
    )
    frame = ["final_crop_y_start", "final_crop_x_start", "patch_height", "patch_width"]
    pixels = sample_pixels(renamed, images, post=True, keep=frame)
    r = F.col("row") - F.col("final_crop_y_start") + 1
    c = F.col("col") - F.col("final_crop_x_start") + 1
    inside = r.between(1, F.col("patch_height")) & c.between(1, F.col("patch_width"))
    return (
        pixels.where(inside)
        .withColumns({"row": r.cast("int"), "col": c.cast("int")})
        .withColumns({"height": F.col("patch_height"), "width": F.col("patch_width")})
        .drop(*frame)
    )


def cycle_class(index: Column, seed: int) -> Column:
    """Class of a slot in the shuffled 15-slot cycle."""
    slots = [c for c, n in CLASS_CYCLE.items() for _ in range(n)]
    shuffled = F.array_sort(
        F.array(
            *[
                F.struct(uniform(seed, "cycle", F.lit(i)).alias("o"), F.lit(c).alias("c"))
                for i, c in enumerate(slots)
            ]
        )
    )
    return F.get(shuffled, (index % len(slots)).cast("int"))["c"]


def class_cycle_dataset(
    images: DataFrame,
    length: int,
    seed: int,
    size: tuple[int, int],
    excluded: Sequence[int] = (),
    minimum_share: float = 0.05,
    tries: int = 8,
    patience: int = 20,
) -> tuple[DataFrame, int]:
    """Older sampler: classes follow a 15-slot cycle, sources are uniform.

    A sample needs class / (class + background) of at least ``minimum_share`` in
    its patch; each slot takes its lowest passing attempt, and rounds of one, two, four
    and so on up to ``tries`` attempts go on until every slot is filled, so that few are made in
    vain. ``patience`` times ``tries`` attempts of every slot in a row, none of which passes,
    are an error. Returns (lineage with one row per index, number of attempts a slot had at most).
    """
    spark = images.sparkSession
    sources = blocked_rank(
        images.select(F.col("image_id").alias("source_index")).where(
            ~F.col("image_id").isin(*excluded)
        ),
        [],
        [("b", F.floor(F.col("source_index") / ATTEMPT_BLOCK))],
        ["source_index"],
        "place",
    )
    sources = cut_lineage(sources)
    n_sources = sources.count()
    todo = spark.range(length).withColumnRenamed("id", "index")
    parts, first, idle, batch = [], 0, 0, 1
    while not todo.isEmpty():
        if idle >= patience * tries or not n_sources:
            raise RuntimeError(f"no source fills the {todo.count()} slots left")
        attempts = (
            todo.withColumn("attempt", F.explode(F.sequence(F.lit(first), F.lit(first + batch - 1))))
            .withColumn("target_class", cycle_class(F.col("index"), seed))
            .withColumn("sample_id", F.concat_ws("-", F.col("index"), F.col("attempt")))
            .withColumn("place", draw_index(seed, "source", n_sources, F.col("sample_id")) + 1)
        )
        side = max(size)
        picked = attempts.join(sources, "place").drop("place")
        drawn = draw_parameters(picked, seed, ["sample_id"], (side, side), size)
        dims = images.select(F.col("image_id").alias("source_index"), "height", "width")
        framed = drawn.join(dims, "source_index")
        h, w = F.col("height"), F.col("width")
        framed = framed.withColumns(
            {
                "crop_h": F.least(h, F.lit(side)),
                "crop_w": F.least(w, F.lit(side)),
                "crop_y": (
                    draw_index(seed, "cy", F.greatest(h - side + 1, F.lit(1)), F.col("sample_id"))
                    + 1
                ).cast("int"),
                "crop_x": (
                    draw_index(seed, "cx", F.greatest(w - side + 1, F.lit(1)), F.col("sample_id"))
                    + 1
                ).cast("int"),
            }
        ).drop("height", "width")
        framed = cut_lineage(framed)
        made = sample_pixels(framed, images, post=False, planes=S.P_COLUMNS)
        top = lambda s, n: F.floor((F.col(s) - n) / 2)
        patch = made.where(
            F.col("row").between(top("height", size[0]) + 1, top("height", size[0]) + size[0])
            & F.col("col").between(top("width", size[1]) + 1, top("width", size[1]) + size[1])
        )
        own = F.sum(_p_of(F.col("target_class")))
        share = patch.groupBy("sample_id").agg(
            F.try_divide(own, own + F.sum("p_background")).alias("class_share")
        )
        passed = framed.join(share.where(F.col("class_share") >= minimum_share), "sample_id")
        fields = [c for c in passed.columns if c != "index"]
        winners = cut_lineage(
            passed.groupBy("index")
            .agg(F.min_by(F.struct(*fields), "attempt").alias("s"))
            .select("index", "s.*")
        )
        idle = idle + batch if winners.isEmpty() else 0
        parts.append(winners)
        todo = cut_lineage(todo.join(winners.select("index"), "index", "left_anti"))
        first, batch = first + batch, min(2 * batch, tries)
    if not parts:
        raise ValueError("length must be positive")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, first


def crop_first_parameters(df: DataFrame, seed: int, ids: Sequence[str]) -> DataFrame:
    """Parameters of the crop-first variant: milder turns, wider shears, zoom, flips 1:1:2."""
    key = [F.col(c) for c in ids]
    flips = F.array(*[F.lit(f) for f in ("flipx", "flipy", "noop", "noop")])
    return df.withColumns(
        {
            "flip_type": flips[draw_index(seed, "flip", 4, *key).cast("int")],
            "shear_x_angle": (draw_index(seed, "shear_x", 41, *key) - 20).cast("double"),
            "shear_y_angle": (draw_index(seed, "shear_y", 41, *key) - 20).cast("double"),
            "rotation_angle": (draw_index(seed, "rotation", 90, *key) + 1).cast("double"),
            "scale_factor": F.round(draw_index(seed, "zoom", 5, *key) * 0.1 + 0.8, 4),
        }
    )


def crop_first_samples(images: DataFrame, samples: DataFrame, size: tuple[int, int], seed: int):
    """Random crop, flip, shears, turn, zoom; the crop size is kept."""
    planes = list(PLANES)
    drawn = crop_first_parameters(samples, seed, ["sample_id"])
    joined = drawn.join(images.withColumnRenamed("image_id", "source_index"), "source_index")
    ch, cw = size
    h, w = F.col("height"), F.col("width")
    joined = joined.withColumns(
        {
            "crop_h": F.least(h, F.lit(ch)),
            "crop_w": F.least(w, F.lit(cw)),
            "crop_y": (
                draw_index(seed, "cy", F.greatest(h - ch + 1, F.lit(1)), F.col("sample_id")) + 1
            ).cast("int"),
            "crop_x": (
                draw_index(seed, "cx", F.greatest(w - cw + 1, F.lit(1)), F.col("sample_id")) + 1
            ).cast("int"),
        }
    )
    kept = ["sample_id", "source_index", "flip_type", "shear_x_angle", "shear_y_angle",
            "rotation_angle", "scale_factor"]
    cropped = resample.crop(joined, planes, kept)
    return resample.apply_steps(cropped, planes, resample.CROP_FIRST, len(S.CLASSES), ["sample_id", "source_index"])


def shuffle_rows(df: DataFrame, seed: int, ids: Sequence[str]) -> DataFrame:
    """Reproducible random order."""
    return df.orderBy(uniform(seed, "shuffle", *[F.col(c) for c in ids]), *ids)


def shuffled_places(df: DataFrame, seed: int, ids: Sequence[str], out: str = "place") -> DataFrame:
    """The place of every row in the order of ``shuffle_rows``, without sorting the table as a whole."""
    drawn = df.withColumn("__draw", uniform(seed, "shuffle", *[F.col(c) for c in ids]))
    return uniform_rank(drawn, "__draw", ids, out).drop("__draw")


def first_n(df: DataFrame, order: str, n: int = 100) -> DataFrame:
    return df.orderBy(order).limit(n)


def stratified_pick(df: DataFrame, seed: int, id_column: str, strata: str, n: int = 10):
    """One random row per stratum, then random distinct rows up to ``n``."""
    order = uniform(seed, "pick", F.col(id_column))
    rest = F.struct(*[c for c in df.columns if c != strata])
    heads = df.groupBy(strata).agg(F.min_by(rest, F.struct(order, id_column)).alias("r"))
    heads = heads.select(strata, "r.*").select(*df.columns)
    others = df.join(heads.select(id_column), id_column, "left_anti").select(*df.columns)
    ranked = heads.withColumn("__g", F.lit(0)).unionByName(others.withColumn("__g", F.lit(1)))
    return ranked.orderBy("__g", order, id_column).limit(n).drop("__g")
