"""Registered queries: crops, growth, gates, augmented datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixloom import schema as S
from pixloom.operators import augment as A, pixels as P, resample, stats
from pixloom.plans import proxies as X
from pixloom.plans.registry import query, rnd, rounded

_FG = "(p_scar + p_redness + p_hematoma + p_necrosis)"
_CLASSES_SQL = "(['scar','redness','hematoma','necrosis','background'])"


def _samples(spark, sf):
    """Every image is a sample targeted at the class its label names."""
    classes = F.array(*[F.lit(c) for c in S.CLASSES])
    return X.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.col("vec_id").alias("source_index"),
        F.get(classes, F.col("label") % 5).alias("target_class"),
    )


@query(
    "class_pixels",
    f"""WITH {X.PX} SELECT image_id, y AS "row", x AS col FROM px WHERE p_scar > 0.5""",
)
def class_pixels(spark, sf):
    return A.class_pixels(X.pixels(spark, sf), "scar")


@query(
    "smart_crop",
    f"""WITH {X.PX}, {X.CLASS_LONG},
    s AS (SELECT vec_id AS sample_id, vec_id AS image_id, {_CLASSES_SQL}[label % 5 + 1] AS class
      FROM embeddings),
    mem AS (SELECT image_id, class, y, x, row_number() OVER (PARTITION BY image_id, class ORDER BY y, x)
      AS place, count(*) OVER (PARTITION BY image_id, class) AS n FROM clong
      WHERE p > 0.5 AND class != 'background'),
    cnt AS (SELECT DISTINCT image_id, class, n FROM mem),
    dr AS (SELECT sample_id, s.image_id, s.class, n, unnest(range(1, least(20, n) + 1)) AS k
      FROM s JOIN cnt USING (image_id, class)),
    ch AS (SELECT dr.*, {X.index_sql(13, 'centre', 'n', 'sample_id', 'k')} + 1 AS place FROM dr),
    w AS (SELECT ch.sample_id, ch.image_id, ch.class, k, greatest(1, least(x - 2, 5)) AS cx,
      greatest(1, least(y - 2, 5)) AS cy FROM ch JOIN mem USING (image_id, class, place)),
    m AS (SELECT w.sample_id, k, cx, cy, round(sum(p) / 16 * 100, 9) AS pct FROM w JOIN clong c
      ON c.image_id = w.image_id AND c.class = w.class AND c.y BETWEEN cy AND cy + 3
      AND c.x BETWEEN cx AND cx + 3 GROUP BY ALL),
    b AS (SELECT sample_id, arg_max(cx, (pct, -k)) AS bx, arg_max(cy, (pct, -k)) AS yy FROM m GROUP BY 1)
    SELECT sample_id, source_index, target_class, coalesce(bx, rx)::INT AS crop_x,
    coalesce(yy, ry)::INT AS crop_y, 4 AS crop_w, 4 AS crop_h FROM
    (SELECT sample_id, image_id AS source_index, class AS target_class,
      {X.index_sql(13, 'window_x', '5', 'sample_id')} + 1 AS rx,
      {X.index_sql(13, 'window_y', '5', 'sample_id')} + 1 AS ry FROM s) q LEFT JOIN b USING (sample_id)""",
)
def smart_crop(spark, sf):
    return A.smart_crop(X.pixels(spark, sf), _samples(spark, sf), (4, 4), 13)


_GROW = f"""
smp AS (SELECT vec_id AS sample_id, {_CLASSES_SQL}[label % 5 + 1] AS target_class FROM embeddings),
sz AS (SELECT sample_id, target_class, m, sum({_FG}) / count(*) * 100 AS fg,
  {", ".join(f"sum(p_{c}) / count(*) * 100 AS {c}" for c in S.CLASSES)}
  FROM px JOIN smp ON sample_id = image_id, (SELECT unnest([1, 2, 3, 4]) AS m) t
  WHERE 2 * m <= 8 AND 3 * m <= 8
  AND y BETWEEN (8 - 2 * m) // 2 + 1 AND (8 - 2 * m) // 2 + 2 * m
  AND x BETWEEN (8 - 3 * m) // 2 + 1 AND (8 - 3 * m) // 2 + 3 * m GROUP BY ALL),
lm AS (SELECT *, CASE WHEN target_class = 'background' THEN 100.0 ELSE 50.0 END AS lim FROM sz),
ps AS (SELECT sample_id, min(m) FILTER (fg <= lim) AS first, max(m) AS largest FROM lm GROUP BY 1),
gr AS (SELECT lm.*, first FROM lm JOIN ps ON ps.sample_id = lm.sample_id
  AND lm.m = coalesce(first, largest))
"""


@query(
    "grow_patch",
    f"""WITH {X.PX}, {_GROW} SELECT sample_id, target_class, 'ok' AS status, m AS size_multiplier,
    2 * m AS patch_height, 3 * m AS patch_width, lim::DOUBLE AS fg_threshold_used,
    {rnd('fg')} AS actual_fg_percentage, CASE WHEN first IS NULL AND m < 4 THEN m + 1 ELSE m END
    AS growth_iterations, m >= 4 AND fg > lim AS max_size_reached FROM gr""",
)
def grow_patch(spark, sf):
    px = X.pixels(spark, sf).withColumnRenamed("image_id", "sample_id")
    px = px.join(_samples(spark, sf).drop("source_index"), "sample_id")
    out = A.grow_patch(px, (2, 3), 4)
    return rounded(out.drop(*[f"{c}_percentage" for c in S.CLASSES]))


@query(
    "quality_gate",
    f"""WITH {X.PX}, {_GROW}, pr AS (SELECT image_id AS sample_id, {", ".join(
        f"sum(p_{c}) / count(*) * 100 AS s_{c}" for c in S.CLASSES)} FROM px GROUP BY 1)
    SELECT sample_id, target_class, target_class = 'background' OR
    CASE target_class {" ".join(f"WHEN '{c}' THEN {c} >= greatest(0.5, 0.3 * s_{c})" for c in S.CLASSES)}
    END AS accepted FROM gr JOIN pr USING (sample_id)""",
)
def quality_gate(spark, sf):
    px = X.pixels(spark, sf)
    named = px.withColumnRenamed("image_id", "sample_id").join(
        _samples(spark, sf).drop("source_index"), "sample_id"
    )
    grown = A.grow_patch(named, (2, 3), 4).withColumn("source_index", F.col("sample_id"))
    gated = A.quality_gate(grown, stats.source_profile(px))
    return gated.select("sample_id", "target_class", "accepted")


@query(
    "crop_windows",
    f"""WITH {X.PX} SELECT image_id, (y - (label % 4))::INT AS "row", (x - 2)::INT AS col, {rnd('r')} AS r
    FROM px JOIN embeddings ON vec_id = image_id
    WHERE y BETWEEN label % 4 + 1 AND label % 4 + 4 AND x BETWEEN 3 AND 7""",
)
def crop_windows(spark, sf):
    labels = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    images = X.images(spark, sf).select("image_id", "height", "width", "r").join(labels, "image_id")
    windowed = images.withColumns(
        {
            "crop_y": (F.col("label") % 4 + 1).cast("int"), "crop_x": F.lit(3),
            "crop_h": F.lit(4), "crop_w": F.lit(5),
        }
    )
    cut = resample.crop(windowed, ["r"], ["image_id"])
    return rounded(P.to_pixels(cut).drop("height", "width"))


def _planar(spark, sf):
    return X.images(spark, sf)


@query(
    "geometric_flip",
    f"""WITH {X.PX} SELECT image_id, (9 - y)::INT AS "row", x AS col, {rnd('r')} AS r,
    {rnd('round_even(p_background, 0)')} AS p_background FROM px""",
)
def geometric_flip(spark, sf):
    """Half turn plus a mirror about the vertical axis is a flip of rows."""
    drawn = _planar(spark, sf).withColumns(
        {
            "scale_factor": F.lit(1.0), "shear_x_angle": F.lit(0.0), "shear_y_angle": F.lit(0.0),
            "rotation_angle": F.lit(0.0), "flip_type": F.lit("flipy"),
        }
    )
    out = resample.geometric(drawn, A.PLANES, len(S.CLASSES), ["image_id"])
    px = P.to_pixels(out, A.PLANES)
    return rounded(px.select("image_id", "row", "col", "r", "p_background"))


def _grid_sql(seed: int, name: str, first: float, by: float, n: int) -> str:
    return f"round({X.index_sql(seed, name, str(n), 'vec_id')} * {by} + {first}, 4)"


def _drawn_sql(seed: int) -> str:
    """Columns s, kx, ky, t, f (mirrored along x, y or not) and the corner ox, oy of the crop."""
    return f"""{_grid_sql(seed, "scale", 0.9, 0.01, 21)} AS s, tan(radians({_grid_sql(seed, "shear_x", -10.0, 0.1, 201)})) AS kx,
      tan(radians({_grid_sql(seed, "shear_y", -10.0, 0.1, 201)})) AS ky, radians({_grid_sql(seed, "rotation", 1.0, 0.1, 3591)}) AS t,
      {X.index_sql(seed, "flip", "3", "vec_id")} AS f, 0 AS ox, 0 AS oy"""


def _crop_first_sql(seed: int, side: int) -> str:
    return f"""{_grid_sql(seed, "zoom", 0.8, 0.1, 5)} AS s, tan(radians({X.index_sql(seed, "shear_x", "41", "vec_id")} - 20)) AS kx,
      tan(radians({X.index_sql(seed, "shear_y", "41", "vec_id")} - 20)) AS ky,
      radians({X.index_sql(seed, "rotation", "90", "vec_id")} + 1) AS t, {X.index_sql(seed, "flip", "4", "vec_id")} AS f,
      {X.index_sql(seed, "cx", str(9 - side), "vec_id")}::INT AS ox, {X.index_sql(seed, "cy", str(9 - side), "vec_id")}::INT AS oy"""


def _steps_sql(draws: str, order: tuple[str, ...], side: int = 8) -> str:
    """Class shares after drawn linear steps in this order: matrices, inverse map and bilinear reading in SQL."""
    cells = {
        "scale": ("s * a", "s * b", "s * c", "s * d"),
        "shear_x": ("a + kx * c", "b + kx * d", "c", "d"),
        "shear_y": ("a", "b", "c + ky * a", "d + ky * b"),
        "rotate": ("cos(t) * a - sin(t) * c", "cos(t) * b - sin(t) * d", "sin(t) * a + cos(t) * c", "sin(t) * b + cos(t) * d"),
        "flip": ("fx * a", "fx * b", "fy * c", "fy * d"),
    }
    steps, last = [], "m0"
    for k, step in enumerate(order, start=1):
        new = ", ".join(f"{v} AS {n}" for v, n in zip(cells[step], "abcd", strict=True))
        steps.append(f"m{k} AS (SELECT image_id, s, kx, ky, t, fx, fy, {new} FROM {last})")
        last = f"m{k}"
    at = {i + j: f"(r{i} + oy - 1) * 8 + c{j} + ox" for i in "01" for j in "01"}
    mid = (side + 1) / 2
    value = " + ".join(
        f"l[{i}] * {'fr' if k[0] == '1' else '(1 - fr)'} * {'fc' if k[1] == '1' else '(1 - fc)'}" for k, i in at.items()
    )
    shares = ", ".join(
        f"{rnd(f'sum(CASE WHEN inside THEN round_even({value.replace("l[", f"l_{c}[")}, 0) ELSE 0 END) / {side * side} * 100')} AS {c}_percentage"
        for c in S.CLASSES
    )
    return f"""WITH {X.PX},
    lists AS (SELECT image_id, {", ".join(f"list(p_{c} ORDER BY y, x) AS l_{c}" for c in S.CLASSES)} FROM px GROUP BY image_id),
    draws AS (SELECT vec_id AS image_id, {draws} FROM embeddings),
    m0 AS (SELECT *, CASE WHEN f = 0 THEN -1.0 ELSE 1.0 END AS fx, CASE WHEN f = 1 THEN -1.0 ELSE 1.0 END AS fy,
      1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, 1.0::DOUBLE AS d FROM draws),
    {", ".join(steps)},
    g AS (SELECT image_id, round((a * (y - {mid}) - c * (x - {mid})) / (a * d - b * c) + {mid}, 9) AS sr,
      round((d * (x - {mid}) - b * (y - {mid})) / (a * d - b * c) + {mid}, 9) AS sc FROM {last} JOIN (SELECT image_id, y, x FROM px WHERE y <= {side} AND x <= {side}) USING (image_id)),
    e AS (SELECT image_id, sr BETWEEN 1 AND {side} AND sc BETWEEN 1 AND {side} AS inside, greatest(1, least({side}, sr)) AS r,
      greatest(1, least({side}, sc)) AS c FROM g),
    h AS (SELECT *, floor(r)::INT AS r0, floor(c)::INT AS c0, least(floor(r)::INT + 1, {side}) AS r1,
      least(floor(c)::INT + 1, {side}) AS c1, r - floor(r) AS fr, c - floor(c) AS fc FROM e)
    SELECT image_id AS source_index, {shares}, count(*) AS total_pixels
    FROM h JOIN lists USING (image_id) JOIN (SELECT image_id, ox, oy FROM draws) USING (image_id) GROUP BY image_id"""


@query("geometric_drawn", _steps_sql(_drawn_sql(21), resample.GEOMETRY))
def geometric_drawn(spark, sf):
    """Per-image drawn turns, shears, scales and flips, bilinear, as class shares of the result."""
    drawn = A.draw_parameters(_planar(spark, sf), 21, ["image_id"], (8, 8), (8, 8))
    out = resample.geometric(drawn, A.PLANES, len(S.CLASSES), ["image_id"])
    return rounded(stats.source_profile(P.to_pixels(out, A.PLANES)))


@query("steps_reordered", _steps_sql(_drawn_sql(24), resample.CROP_FIRST))
def steps_reordered(spark, sf):
    """The same steps in the order of the crop-first variant: another list, nothing else."""
    drawn = A.draw_parameters(_planar(spark, sf), 24, ["image_id"], (8, 8), (8, 8))
    out = resample.apply_steps(drawn, A.PLANES, resample.CROP_FIRST, len(S.CLASSES), ["image_id"])
    return rounded(stats.source_profile(P.to_pixels(out, A.PLANES)))


@query("post_effects")
def post_effects(spark, sf):
    """Rows only: elastic field, jitter and blur in numpy."""
    drawn = A.draw_parameters(_planar(spark, sf), 22, ["image_id"], (8, 8), (8, 8))
    out = resample.post_effects(drawn, A.PLANES, len(S.PIXEL_CHANNELS), ["image_id"])
    return rounded(stats.channel_stats_by_image(P.to_pixels(out, A.PLANES)))


def _blur_sql(source: str, out: str, axis: str) -> str:
    other = "x" if axis == "y" else "y"
    return f"""{out} AS (SELECT a.image_id, a.y, a.x, sum(t.w * s.v) AS v FROM {source} a JOIN taps t USING (image_id)
      JOIN {source} s ON s.image_id = a.image_id AND s.{other} = a.{other} AND s.{axis} = greatest(1, least(8, a.{axis} + t.off))
      GROUP BY a.image_id, a.y, a.x)"""


@query(
    "jitter_and_blur",
    f"""WITH {X.PX}, d AS (SELECT vec_id AS image_id, {_grid_sql(25, 'brightness', 0.8, 0.1, 5)} AS f,
      {_grid_sql(25, 'saturation', -0.2, 0.1, 5)} AS o, {X.index_sql(25, 'kernel', '3', 'vec_id')} + 1 AS half,
      {_grid_sql(25, 'sigma', 1.0, 0.1, 21)} AS sigma FROM embeddings),
    j AS (SELECT image_id, y, x, greatest(0.0, least(1.0, g * f + o)) AS v FROM px JOIN d USING (image_id)),
    raw AS (SELECT image_id, off, exp(-(off * off) / (2.0 * sigma * sigma)) AS w
      FROM d, (SELECT unnest(range(-3, 4)) AS off) WHERE abs(off) <= half),
    taps AS (SELECT image_id, off, w / sum(w) OVER (PARTITION BY image_id) AS w FROM raw),
    {_blur_sql('j', 'down', 'y')}, {_blur_sql('down', 'across', 'x')}
    SELECT image_id, y AS "row", x AS col, {rnd('across.v')} AS g, {rnd('round_even(p_scar, 0)')} AS p_scar
    FROM across JOIN px USING (image_id, y, x)""",
)
def jitter_and_blur(spark, sf):
    """Two of the post effects as a list of their own: colours change, masks are only rounded."""
    drawn = A.draw_parameters(_planar(spark, sf), 25, ["image_id"], (8, 8), (8, 8))
    out = resample.apply_steps(drawn, A.PLANES, ("jitter", "blur"), len(S.CLASSES), ["image_id"])
    return rounded(P.to_pixels(out, A.PLANES).select("image_id", "row", "col", "g", "p_scar"))


@query("crop_first_variant", _steps_sql(_crop_first_sql(23, 6), resample.CROP_FIRST, 6))
def crop_first_variant(spark, sf):
    """The crop-first variant on every image, as class shares."""
    samples = _samples(spark, sf).drop("target_class")
    out = A.crop_first_samples(X.images(spark, sf), samples, (6, 6), 23)
    px = P.to_pixels(
        out.select(F.col("sample_id").alias("image_id"), "height", "width", *A.PLANES), A.PLANES
    )
    return rounded(stats.source_profile(px))


def balanced(spark, sf):
    """Lineage of a balanced dataset as large as the number of source images."""
    images, px = X.mask_images(spark, sf), X.mask_pixels(spark, sf)
    profile = stats.source_profile(px)
    total = images.agg(F.count(F.lit(1)).alias("total"))
    counts = {r["class"]: r["count"] for r in A.quota(total).collect()}
    stamp = F.lit("2025-01-01 00:00:00").cast("timestamp")
    lineage, _ = A.balanced_dataset(
        images, px, profile, counts, 31, (2, 2), 2, created_at=stamp
    )
    return lineage


@query(
    "balanced_dataset",
    """WITH n AS (SELECT count(*) AS n FROM embeddings), q AS (
      SELECT 'scar' AS target_class, round_even(n * 0.15, 0)::BIGINT AS samples FROM n UNION ALL
      SELECT 'redness', round_even(n * 0.15, 0)::BIGINT FROM n UNION ALL
      SELECT 'hematoma', round_even(n * 0.30, 0)::BIGINT FROM n UNION ALL
      SELECT 'necrosis', round_even(n * 0.05, 0)::BIGINT FROM n)
    SELECT target_class, samples, true AS gate_held FROM q UNION ALL
    SELECT 'background', n - (SELECT sum(samples) FROM q)::BIGINT, true FROM n""",
)
def balanced_dataset(spark, sf):
    """The draws are hashes, so quotas and the gate are what SQL can state."""
    lineage = balanced(spark, sf)
    profile = stats.source_profile(X.mask_pixels(spark, sf))
    gated = A.quality_gate(lineage, profile)
    return gated.groupBy("target_class").agg(
        F.count(F.lit(1)).alias("samples"), F.bool_and("accepted").alias("gate_held")
    )


@query("balanced_samples")
def balanced_samples(spark, sf):
    """Rows only: the rendered patches of the balanced dataset, one row per sample."""
    lineage = balanced(spark, sf)
    px = A.render_samples(lineage, X.mask_images(spark, sf))
    return rounded(
        px.groupBy("sample_id", "target_class").agg(
            F.count(F.lit(1)).alias("pixels"), F.avg("r").alias("mean_r"),
            F.avg("p_background").alias("mean_background"),
        )
    )


@query(
    "class_cycle_dataset",
    """SELECT count(*) AS filled, 0::BIGINT AS below_share, 0::BIGINT AS excluded_used FROM embeddings""",
)
def class_cycle_dataset(spark, sf):
    """One sample per source image; every slot fills, none below the share, none excluded."""
    images = X.mask_images(spark, sf)
    n = images.count()
    out, _ = A.class_cycle_dataset(images, n, 41, (4, 4), excluded=(8, 16))
    return out.agg(
        F.count(F.lit(1)).alias("filled"),
        F.count_if(F.col("class_share") < 0.05).alias("below_share"),
        F.count_if(F.col("source_index").isin(8, 16)).alias("excluded_used"),
    )


@query(
    "shuffled_order",
    f"""SELECT event_id, row_number() OVER (ORDER BY {X.uniform_sql(6, 'shuffle', 'event_id')}, event_id)
    AS place FROM events""",
)
def shuffled_order(spark, sf):
    return A.shuffled_places(X.table(spark, sf, "events").select("event_id"), 6, ["event_id"])
