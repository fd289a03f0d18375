"""Registered queries: dataset statistics, projections, colour, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixloom import schema as S
from pixloom.functions import colour
from pixloom.operators import colours, metrics, pixels as P, reports, stats
from pixloom.plans import proxies as X
from pixloom.plans.registry import query, rnd, rnd_as, rounded

CLASS_ROWS = " UNION ALL ".join(f"SELECT '{c}' AS class" for c in S.CLASSES)
FG = "(p_scar + p_redness + p_hematoma + p_necrosis)"
SUMS = ", ".join(f"sum(p_{c}) AS {c}" for c in S.CLASSES)


def skew_sql(x: str, n: str = "count", minimum: int = 2) -> str:
    """Third central moment over the cubed sample deviation, 0 where undefined."""
    return (
        f"CASE WHEN count({x}) < {minimum} OR stddev_samp({x}) = 0 THEN 0 ELSE"
        f" (avg(pow({x}, 3)) - 3 * avg({x}) * avg({x} * {x}) + 2 * pow(avg({x}), 3))"
        f" / pow(stddev_samp({x}), 3) END"
    )


@query(
    "class_area_stats",
    f"""WITH {X.PX}, {X.CLASS_LONG},
    a AS (SELECT image_id, class, sum(p) AS area, count(*) AS n FROM clong GROUP BY ALL),
    s AS (SELECT class, sum(area) AS total_area, avg(area) AS mean_area,
          stddev_samp(area) AS std_area, sum(n)::BIGINT AS total_pixels, count(*) AS n_images
          FROM a GROUP BY class)
    SELECT class, {rnd_as('total_area', 'mean_area', 'std_area')},
           {rnd('mean_area / sum(mean_area) OVER ()')} AS normalised, total_pixels, n_images FROM s""",
)
def class_area_stats(spark, sf):
    return rounded(stats.class_area_stats(X.pixels(spark, sf)))


@query(
    "class_shares_outliers",
    f"""WITH {X.PX}, {X.CLASS_LONG},
    a AS (SELECT image_id, class, sum(p) AS area FROM clong GROUP BY ALL),
    s AS (SELECT image_id, class, area / sum(area) OVER (PARTITION BY image_id) AS share FROM a),
    q AS (SELECT class, quantile_cont(share, 0.25) AS q1, quantile_cont(share, 0.75) AS q3
          FROM s GROUP BY class)
    SELECT s.image_id, s.class, {rnd('share')} AS share, {rnd('q1 - 1.5 * (q3 - q1)')} AS lower,
           {rnd('q3 + 1.5 * (q3 - q1)')} AS upper,
           share < q1 - 1.5 * (q3 - q1) OR share > q3 + 1.5 * (q3 - q1) AS is_outlier
    FROM s JOIN q USING (class)""",
)
def class_shares_outliers(spark, sf):
    shares = stats.class_shares(X.pixels(spark, sf))
    return rounded(stats.iqr_outliers(shares, "share", ["class"]))


@query(
    "price_outliers_global",
    f"""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1,
                  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
    SELECT count(*) FILTER (l_extendedprice < q1 - 1.5 * (q3 - q1)
             OR l_extendedprice > q3 + 1.5 * (q3 - q1)) AS n_outliers,
           {rnd('''count(*) FILTER (l_extendedprice < q1 - 1.5 * (q3 - q1)
             OR l_extendedprice > q3 + 1.5 * (q3 - q1)) / count(*) * 100''')} AS outlier_pct
    FROM lineitem, q""",
)
def price_outliers_global(spark, sf):
    li = X.table(spark, sf, "lineitem").select("l_extendedprice")
    return rounded(stats.outlier_summary(stats.iqr_outliers(li, "l_extendedprice")))


@query(
    "source_profile",
    f"""WITH {X.PX} SELECT image_id AS source_index,
    {", ".join(f"{rnd(f'sum(p_{c}) / count(*) * 100')} AS {c}_percentage" for c in S.CLASSES)},
    count(*) AS total_pixels FROM px GROUP BY image_id""",
)
def source_profile(spark, sf):
    return rounded(stats.source_profile(X.pixels(spark, sf)))


@query(
    "foreground_pct",
    f"WITH {X.PX} SELECT image_id, {rnd(f'sum({FG}) / count(*) * 100')} AS foreground_pct"
    " FROM px GROUP BY image_id",
)
def foreground_pct(spark, sf):
    return rounded(stats.foreground_pct(X.pixels(spark, sf)))


@query(
    "channel_stats_by_image",
    f"""WITH {X.PX} SELECT image_id,
    {", ".join(f"{rnd(f'avg({c})')} AS {c}_mean, {rnd(f'stddev_samp({c})')} AS {c}_std, "
               f"{rnd(skew_sql(c))} AS {c}_skew" for c in 'rgb')} FROM px GROUP BY image_id""",
)
def channel_stats_by_image(spark, sf):
    return rounded(stats.channel_stats_by_image(X.pixels(spark, sf)))


@query(
    "channel_stats",
    f"""WITH {X.PX}, m AS (SELECT image_id,
    {", ".join(f"avg({c}) AS {c}m, {skew_sql(c)} AS {c}s" for c in 'rgb')}
    FROM px GROUP BY image_id)
    SELECT {", ".join(f"{rnd(f'avg({c}m)')} AS {c}_mean, {rnd(f'stddev_samp({c}m)')} AS {c}_std, "
                      f"{rnd(f'avg({c}s)')} AS {c}_skew" for c in 'rgb')},
    count(*) AS n_images FROM m""",
)
def channel_stats(spark, sf):
    return rounded(stats.channel_stats(X.pixels(spark, sf)))


@query(
    "channel_correlation",
    f"""WITH {X.PX}, m AS (SELECT image_id, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM px
    GROUP BY image_id)
    SELECT {rnd('corr(r, g)')} AS corr_rg, {rnd('corr(r, b)')} AS corr_rb,
    {rnd('corr(g, b)')} AS corr_gb FROM m""",
)
def channel_correlation(spark, sf):
    return rounded(stats.channel_correlation(X.pixels(spark, sf)))


def _masked_sql(mask: str, prefix: str = "") -> str:
    parts = []
    for c in "rgb":
        v = f"CASE WHEN {mask} THEN {c} END"
        parts += [
            f"{rnd(f'coalesce(avg({v}), 0)')} AS {prefix}{c}_mean",
            f"{rnd(f'coalesce(stddev_samp({v}), 0)')} AS {prefix}{c}_std",
            f"{rnd(f'coalesce({skew_sql(v, minimum=3)}, 0)')} AS {prefix}{c}_skew",
        ]
    return ", ".join(parts) + f", count(*) FILTER ({mask}) AS {prefix}pixel_count"


@query(
    "masked_channel_stats",
    f"""WITH {X.PX} SELECT image_id, {_masked_sql('r >= 0.55 AND g >= 0.55 AND b >= 0.55')}
    FROM px GROUP BY image_id""",
)
def masked_channel_stats(spark, sf):
    return rounded(stats.masked_channel_stats(X.pixels(spark, sf), P.white_band(0.55)))


@query(
    "region_vs_full",
    f"""WITH {X.PX} SELECT image_id, 'full' AS scope, {_masked_sql('true')} FROM px GROUP BY image_id
    UNION ALL SELECT image_id, 'region' AS scope,
    {_masked_sql('y BETWEEN 2 AND 6 AND x BETWEEN 3 AND 8')} FROM px GROUP BY image_id""",
)
def region_vs_full(spark, sf):
    region = P.in_region(F.lit(2), F.lit(6), F.lit(3), F.lit(99))
    return rounded(stats.region_vs_full_channels(X.pixels(spark, sf), region))


@query(
    "region_vs_full_histograms",
    f"""WITH {X.PX}, s AS (SELECT *, 'full' AS scope FROM px UNION ALL
      SELECT *, 'region' FROM px WHERE y BETWEEN 2 AND 6 AND x BETWEEN 3 AND 8),
    v AS (SELECT image_id, scope, 'r' AS channel, r AS v FROM s UNION ALL
          SELECT image_id, scope, 'g', g FROM s UNION ALL SELECT image_id, scope, 'b', b FROM s),
    n AS (SELECT image_id, scope, channel, least(floor(v / (1.0::DOUBLE / 50)), 49)::INT AS bin,
          count(*) AS n FROM v GROUP BY ALL),
    k AS (SELECT DISTINCT image_id, scope, channel FROM v),
    f AS (SELECT k.*, unnest(range(50))::INT AS bin FROM k)
    SELECT f.image_id, f.scope, f.channel, f.bin, {rnd('f.bin * (1.0::DOUBLE / 50)')} AS bin_start,
    coalesce(n.n, 0) AS n FROM f LEFT JOIN n USING (image_id, scope, channel, bin)""",
)
def region_vs_full_histograms(spark, sf):
    region = P.in_region(F.lit(2), F.lit(6), F.lit(3), F.lit(99))
    return rounded(stats.region_vs_full_histograms(X.pixels(spark, sf), region))


_DOM = "CASE " + " ".join(
    f"WHEN p_{c} = greatest({', '.join(S.P_COLUMNS)}) THEN '{c}'" for c in S.CLASSES
) + " END"


@query(
    "dominant_class",
    f"""WITH {X.PX} SELECT image_id, y AS "row", x AS col,
    CASE WHEN greatest({', '.join(S.P_COLUMNS)}) > 0.5 THEN {_DOM} END AS class,
    {rnd(FG)} AS p_foreground, {rnd('p_background')} AS p_background,
    {", ".join(f"(round_even(p_{c}, 0) + 0.0)::DOUBLE AS b_{c}" for c in S.CLASSES)} FROM px""",
)
def dominant_class(spark, sf):
    px = X.pixels(spark, sf).withColumn("class", P.dominant_class())
    px = P.binarise_round(
        px.withColumns({f"b_{c}": F.col(S.p_col(c)) for c in S.CLASSES}),
        [f"b_{c}" for c in S.CLASSES],
    )
    out = P.to_foreground(px)
    return rounded(
        out.select("image_id", "row", "col", "class", "p_foreground", "p_background",
                   *[f"b_{c}" for c in S.CLASSES])
    )


@query(
    "class_index_names",
    f"""WITH v AS (SELECT event_id, CASE event_id % 7 {" ".join(
        f"WHEN {i} THEN '{c}'" for i, c in enumerate(S.CLASSES))} WHEN 5 THEN 'red'
        ELSE event_type END AS class FROM events),
    d AS ({" UNION ALL ".join(f"SELECT '{c}' AS class, {i} AS class_index" for i, c in
          enumerate(S.CLASSES, start=1))}),
    t AS ({" UNION ALL ".join(f"SELECT '{c}' AS class, '{n}' AS display_name" for c, n in
          {**S.CLASS_NAMES_DE, **S.CHANNEL_NAMES_DE}.items())})
    SELECT event_id, class, coalesce(class_index, 0) AS class_index, d.class AS back,
    display_name FROM v LEFT JOIN d USING (class) LEFT JOIN t USING (class)""",
)
def class_index_names(spark, sf):
    ev = X.table(spark, sf, "events").select("event_id", "event_type")
    names = F.array(*[F.lit(c) for c in S.CLASSES], F.lit("red"))
    name = F.coalesce(F.get(names, (F.col("event_id") % 7).cast("int")), F.col("event_type"))
    out = ev.select("event_id", name.alias("class"))
    return out.select(
        "event_id", "class",
        P.class_index(F.col("class")).cast("int").alias("class_index"),
        P.index_class(P.class_index(F.col("class"))).alias("back"),
        P.translate(F.col("class")).alias("display_name"),
    )


@query(
    "clip_and_mask",
    f"""WITH {X.PX}, m AS (SELECT *, CASE WHEN b > 0.5 THEN 1.0 ELSE 0.0 END AS k FROM px)
    SELECT image_id, y AS "row", x AS col,
    {", ".join(f"{rnd(f'p_{c} * k')} AS p_{c}" for c in S.FOREGROUND_CLASSES)},
    {rnd('1.0 - k')} AS p_background,
    {", ".join(f"{rnd(f'CASE WHEN r + g + b > 1.5 THEN {c} ELSE 0 END')} AS {c}" for c in 'rgb')}
    FROM m""",
)
def clip_and_mask(spark, sf):
    px = P.clip_to_polygon(X.pixels(spark, sf), F.col("b"))
    mask = P.in_mask("sum_over_1.5", F.col("r"), F.col("g"), F.col("b"))
    return rounded(P.apply_mask(px, mask).drop("height", "width"))


@query(
    "mask_by_image",
    f"""WITH {X.PX}, m AS (SELECT image_id, y, x, p_background > 0.3 AS k FROM px)
    SELECT image_id, y AS "row", x AS col,
    {", ".join(f"{rnd(f'CASE WHEN k THEN {c} ELSE 0 END')} AS {c}" for c in 'rgb')}
    FROM px JOIN m USING (image_id, y, x)""",
)
def mask_by_image(spark, sf):
    px = X.pixels(spark, sf)
    masks = px.select(
        "image_id", "row", "col", "height", "width",
        *[F.when(F.col("p_background") > 0.3, 1.0).otherwise(0.0).alias(c) for c in "rgb"],
    )
    return rounded(P.mask_by_image(px, masks).select("image_id", "row", "col", "r", "g", "b"))


_PAL = S.PALETTES["shape"]


@query(
    "colourise",
    f"""WITH {X.PX} SELECT image_id, y AS "row", x AS col,
    {", ".join(rnd(' + '.join(f'p_{c} * {_PAL[c][i]}' for c in S.CLASSES)) + f' AS c{n}'
               for i, n in enumerate('rgb'))} FROM px""",
)
def colourise(spark, sf):
    return rounded(P.colourise(X.pixels(spark, sf)))


@query(
    "gallery_rgba",
    f"""WITH {X.PX}, q AS (SELECT image_id, y, x, {", ".join(
        f"round_even(p_{c}, 0)::DOUBLE AS p_{c}" for c in S.CLASSES)} FROM px)
    SELECT image_id, y AS "row", x AS col, p_scar + p_necrosis AS cr, p_redness AS cg,
    p_hematoma AS cb, CASE WHEN p_scar + p_necrosis > 0 OR p_redness > 0 OR p_hematoma > 0
    THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS ca FROM q""",
)
def gallery_rgba(spark, sf):
    return rounded(P.gallery_rgba(P.binarise_round(X.pixels(spark, sf))))


@query(
    "rotate90",
    f"""WITH {X.PX} SELECT image_id, x::INT AS "row", (9 - y)::INT AS col, {rnd('r')} AS r,
    y::INT AS back_row, x::INT AS back_col FROM px""",
)
def rotate90(spark, sf):
    px = X.pixels(spark, sf)
    turned = P.rotate90(px.withColumns({"y0": F.col("row"), "x0": F.col("col")}), "cw")
    again = P.rotate90(
        turned.withColumns({"tr": F.col("row"), "tc": F.col("col")}), "ccw"
    )
    return rounded(
        again.select("image_id", F.col("tr").alias("row"), F.col("tc").alias("col"), "r",
                     F.col("row").alias("back_row"), F.col("col").alias("back_col"))
    )


@query(
    "restrict_region",
    f"""WITH {X.PX} SELECT px.image_id, y AS "row", x AS col, {rnd('r')} AS r
    FROM px JOIN embeddings e ON e.vec_id = px.image_id
    WHERE y BETWEEN greatest(1, least(label - 3, 8)) AND greatest(1, least(label + 2, 8))
    AND x BETWEEN 3 AND 8""",
)
def restrict_region(spark, sf):
    labels = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    px = X.pixels(spark, sf).join(labels, "image_id")
    kept = P.restrict_region(px, F.col("label") - 3, F.col("label") + 2, F.lit(3), F.lit(50))
    return rounded(kept.select("image_id", "row", "col", "r"))


@query(
    "brightness_histogram",
    f"""WITH {X.PX}, v AS (SELECT image_id, 0.299 * r + 0.587 * g + 0.114 * b AS v FROM px),
    lim AS (SELECT image_id, min(v) AS lo, (max(v) - min(v)) / 10 AS w, count(*) AS total
            FROM v GROUP BY image_id),
    n AS (SELECT v.image_id, least(floor((v - lo) / w), 9)::INT AS bin, count(*) AS n
          FROM v JOIN lim USING (image_id) GROUP BY ALL),
    f AS (SELECT image_id, lo, w, total, unnest(range(10))::INT AS bin FROM lim)
    SELECT f.image_id, f.bin, {rnd('lo + f.bin * w')} AS bin_start, coalesce(n.n, 0) AS n,
    {rnd('coalesce(n.n, 0) / (total * w)')} AS density
    FROM f LEFT JOIN n USING (image_id, bin)""",
)
def brightness_histogram(spark, sf):
    px = P.with_brightness(X.pixels(spark, sf).select("image_id", "r", "g", "b"))
    return rounded(stats.histogram(px, "brightness", 10, ["image_id"], "pdf"))


@query(
    "histogram_of_range",
    f"""WITH {X.PX}, v AS (SELECT image_id, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS v FROM px),
    c AS (SELECT 0.45::DOUBLE AS lo, 0.55::DOUBLE AS hi, (0.55::DOUBLE - 0.45::DOUBLE) / 4 AS w),
    n AS (SELECT image_id, CASE WHEN v < lo THEN -1 WHEN v > hi THEN 4 ELSE least(floor((v - lo) / w), 3) END::INT AS bin,
      count(*) AS n FROM v, c GROUP BY ALL),
    f AS (SELECT DISTINCT image_id, unnest(range(-1, 5))::INT AS bin FROM px)
    SELECT f.image_id, f.bin, {rnd('lo + f.bin * w')} AS bin_start, coalesce(n.n, 0) AS n
    FROM f LEFT JOIN n USING (image_id, bin), c WHERE n.n IS NOT NULL OR f.bin BETWEEN 0 AND 3""",
)
def histogram_of_range(spark, sf):
    """Bins of a range that most values lie outside of: those are counted below and above."""
    px = P.with_brightness(X.pixels(spark, sf).select("image_id", "r", "g", "b"))
    return rounded(stats.histogram(px, "brightness", 4, ["image_id"], "count", 0.45, 0.55))


@query(
    "hsv_profile",
    f"""WITH {X.PX}, lit AS (SELECT * FROM px WHERE r > 0 OR g > 0 OR b > 0), {X.hsv_ctes('lit')}
    SELECT image_id, {rnd('median(hue) * 360')} AS h_median_deg,
    {rnd('median(sat) * 100')} AS s_median_pct, {rnd('median(val) * 100')} AS v_median_pct,
    count(*) AS n_pixels FROM hsv GROUP BY image_id""",
)
def hsv_profile(spark, sf):
    return rounded(colours.hsv_profile(X.pixels(spark, sf).select("image_id", "r", "g", "b")))


_LCH_AGG = ", ".join(
    f"{rnd(f'median({m})')} AS {m}_median, {rnd(f'avg({m})')} AS {m}_mean" for m in "lch"
)
_FG_ROWS = " UNION ALL ".join(f"SELECT '{c}' AS class" for c in S.FOREGROUND_CLASSES)
CLASS_LCH_SQL = f"""
{X.PX}, {X.CLASS_LONG}, member AS (SELECT * FROM clong WHERE p > 0.5 AND class != 'background'),
{X.lch_ctes('member')},
measured AS (SELECT image_id, class, {_LCH_AGG}, count(*) AS pixel_count FROM lch
             GROUP BY image_id, class),
class_lch AS (SELECT i.image_id, k.class,
  {", ".join(f"m.{v}_{s}" for v in 'lch' for s in ('median', 'mean'))},
  coalesce(m.pixel_count, 0) AS pixel_count
  FROM (SELECT DISTINCT image_id FROM px) i CROSS JOIN ({_FG_ROWS}) k
  LEFT JOIN measured m ON m.image_id = i.image_id AND m.class = k.class)
"""


@query("class_lch", f"WITH {CLASS_LCH_SQL} SELECT * FROM class_lch")
def class_lch(spark, sf):
    return rounded(colours.class_lch(X.pixels(spark, sf)))


@query(
    "mask_lch",
    f"""WITH {X.PX}, m AS (SELECT * FROM px WHERE p_background > 0.3), {X.lch_ctes('m')},
    s AS (SELECT image_id, {_LCH_AGG}, count(*) AS pixel_count FROM lch GROUP BY image_id)
    SELECT i.image_id, {", ".join(f"{v}_{k}" for v in 'lch' for k in ('median', 'mean'))},
    coalesce(pixel_count, 0) AS pixel_count, 'polygon_region' AS class
    FROM (SELECT DISTINCT image_id FROM px) i LEFT JOIN s USING (image_id)""",
)
def mask_lch(spark, sf):
    px = X.pixels(spark, sf)
    mask = P.in_mask("any_over_0.1", *[
        F.when(F.col("p_background") > 0.3, 1.0).otherwise(0.0) for _ in "rgb"])
    return rounded(colours.mask_lch(px, mask))


@query(
    "mask_lch_circular",
    f"""WITH {X.PX}, m AS (SELECT * FROM px WHERE p_background > 0.2), {X.lch_ctes('m')},
    s AS (SELECT image_id, avg(cos(radians(h))) AS u, avg(sin(radians(h))) AS v, count(*) AS pixel_count FROM lch GROUP BY image_id),
    d AS (SELECT *, CASE WHEN sqrt(u * u + v * v) > 1e-9 THEN degrees(atan2(v, u)) END AS deg FROM s)
    SELECT i.image_id, {rnd('CASE WHEN deg < 0 THEN deg + 360 ELSE deg END')} AS h_mean, coalesce(pixel_count, 0) AS pixel_count
    FROM (SELECT DISTINCT image_id FROM px) i LEFT JOIN d USING (image_id)""",
)
def mask_lch_circular(spark, sf):
    """Mean hue as a direction: hues on both sides of red do not meet in the middle of the circle."""
    measured = colours.mask_lch(X.pixels(spark, sf), F.col("p_background") > 0.2, hue="circular")
    return rounded(measured.select("image_id", "h_mean", "pixel_count"))


_WHITE = f"""
lit AS (SELECT image_id, {X.lin('r')} AS r, {X.lin('g')} AS g, {X.lin('b')} AS b FROM px
        WHERE (r > 0.01 OR g > 0.01 OR b > 0.01) AND r >= 0.5),
med AS (SELECT image_id, median(r) AS r, median(g) AS g, median(b) AS b, count(*) AS n FROM lit
        GROUP BY image_id),
white AS (SELECT i.image_id,
  coalesce(0.4124564 * r + 0.3575761 * g + 0.1804375 * b, 0.95047) AS wx,
  coalesce(0.2126729 * r + 0.7151522 * g + 0.0721750 * b, 1.0) AS wy,
  coalesce(0.0193339 * r + 0.1191920 * g + 0.9503041 * b, 1.08883) AS wz,
  coalesce(n, 0) AS n FROM (SELECT DISTINCT image_id FROM px) i LEFT JOIN med USING (image_id))
"""
_D = {n: f"sqrt(pow(wx - {w[0]}, 2) + pow(wy - {w[1]}, 2) + pow(wz - {w[2]}, 2))"
      for n, w in colour.ILLUMINANTS.items()}


@query(
    "white_point",
    f"""WITH {X.PX}, {_WHITE} SELECT image_id, {rnd('wx')} AS white_x, {rnd('wy')} AS white_y,
    {rnd('wz')} AS white_z, n AS white_pixels,
    {rnd('CASE WHEN wy > 0 THEN wx / wy ELSE wx END')} AS norm_x,
    {rnd('CASE WHEN wy > 0 THEN wz / wy ELSE wz END')} AS norm_z,
    CASE WHEN {_D['D65']} < 0.1 THEN 'balanced' WHEN {_D['A']} < {_D['D65']} THEN 'warm'
    ELSE 'non-standard' END AS lighting FROM white""",
)
def white_point(spark, sf):
    px = X.pixels(spark, sf).select("image_id", "r", "g", "b")
    ruler = px.withColumns({c: F.when(F.col("r") >= 0.5, F.col(c)).otherwise(0.0) for c in "gb"})
    ruler = ruler.withColumn("r", F.when(F.col("r") >= 0.5, F.col("r")).otherwise(0.0))
    white = colours.white_point(ruler)
    xyz = [F.col(f"white_{n}") for n in "xyz"]
    nx, _, nz = colour.normalise_white(*xyz)
    return rounded(
        white.withColumns(
            {"norm_x": nx, "norm_z": nz, "lighting": colour.lighting_type(*xyz)}
        )
    )


def _balanced_ctes(ref: str) -> str:
    """CTEs: one gain matrix per image, then balanced pixels ``bal``."""
    rx, ry, rz = colour.ILLUMINANTS[ref]
    brad = colour.BRADFORD
    gains = []
    for i, row in enumerate(brad):
        target = row[0] * rx + row[1] * ry + row[2] * rz
        source = f"({row[0]} * wx + {row[1]} * wy + {row[2]} * wz)"
        gains.append(
            f"CASE WHEN abs({source}) > 1e-10 THEN {target!r} / {source} ELSE 1.0 END AS k{i}"
        )
    left = colour.mat_mul(colour.XYZ_TO_SRGB, colour.BRADFORD_INVERSE)
    right = colour.mat_mul(colour.BRADFORD, colour.SRGB_TO_XYZ)
    cells = []
    for i in range(3):
        for j in range(3):
            terms = " + ".join(f"({left[i][k] * right[k][j]!r}::DOUBLE) * k{k}" for k in range(3))
            cells.append(f"{terms} AS m{i}{j}")
    comp = []
    for i, c in enumerate("rgb"):
        v = f"greatest(0.0, m{i}0 * lr + m{i}1 * lg + m{i}2 * lb)"
        enc = f"(CASE WHEN {v} <= 0.0031308 THEN 12.92 * {v} ELSE 1.055 * pow({v}, 1.0/2.4) - 0.055 END)"
        comp.append(
            f"CASE WHEN r = 0 AND g = 0 AND b = 0 THEN 0.0 ELSE"
            f" least(1.0, greatest(0.0, {enc})) END AS {c}"
        )
    return f"""
gain AS (SELECT image_id, {", ".join(gains)} FROM white),
mat AS (SELECT image_id, {", ".join(cells)} FROM gain),
lpx AS (SELECT px.*, {X.lin('r')} AS lr, {X.lin('g')} AS lg, {X.lin('b')} AS lb FROM px),
bal AS (SELECT lpx.image_id, y, x, {", ".join(comp)} FROM lpx JOIN mat USING (image_id))
"""


@query(
    "white_balance",
    f"""WITH {X.PX}, {_WHITE}, {_balanced_ctes('D50')}
    SELECT image_id, y AS "row", x AS col, {rnd_as('r', 'g', 'b')} FROM bal""",
)
def white_balance(spark, sf):
    px = X.pixels(spark, sf).select("image_id", "row", "col", "r", "g", "b")
    ruler = P.apply_mask(px, F.col("r") >= 0.5)
    return rounded(colours.white_balance(px, colours.white_point(ruler), "D50"))


@query(
    "balance_report",
    f"""WITH {X.PX}, {_WHITE}, {_balanced_ctes('D65')},
    ph AS (SELECT image_id, y, x, r, g, b, 'before' AS phase FROM px UNION ALL
           SELECT image_id, y, x, r, g, b, 'after' FROM bal),
    sc AS (SELECT *, 'full' AS scope FROM ph UNION ALL
           SELECT *, 'region' FROM ph WHERE y BETWEEN 2 AND 6),
    lt AS (SELECT * FROM sc WHERE r > 0 OR g > 0 OR b > 0), {X.hsv_ctes('lt')}
    SELECT image_id, phase, scope, {rnd('median(hue) * 360')} AS h_median_deg,
    {rnd('median(sat) * 100')} AS s_median_pct, {rnd('median(val) * 100')} AS v_median_pct,
    count(*) AS n_pixels FROM hsv GROUP BY image_id, phase, scope""",
)
def balance_report(spark, sf):
    px = X.pixels(spark, sf).select("image_id", "row", "col", "r", "g", "b")
    return rounded(
        colours.balance_report(px, F.col("r") >= 0.5, F.col("row").between(2, 6), "D65")
    )


@query(
    "balance_histograms",
    f"""WITH {X.PX}, {_WHITE}, {_balanced_ctes('D65')},
    ph AS (SELECT image_id, y, x, r, g, b, 'before' AS phase FROM px UNION ALL
           SELECT image_id, y, x, r, g, b, 'after' FROM bal),
    sc AS (SELECT *, 'full' AS scope FROM ph UNION ALL
           SELECT *, 'region' FROM ph WHERE y BETWEEN 2 AND 6),
    lt AS (SELECT * FROM sc WHERE r > 0 OR g > 0 OR b > 0), {X.hsv_ctes('lt')},
    v AS (SELECT image_id, phase, scope, 'hue' AS component, hue AS v FROM hsv UNION ALL
          SELECT image_id, phase, scope, 'sat', sat FROM hsv UNION ALL
          SELECT image_id, phase, scope, 'val', val FROM hsv),
    k AS (SELECT image_id, phase, scope, component, count(*) AS total FROM v GROUP BY ALL),
    n AS (SELECT image_id, phase, scope, component,
          least(floor(v / (1.0::DOUBLE / 50)), 49)::INT AS bin, count(*) AS n FROM v GROUP BY ALL),
    f AS (SELECT k.*, unnest(range(50))::INT AS bin FROM k)
    SELECT f.image_id, f.phase, f.scope, f.component, f.bin,
    {rnd('f.bin * (1.0::DOUBLE / 50)')} AS bin_start, coalesce(n.n, 0) AS n,
    {rnd('coalesce(n.n, 0) / (total * (1.0::DOUBLE / 50))')} AS density
    FROM f LEFT JOIN n USING (image_id, phase, scope, component, bin)""",
)
def balance_histograms(spark, sf):
    px = X.pixels(spark, sf).select("image_id", "row", "col", "r", "g", "b")
    return rounded(
        colours.balance_histograms(px, F.col("r") >= 0.5, F.col("row").between(2, 6), "D65")
    )


def _adapt_sql() -> str:
    brad, inv = colour.BRADFORD, colour.BRADFORD_INVERSE
    src, ref = colour.ILLUMINANTS["A"], colour.ILLUMINANTS["D50"]
    out = []
    for n, inv_row in zip("xyz", inv):
        terms = []
        for k, row in enumerate(brad):
            gain = sum(row[i] * ref[i] for i in range(3)) / sum(row[i] * src[i] for i in range(3))
            terms.append(
                f"{inv_row[k] * gain!r}::DOUBLE * ({row[0]} * px_x + {row[1]} * px_y + {row[2]} * px_z)"
            )
        out.append(f"{rnd(' + '.join(terms))} AS {n}")
    return ", ".join(out)


@query(
    "adapt_colour",
    f"""WITH c AS (SELECT vec_id, abs(embedding[1])::DOUBLE AS px_x, abs(embedding[2])::DOUBLE AS px_y,
    abs(embedding[3])::DOUBLE AS px_z FROM embeddings) SELECT vec_id, {_adapt_sql()} FROM c""",
)
def adapt_colour(spark, sf):
    e = X.table(spark, sf, "embeddings")
    xyz = [F.abs(F.get("embedding", F.lit(i)).cast("double")) for i in range(3)]
    src = colour.illuminant_case(F.lit("A"))
    ref = colour.illuminant_case(F.lit("D50"))
    moved = colour.adapt_colour(xyz, src, ref)
    return rounded(e.select("vec_id", *[v.alias(n) for n, v in zip("xyz", moved)]))


# Public CIE whites of the reference illuminants, Y = 1.
_WHITES = """w(i, name, x, y, z) AS (VALUES (0, 'D65', 0.95047, 1.0, 1.08883), (1, 'D50', 0.96422, 1.0, 0.82521),
    (2, 'A', 1.0985, 1.0, 0.35585), (3, 'D55', 0.95682, 1.0, 0.92149), (4, 'D75', 0.94972, 1.0, 1.22638),
    (5, 'E', 1.0, 1.0, 1.0), (6, 'F2', 0.99187, 1.0, 0.67395), (7, 'F7', 0.95044, 1.0, 1.08755),
    (8, 'F11', 1.00966, 1.0, 0.6437), (9, 'none', NULL, NULL, NULL))"""


@query(
    "reference_whites",
    f"""WITH {_WHITES} SELECT vec_id, name, {rnd_as('x', 'y', 'z')},
    {rnd('abs(embedding[1])::DOUBLE * x')} AS scaled FROM embeddings JOIN w ON i = vec_id % 10""",
)
def reference_whites(spark, sf):
    """Each picture with one of the nine whites, or a name that is none of them."""
    names = F.array(*[F.lit(n) for n in ("D65", "D50", "A", "D55", "D75", "E", "F2", "F7", "F11", "none")])
    e = X.table(spark, sf, "embeddings").withColumn("name", F.get(names, (F.col("vec_id") % 10).cast("int")))
    white = colour.illuminant_case(F.col("name"))
    first = F.abs(F.get("embedding", F.lit(0)).cast("double"))
    return rounded(e.select("vec_id", "name", *[v.alias(n) for n, v in zip("xyz", white, strict=True)], (first * white[0]).alias("scaled")))


# ---- metrics -----------------------------------------------------------------------------------

_LOGITS = "[r * 4, g * 4, b * 4, p_scar * 3, (1.0 - r) * 4]"
_TRUTH = "[" + ", ".join(f"round_even(p_{c}, 0)::DOUBLE" for c in S.CLASSES) + "]"
PRED = f"""
{X.PX}, q AS (SELECT image_id, y, x, height, width, {_LOGITS} AS z, {_TRUTH} AS t FROM px),
ql AS (SELECT image_id, y, x, unnest(z) AS z, unnest(t) AS t, unnest(range(5)) AS k FROM q),
sm AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY image_id, y, x) AS p FROM ql)
"""
_W = [0.5, 1.0, 1.5, 2.0, 0.25]
_WSQL = "([" + ", ".join(map(str, _W)) + "])[k + 1]"
_EPS = repr(metrics.EPSILON)


@query(
    "cross_entropy",
    f"""WITH {PRED}, s AS (SELECT image_id, y, x, sum(-t * ln(p + {_EPS})) AS ce,
      sum(-t * ln(p + {_EPS}) * {_WSQL}) AS wce,
      sum(-t * ln(p + {_EPS}) * {_WSQL} * pow(1 - p, 2.0)) AS fce,
      sum(pow(z - t, 2)) AS qe FROM sm GROUP BY ALL)
    SELECT image_id, {rnd('avg(ce)')} AS cross_entropy, {rnd('avg(wce)')} AS weighted_cross_entropy,
    {rnd('avg(fce)')} AS focal_cross_entropy, {rnd('sum(qe)')} AS quadratic_error
    FROM s GROUP BY image_id""",
)
def cross_entropy(spark, sf):
    wanted = {
        "cross_entropy": metrics.plain_entropy(),
        "weighted_cross_entropy": metrics.weighted_entropy(_W),
        "focal_cross_entropy": metrics.focal_entropy(_W, 2.0),
        "quadratic_error": metrics.squares(),
    }
    return rounded(metrics.evaluate(X.predictions(spark, sf), 5, wanted, ["image_id"]))


@query(
    "custom_metrics",
    f"""WITH {PRED}, s AS (SELECT image_id, y, x, sum(pow(p - t, 2)) AS brier, arg_max(t, (p, -k)) AS found,
      max(p) AS sure FROM sm GROUP BY ALL)
    SELECT image_id, {rnd('avg(brier)')} AS brier, {rnd('avg((found > 0.5)::INT)')} AS accuracy,
    {rnd('max(sure)')} AS surest FROM s GROUP BY image_id""",
)
def custom_metrics(spark, sf):
    """A user's own metrics beside each other in one pass: Brier score, accuracy, largest probability."""
    def hit(p, y, z):
        best = F.greatest(*p)
        return F.coalesce(*[F.when(a == best, (b > 0.5).cast("int")) for a, b in zip(p, y, strict=True)])

    own = {
        "brier": metrics.Metric(lambda p, y, z: sum(F.pow(a - b, 2) for a, b in zip(p, y, strict=True))),
        "accuracy": metrics.Metric(hit),
        "surest": metrics.Metric(lambda p, y, z: F.greatest(*p), F.max),
    }
    return rounded(metrics.evaluate(X.predictions(spark, sf), 5, own, ["image_id"]))


_CONF = """
conf AS (SELECT {key}class, count(*) FILTER (hit AND real) AS tp,
  count(*) FILTER (NOT hit AND NOT real) AS tn, count(*) FILTER (hit AND NOT real) AS fp,
  count(*) FILTER (NOT hit AND real) AS fn FROM o GROUP BY {key}class)
"""
_OUT = f"""o AS (SELECT image_id, (['{"','".join(S.CLASSES)}'])[k + 1] AS class, p > 0.5 AS hit,
      t > 0.5 AS real FROM sm)"""


@query("confusion", f"WITH {PRED}, {_OUT}, {_CONF.format(key='')} SELECT * FROM conf")
def confusion(spark, sf):
    return metrics.confusion(X.predictions(spark, sf), S.CLASSES)


@query(
    "iou_loss",
    f"""WITH {PRED}, {_OUT}, {_CONF.format(key='image_id, ')},
    a AS (SELECT image_id, class,
      CASE WHEN tp + fp + fn > 0 THEN 1 - tp / (tp + fp + fn) ELSE 1 END AS iou_loss,
      CASE WHEN tn = 0 THEN 1 - tp / (tp + fp + fn) ELSE 1 END AS elementwise FROM conf)
    SELECT image_id, class, {rnd('iou_loss')} AS iou_loss, {rnd('elementwise')} AS elementwise
    FROM a""",
)
def iou_loss(spark, sf):
    return rounded(metrics.iou_losses(X.predictions(spark, sf), S.CLASSES, keys=["image_id"]))


@query(
    "validation_score",
    f"""WITH {PRED}, {_OUT}, {_CONF.format(key='image_id, ')},
    a AS (SELECT image_id, sum(CASE WHEN tp + fp + fn > 0 THEN 1 - tp / (tp + fp + fn) ELSE 1 END)
      AS loss FROM conf GROUP BY image_id) SELECT {rnd('avg(loss)')} AS score FROM a""",
)
def validation_score(spark, sf):
    return rounded(metrics.validation_score(X.predictions(spark, sf), S.CLASSES))


@query(
    "document_quality_metrics",
    f"""WITH d AS (SELECT source, quality::DOUBLE AS q, ln(n_chars + 1.0) - 6.0 AS z
      FROM documents JOIN labels USING (doc_id)),
    s AS (SELECT *, exp(z) / (exp(z) + exp(-z)) AS p FROM d),
    c AS (SELECT source, {rnd(f'avg(-q * ln(p + {_EPS}) - (1 - q) * ln(1 - p + {_EPS}))')} AS cross_entropy,
      count(*) FILTER (p > 0.5 AND q > 0.5) AS gg, count(*) FILTER (p <= 0.5 AND q <= 0.5) AS bb,
      count(*) FILTER (p > 0.5 AND q <= 0.5) AS gb, count(*) FILTER (p <= 0.5 AND q > 0.5) AS bg
      FROM s GROUP BY source)
    SELECT source, 'good' AS class, cross_entropy, gg AS tp, bb AS tn, gb AS fp, bg AS fn FROM c
    UNION ALL SELECT source, 'bad', cross_entropy, bb, gg, bg, gb FROM c""",
)
def document_quality_metrics(spark, sf):
    df = X.label_predictions(spark, sf)
    ce = metrics.cross_entropy(df, 2, ["source"])
    conf = metrics.confusion(df, ("good", "bad"), keys=["source"])
    return rounded(ce.join(conf, "source"))


@query(
    "tiles",
    f"""WITH {X.PX} SELECT image_id, ((y - 1) // 3)::INT AS tile_row, ((x - 1) // 3)::INT AS tile_col,
    count(*) AS n, {rnd('sum(r)')} AS r_sum, max((y - 1) % 3 + 1)::INT AS last_row FROM px
    WHERE ((y - 1) // 3 + 1) * 3 <= 8 AND ((x - 1) // 3 + 1) * 3 <= 8 GROUP BY ALL""",
)
def tiles(spark, sf):
    tiled = metrics.tile(X.pixels(spark, sf), 3, 3, complete_only=True)
    return rounded(
        tiled.groupBy("image_id", "tile_row", "tile_col").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("r").alias("r_sum"),
            F.max("in_row").alias("last_row"),
        )
    )


@query(
    "patch_scores",
    f"""WITH {PRED}, s AS (SELECT image_id, y, x, sum(-t * ln(p + {_EPS}) * {_WSQL}) AS wce
      FROM sm GROUP BY ALL),
    p AS (SELECT image_id, (y - 1) // 4 AS a, (x - 1) // 4 AS b, avg(wce) AS v FROM s GROUP BY ALL)
    SELECT image_id, count(*) AS n_patches, {rnd('sum(v)')} AS score FROM p GROUP BY image_id""",
)
def patch_scores(spark, sf):
    return rounded(metrics.patch_scores(X.predictions(spark, sf), 4, _W))


# ---- lineage reports -------------------------------------------------------------------------


@query(
    "augmentation_summary",
    f"""WITH {X.LINEAGE} SELECT count(*) AS n_samples,
    count(DISTINCT source_index) AS n_sources_used,
    {", ".join(f"{rnd(f'{f}({c})') if c not in ('size_multiplier', 'patch_height', 'patch_width') else f'{f}({c})::INT'} AS {f}_{c}"
               for f in ('min', 'max') for c in reports.RANGED)},
    {", ".join(f"count(*) FILTER (target_class = '{c}') AS n_{c}" for c in S.CLASSES)},
    {", ".join(f"{rnd(f'avg({c}_percentage)')} AS mean_{c}_percentage" for c in S.CLASSES)},
    {rnd('avg(size_multiplier)')} AS mean_multiplier, {rnd('avg(growth_iterations)')} AS mean_iterations,
    {rnd('avg(actual_fg_percentage)')} AS mean_fg_percentage,
    count(*) FILTER (max_size_reached) AS n_max_size,
    {rnd('count(*) FILTER (max_size_reached) / count(*) * 100')} AS pct_max_size FROM lineage""",
)
def augmentation_summary(spark, sf):
    return rounded(reports.augmentation_summary(X.lineage(spark, sf)))


@query(
    "source_usage",
    f"WITH {X.LINEAGE} SELECT source_index, count(*) AS uses FROM lineage GROUP BY source_index",
)
def source_usage(spark, sf):
    return reports.source_usage(X.lineage(spark, sf))


_DIST = " UNION ALL ".join(
    f"SELECT '{c}' AS class, {p} AS pct" for c, p in reports.DEFAULT_DISTRIBUTION.items()
)


@query(
    "target_vs_actual",
    f"""WITH {X.LINEAGE}, d AS ({_DIST}), n AS (SELECT count(*) AS n FROM lineage)
    SELECT class, round_even(n * pct / 100.0, 0)::BIGINT AS target,
    (SELECT count(*) FROM lineage WHERE target_class = d.class) AS actual FROM d, n""",
)
def target_vs_actual(spark, sf):
    return reports.target_vs_actual(X.lineage(spark, sf))


_LLONG = "ll AS (" + " UNION ALL ".join(
    f"SELECT target_class, '{c}' AS class, {c}_percentage AS v FROM lineage" for c in S.CLASSES
) + ")"


@query(
    "coverage_spread",
    f"""WITH {X.LINEAGE}, {_LLONG} SELECT class, {rnd('avg(v)')} AS mean_pct,
    {rnd('stddev_samp(v)')} AS std_pct, {rnd('min(v)')} AS min_pct, {rnd('max(v)')} AS max_pct
    FROM ll GROUP BY class""",
)
def coverage_spread(spark, sf):
    return rounded(reports.coverage_spread(X.lineage(spark, sf)))


@query(
    "coverage_by_target",
    f"""WITH {X.LINEAGE}, {_LLONG} SELECT class,
    {rnd('coalesce(avg(v) FILTER (target_class = class), 0)')} AS coverage FROM ll GROUP BY class""",
)
def coverage_by_target(spark, sf):
    return rounded(reports.coverage_by_target(X.lineage(spark, sf)))


@query(
    "growth_stats",
    f"""WITH {X.LINEAGE}, k AS (SELECT 'multiplier' AS kind, size_multiplier AS value FROM lineage
      UNION ALL SELECT 'iterations', growth_iterations FROM lineage)
    SELECT kind, value::INT AS value, count(*) AS n,
    {rnd('count(*) / sum(count(*)) OVER (PARTITION BY kind) * 100')} AS pct FROM k GROUP BY kind, value""",
)
def growth_stats(spark, sf):
    return rounded(reports.growth_stats(X.lineage(spark, sf)))


@query(
    "stacked_composition",
    f"""WITH {X.LINEAGE}, {"c AS (" + " UNION ALL ".join(
        f"SELECT augmented_index, {i} AS class_index, '{c}' AS class, "
        + " + ".join(f"{k}_percentage" for k in S.CLASSES[:i]) + " AS v FROM lineage"
        for i, c in enumerate(S.CLASSES, start=1)) + ")"}
    SELECT augmented_index, class_index, class, count(*) AS n, {rnd('max(v)')} AS upper
    FROM c GROUP BY ALL""",
)
def stacked_composition(spark, sf):
    stacked = reports.stacked_composition(X.lineage(spark, sf))
    return rounded(
        stacked.groupBy("augmented_index", "class_index", "class").agg(
            F.count(F.lit(1)).alias("n"), F.max("upper").alias("upper")
        )
    )


@query(
    "parameter_histograms",
    f"""WITH {X.LINEAGE}, v AS (SELECT 'rotation_angle' AS parameter, rotation_angle AS v, 36 AS k
      FROM lineage UNION ALL SELECT 'size_multiplier', size_multiplier, 4 FROM lineage),
    lim AS (SELECT parameter, min(k) AS k, min(v) AS lo, (max(v) - min(v)) / min(k) AS w
      FROM v GROUP BY parameter),
    n AS (SELECT v.parameter, least(floor((v - lo) / w), v.k - 1)::INT AS bin, count(*) AS n
      FROM v JOIN lim USING (parameter) GROUP BY ALL),
    f AS (SELECT parameter, lo, w, unnest(range(k))::INT AS bin FROM lim)
    SELECT f.parameter, f.bin, {rnd('lo + f.bin * w')} AS bin_start, coalesce(n.n, 0) AS n
    FROM f LEFT JOIN n USING (parameter, bin)""",
)
def parameter_histograms(spark, sf):
    bins = {"rotation_angle": 36, "size_multiplier": 4}
    return rounded(reports.parameter_histograms(X.lineage(spark, sf), bins))
