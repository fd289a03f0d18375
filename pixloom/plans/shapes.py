"""Registered queries: geometry, morphology, components, polygons, warping."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixloom import schema as S
from pixloom.functions import geometry as G
from pixloom.operators import colours, components as C, morphology as M, pixels as P
from pixloom.operators import polygons as PG, resample, stats, warp
from pixloom.plans import proxies as X
from pixloom.plans.registry import query, rnd, rnd_as, rounded

MASK = "r > 0.5"


def _mask_px(spark, sf):
    px = X.pixels(spark, sf)
    return px.select("image_id", "row", "col", (F.col("r") > 0.5).alias("m"))


_MPX = f"mpx AS (SELECT image_id, y, x, {MASK} AS m FROM px)"


def _morph(op: str, source: str, out: str, k: int) -> str:
    """CTE for one dilation or erosion by brute force over the neighbourhood."""
    test = (
        "bool_or(b.m)" if op == "dilate" else f"bool_and(b.m) AND count(*) = {(2 * k + 1) ** 2}"
    )
    return f"""{out} AS (SELECT a.image_id, a.y, a.x, {test} AS m FROM {source} a JOIN {source} b
    ON a.image_id = b.image_id AND b.y BETWEEN a.y - {k} AND a.y + {k}
    AND b.x BETWEEN a.x - {k} AND a.x + {k} GROUP BY a.image_id, a.y, a.x)"""


_OUT = 'SELECT image_id, y AS "row", x AS col, m'


@query("dilate", f"WITH {X.PX}, {_MPX}, {_morph('dilate', 'mpx', 'd', 1)} {_OUT} FROM d")
def dilate(spark, sf):
    return M.dilate(_mask_px(spark, sf), "m", 1)


@query("erode", f"WITH {X.PX}, {_MPX}, {_morph('erode', 'mpx', 'd', 1)} {_OUT} FROM d")
def erode(spark, sf):
    return M.erode(_mask_px(spark, sf), "m", 1)


@query(
    "close",
    f"""WITH {X.PX}, {_MPX}, {_morph('dilate', 'mpx', 'd', 2)}, {_morph('erode', 'd', 'e', 2)}
    {_OUT} FROM e""",
)
def close(spark, sf):
    return M.close(_mask_px(spark, sf), "m", 2)


@query(
    "open",
    f"""WITH {X.PX}, {_MPX}, {_morph('erode', 'mpx', 'd', 1)}, {_morph('dilate', 'd', 'e', 1)}
    {_OUT} FROM e""",
)
def open_(spark, sf):
    return M.open_(_mask_px(spark, sf), "m", 1)


@query(
    "contour",
    f"""WITH {X.PX}, {_MPX}, n AS (SELECT a.image_id, a.y, a.x, any_value(a.m) AS m,
      count(*) FILTER (b.m AND abs(a.y - b.y) + abs(a.x - b.x) = 1) AS k FROM mpx a JOIN mpx b
      ON a.image_id = b.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1
      GROUP BY a.image_id, a.y, a.x)
    SELECT image_id, y AS "row", x AS col, m, m AND k < 4 AS contour FROM n""",
)
def contour(spark, sf):
    return M.contour(_mask_px(spark, sf), "m")


_LOCAL = f"""bp AS (SELECT image_id, y, x, 0.299 * r + 0.587 * g + 0.114 * b AS v FROM px),
loc AS (SELECT a.image_id, a.y, a.x, any_value(a.v) AS v, avg(b.v) AS mu FROM bp a JOIN bp b
  ON a.image_id = b.image_id AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2
  GROUP BY a.image_id, a.y, a.x)"""


@query(
    "local_mean",
    f"""WITH {X.PX}, {_LOCAL} SELECT image_id, y AS "row", x AS col, {rnd('mu')} AS local_mean FROM loc""",
)
def local_mean(spark, sf):
    px = P.with_brightness(X.pixels(spark, sf)).select("image_id", "row", "col", "brightness")
    return rounded(M.local_mean(px, "brightness", 5).drop("brightness"))


@query(
    "adaptive_threshold",
    f"""WITH {X.PX}, {_LOCAL} SELECT image_id, y AS "row", x AS col,
    v > mu + 0.05 AND v > 0.5 AS adaptive FROM loc""",
)
def adaptive_threshold(spark, sf):
    px = P.with_brightness(X.pixels(spark, sf)).select("image_id", "row", "col", "brightness")
    return M.adaptive_threshold(px, "brightness", 5, 0.05, 0.5).drop("brightness")


# ---- components ----------------------------------------------------------------------------------


def _components(source: str, reach: str, key: str = "image_id") -> str:
    """CTEs labelling the true pixels of ``source`` by transitive closure."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in key.split(", "))
    akey = ", ".join(f"a.{k}" for k in key.split(", "))
    return f"""
cell AS (SELECT {key}, y, x, x * 1000 + y AS id FROM {source}),
near AS (SELECT {akey}, a.id AS p, b.id AS q FROM cell a JOIN cell b ON {same} AND {reach}),
walk AS (SELECT {key}, id AS node, id AS seen FROM cell
  UNION SELECT {", ".join(f"walk.{k}" for k in key.split(", "))}, walk.node, near.q FROM walk
  JOIN near ON {" AND ".join(f"walk.{k} = near.{k}" for k in key.split(", "))} AND walk.seen = near.p),
root AS (SELECT {key}, node, min(seen) AS first FROM walk GROUP BY {key}, node),
lab AS (SELECT {key}, (node % 1000)::INT AS y, (node // 1000)::INT AS x,
  dense_rank() OVER (PARTITION BY {key} ORDER BY first) AS label FROM root)
"""


_FOUR = "abs(a.y - b.y) + abs(a.x - b.x) = 1"
_EIGHT = "greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1"
_ON = f"lit AS (SELECT image_id, y, x FROM px WHERE {MASK})"
_MOM = """
agg AS (SELECT {key}, label, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS sy, sum(x)::DOUBLE AS sx,
  sum(y * y)::DOUBLE AS syy, sum(x * x)::DOUBLE AS sxx, sum(y * x)::DOUBLE AS sxy {extra}
  FROM lab {join} GROUP BY {key}, label),
ax AS (SELECT *, sy / n AS cy, sx / n AS cx, 0.5 * atan2(2 * (n * sxy - sy * sx),
  (n * sxx - sx * sx) - (n * syy - sy * sy)) AS th FROM agg),
pr AS (SELECT {lkey}, lab.label, (y - cy) * sin(th) + (x - cx) * cos(th) AS a,
  (y - cy) * cos(th) - (x - cx) * sin(th) AS b FROM lab JOIN ax USING ({key}, label)),
ex AS (SELECT {key}, label, min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM pr
  GROUP BY {key}, label),
bx AS (SELECT ax.*, a0, a1, b0, b1, CASE WHEN a1 - a0 < 1e-9 THEN 0 ELSE a1 - a0 END AS width,
  CASE WHEN b1 - b0 < 1e-9 THEN 0 ELSE b1 - b0 END AS height FROM ax JOIN ex USING ({key}, label)),
box AS (SELECT *, least(width, height) <= 0 AS degenerate,
  CASE WHEN least(width, height) > 0 THEN greatest(width, height) / least(width, height) ELSE 1 END
    AS aspect_ratio, CASE WHEN least(width, height) > 0 THEN n / (width * height) ELSE 0 END AS density
  FROM bx)
"""


def _boxes(key: str = "image_id", extra: str = "", join: str = "") -> str:
    lkey = ", ".join(f"lab.{k}" for k in key.split(", "))
    return _MOM.format(key=key, lkey=lkey, extra=extra, join=join)


def _labelled(spark, sf, connectivity=4):
    px = X.pixels(spark, sf).where(F.col("r") > 0.5).select("image_id", "row", "col")
    return C.label_components(px, connectivity)


@query(
    "components",
    f"""WITH RECURSIVE {X.PX}, {_ON}, {_components('lit', _FOUR)}
    SELECT image_id, y AS "row", x AS col, label FROM lab""",
)
def components(spark, sf):
    return _labelled(spark, sf)


@query(
    "components_8_connected",
    f"""WITH RECURSIVE {X.PX}, {_ON}, {_components('lit', _EIGHT)}
    SELECT image_id, y AS "row", x AS col, label FROM lab""",
)
def components_8_connected(spark, sf):
    return _labelled(spark, sf, 8)


_ACROSS = 64  # pictures in a row of a mosaic, and rows of it
_MOSAIC = f"""lit AS (SELECT image_id // {_ACROSS * _ACROSS} AS image_id,
  (image_id % {_ACROSS * _ACROSS} // {_ACROSS} * {X.SIDE} + y)::INT AS y, (image_id % {_ACROSS} * {X.SIDE} + x)::INT AS x
  FROM px WHERE r > 0.55)"""


def mosaic_pixels(spark, sf):
    """Pictures laid side by side into mosaics of up to 512 x 512 pixels."""
    px, per = X.pixels(spark, sf), _ACROSS * _ACROSS
    at = F.col("image_id") % per
    return px.withColumns(
        {
            "row": (F.floor(at / _ACROSS) * X.SIDE + F.col("row")).cast("int"),
            "col": (at % _ACROSS * X.SIDE + F.col("col")).cast("int"),
            "image_id": F.floor(F.col("image_id") / per),
        }
    )


@query(
    "mosaic_components",
    f"""WITH RECURSIVE {X.PX}, {_MOSAIC}, {_components('lit', _FOUR)}
    SELECT image_id, y AS "row", x AS col, label FROM lab""",
)
def mosaic_components(spark, sf):
    """Regions that cross the borders of tiles."""
    lit = mosaic_pixels(spark, sf).where("r > 0.55").select("image_id", "row", "col")
    return C.label_components(lit)


@query(
    "component_stats",
    f"""WITH RECURSIVE {X.PX}, {_ON}, {_components('lit', _FOUR)}
    SELECT image_id, label, count(*) AS size, {rnd('avg(y)')} AS centroid_row,
    {rnd('avg(x)')} AS centroid_col, min(y) AS r_min, max(y) AS r_max, min(x) AS c_min, max(x) AS c_max
    FROM lab GROUP BY image_id, label HAVING count(*) >= 3""",
)
def component_stats(spark, sf):
    return rounded(C.component_stats(_labelled(spark, sf), 3))


@query(
    "renumber_labels",
    f"""WITH RECURSIVE {X.PX}, {_ON}, {_components('lit', _FOUR)}
    SELECT image_id, y AS "row", x AS col, label FROM lab""",
)
def renumber_labels(spark, sf):
    shuffled = _labelled(spark, sf).withColumn("label", 1000 - F.col("label"))
    return C.renumber_labels(shuffled).select("image_id", "row", "col", "label")


_BOX_COLS = ("centroid_row", "centroid_col", "angle", "width", "height", "aspect_ratio", "density")
_BOX_SQL = f"""image_id, label, n::BIGINT AS size, {rnd('cy')} AS centroid_row,
{rnd('cx')} AS centroid_col, {rnd('th')} AS angle, {rnd('width')} AS width,
{rnd('height')} AS height, {rnd('aspect_ratio')} AS aspect_ratio, {rnd('density')} AS density,
degenerate"""


@query(
    "oriented_boxes",
    f"""WITH RECURSIVE {X.PX}, {_ON}, {_components('lit', _FOUR)}, {_boxes()}
    SELECT {_BOX_SQL}, {rnd('cy + a1 * sin(th) + b1 * cos(th)')} AS corner_row,
    {rnd('cx + a1 * cos(th) - b1 * sin(th)')} AS corner_col FROM box""",
)
def oriented_boxes(spark, sf):
    boxes = C.oriented_boxes(_labelled(spark, sf))
    return rounded(
        boxes.withColumns({"corner_row": F.col("corners")[4], "corner_col": F.col("corners")[5]})
        .drop("corners")
    )


@query(
    "best_component",
    f"""WITH RECURSIVE {X.PX}, {_ON}, {_components('lit', _FOUR)},
    {_boxes(extra=', avg((r + g + b) / 3.0) AS mb', join='JOIN px USING (image_id, y, x)')},
    sc AS (SELECT *, 0.5 * mb + 0.3 * least(density, 1.0) +
      0.2 * exp(-abs(aspect_ratio - 5.0) / 5.0) AS score FROM box WHERE n >= 3)
    SELECT image_id, label, n::BIGINT AS size, {rnd('score')} AS score FROM sc WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, label) = 1""",
)
def best_component(spark, sf):
    px = X.pixels(spark, sf).where(F.col("r") > 0.5).select("image_id", "row", "col", "r", "g", "b")
    bright = F.avg((F.col("r") + F.col("g") + F.col("b")) / 3.0)
    boxes = C.oriented_boxes(C.label_components(px), 3, aggregates={"mean_brightness": bright})
    return rounded(C.best_component(boxes).select("image_id", "label", "size", "score"))


@query(
    "top_markers",
    f"""WITH RECURSIVE {X.PX}, {_ON}, {_components('lit', _FOUR)},
    s AS (SELECT image_id, label, count(*) AS size FROM lab GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY label) AS k FROM s)
    SELECT image_id, label, size, row_number() OVER (PARTITION BY image_id ORDER BY size DESC, label)
    AS marker FROM k WHERE k <= 4""",
)
def top_markers(spark, sf):
    boxes = C.component_stats(_labelled(spark, sf))
    return C.top_markers(boxes, 4).select("image_id", "label", "size", "marker")


@query(
    "find_components",
    f"""WITH RECURSIVE {X.PX}, mpx AS (SELECT image_id, y, x, r >= 0.45 AND g >= 0.45 AND b >= 0.45
      AS m FROM px), {_morph('dilate', 'mpx', 'd1', 1)}, {_morph('erode', 'd1', 'd2', 1)},
    {_morph('erode', 'd2', 'd3', 1)}, {_morph('dilate', 'd3', 'd4', 1)},
    lit AS (SELECT image_id, y, x FROM d4 WHERE m), {_components('lit', _FOUR)}
    SELECT image_id, label, count(*) AS size, {rnd('avg(y)')} AS centroid_row,
    {rnd('avg(x)')} AS centroid_col, min(y) AS r_min, max(y) AS r_max, min(x) AS c_min, max(x) AS c_max
    FROM lab GROUP BY image_id, label HAVING count(*) >= 2""",
)
def find_components(spark, sf):
    return rounded(C.find_components(X.pixels(spark, sf), 0.45, 1, 2))


@query(
    "detected_markers",
    f"""WITH RECURSIVE {X.PX}, mpx AS (SELECT image_id, y, x, r >= 0.45 AND g >= 0.45 AND b >= 0.45
      AS m FROM px), {_morph('dilate', 'mpx', 'd1', 1)}, {_morph('erode', 'd1', 'd2', 1)},
    {_morph('erode', 'd2', 'd3', 1)}, {_morph('dilate', 'd3', 'd4', 1)},
    lit AS (SELECT image_id, y, x FROM d4 WHERE m), {_components('lit', _FOUR)}, {_boxes()},
    early AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY label) AS k FROM box WHERE n >= 2)
    SELECT image_id, label, n::BIGINT AS size,
    row_number() OVER (PARTITION BY image_id ORDER BY n DESC, label) AS marker,
    {rnd('cy')} AS centroid_row, {rnd('cx')} AS centroid_col, {rnd('aspect_ratio')} AS aspect_ratio,
    {rnd('density')} AS density FROM early WHERE k <= 2""",
)
def detected_markers(spark, sf):
    found = C.detect_markers(X.pixels(spark, sf), 0.45, 1, 2, max_markers=2)
    return rounded(
        found.select("image_id", "label", "size", "marker", "centroid_row", "centroid_col", "aspect_ratio", "density")
    )


@query(
    "white_region",
    f"""WITH RECURSIVE {X.PX}, lit AS (SELECT image_id, y, x FROM px WHERE r >= 0.45 AND g >= 0.45
      AND b >= 0.45 AND y BETWEEN 2 AND 8 AND x BETWEEN 1 AND 7), {_components('lit', _FOUR)},
    {_boxes(extra=', avg((r + g + b) / 3.0) AS mb', join='JOIN px USING (image_id, y, x)')},
    sc AS (SELECT *, 0.5 * mb + 0.3 * least(density, 1.0) +
      0.2 * exp(-abs(aspect_ratio - 5.0) / 5.0) AS score FROM box WHERE n >= 3
      QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, label) = 1),
    cnt AS (SELECT image_id, max(label) AS num FROM lab GROUP BY image_id)
    SELECT i.image_id, CASE WHEN coalesce(num, 0) = 0 THEN 'no_component'
      WHEN label IS NULL THEN 'too_small' ELSE 'found' END AS status,
    coalesce(num, 0) AS num_components, coalesce(n, 0)::BIGINT AS size,
    {rnd('coalesce(n, 0) / 64 * 100')} AS white_pct, {rnd('coalesce(aspect_ratio, 0)')} AS aspect_ratio,
    {rnd('coalesce(density, 0)')} AS density, {rnd('coalesce(th, 0)')} AS angle,
    {rnd('CASE WHEN n > 0 THEN greatest(2, least(8, cy + a1 * sin(th) + b1 * cos(th))) END')} AS corner_row,
    {rnd('CASE WHEN n > 0 THEN greatest(1, least(7, cx + a1 * cos(th) - b1 * sin(th))) END')} AS corner_col
    FROM (SELECT DISTINCT image_id FROM px) i LEFT JOIN cnt USING (image_id)
    LEFT JOIN sc USING (image_id)""",
)
def white_region(spark, sf):
    box = (F.lit(2), F.lit(50), F.lit(-3), F.lit(7))
    out = C.white_region(
        X.pixels(spark, sf), 0.45, min_area=3, radius=0, region=box
    )
    found = F.col("status") == "found"
    return rounded(
        out.select(
            "image_id", "status", "num_components", "size", "white_pct", "aspect_ratio",
            "density", "angle",
            F.when(found, F.col("corners")[4]).alias("corner_row"),
            F.when(found, F.col("corners")[5]).alias("corner_col"),
        )
    )


_INSIDE = "y BETWEEN 2 AND 8 AND x BETWEEN 1 AND 7"


@query(
    "white_region_closed",
    f"""WITH RECURSIVE {X.PX}, mpx AS (SELECT image_id, y, x, r >= 0.4 AND g >= 0.4 AND b >= 0.4
      AND {_INSIDE} AS m FROM px), {_morph('dilate', 'mpx', 'd1', 1)}, {_morph('erode', 'd1', 'd2', 1)},
    {_morph('erode', 'd2', 'd3', 1)}, {_morph('dilate', 'd3', 'd4', 1)},
    lit AS (SELECT image_id, y, x FROM d4 WHERE m AND {_INSIDE}), {_components('lit', _FOUR)},
    {_boxes(extra=', avg((r + g + b) / 3.0) AS mb', join='JOIN px USING (image_id, y, x)')},
    sc AS (SELECT *, 0.5 * mb + 0.3 * least(density, 1.0) +
      0.2 * exp(-abs(aspect_ratio - 5.0) / 5.0) AS score FROM box WHERE n >= 9
      QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, label) = 1),
    cnt AS (SELECT image_id, max(label) AS num FROM lab GROUP BY image_id)
    SELECT i.image_id, CASE WHEN coalesce(num, 0) = 0 THEN 'no_component'
      WHEN label IS NULL THEN 'too_small' ELSE 'found' END AS status,
    coalesce(num, 0) AS num_components, coalesce(n, 0)::BIGINT AS size, {rnd('score')} AS score,
    {rnd('coalesce(aspect_ratio, 0)')} AS aspect_ratio, {rnd('coalesce(density, 0)')} AS density
    FROM (SELECT DISTINCT image_id FROM px) i LEFT JOIN cnt USING (image_id)
    LEFT JOIN sc USING (image_id)""",
)
def white_region_closed(spark, sf):
    """The mask is closed and opened with radius 1, then cut to the region a second time."""
    box = (F.lit(2), F.lit(50), F.lit(-3), F.lit(7))
    out = C.white_region(X.pixels(spark, sf), 0.4, min_area=9, radius=1, region=box)
    return rounded(out.select("image_id", "status", "num_components", "size", "score", "aspect_ratio", "density"))


@query(
    "white_region_adaptive",
    f"""WITH RECURSIVE {X.PX}, {_LOCAL}, lit AS (SELECT image_id, y, x FROM loc WHERE v > mu + 0.05
      AND v > 0.45), {_components('lit', _FOUR)},
    {_boxes(extra=', avg((r + g + b) / 3.0) AS mb', join='JOIN px USING (image_id, y, x)')},
    sc AS (SELECT *, 0.5 * mb + 0.3 * least(density, 1.0) +
      0.2 * exp(-abs(aspect_ratio - 5.0) / 5.0) AS score FROM box WHERE n >= 3
      QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, label) = 1)
    SELECT i.image_id, coalesce(n, 0)::BIGINT AS size, {rnd('score')} AS score
    FROM (SELECT DISTINCT image_id FROM px) i LEFT JOIN sc USING (image_id)""",
)
def white_region_adaptive(spark, sf):
    out = C.white_region(
        X.pixels(spark, sf), 0.45, min_area=3, radius=0, adaptive=True, window=5, offset=0.05
    )
    return rounded(out.select("image_id", "size", "score"))


_CLASS_ON = "lit AS (" + " UNION ALL ".join(
    f"SELECT image_id, '{c}' AS class, y, x FROM px WHERE p_{c} > 0.3"
    for c in S.FOREGROUND_CLASSES
) + ")"


def _class_boxes(spark, sf):
    px = X.pixels(spark, sf)
    members = F.filter(
        F.array(*[F.when(F.col(S.p_col(c)) > 0.3, F.lit(c)) for c in S.FOREGROUND_CLASSES]),
        lambda c: c.isNotNull(),
    )
    on = px.select("image_id", "row", "col", F.explode(members).alias("class"))
    keys = ["image_id", "class"]
    return C.oriented_boxes(C.label_components(on, keys=keys), keys=keys)


_CLASS_BOX = f"""{X.PX}, {_CLASS_ON}, {_components('lit', _FOUR, 'image_id, class')},
{_boxes('image_id, class')}"""


@query(
    "bbox_summary",
    f"""WITH RECURSIVE {_CLASS_BOX} SELECT class,
    {", ".join(f"{rnd(f'avg({m})')} AS mean_{m}, {rnd(f'stddev_samp({m})')} AS std_{m}"
               for m in ('width', 'height', 'aspect_ratio'))}, count(*) AS num_components
    FROM box GROUP BY class""",
)
def bbox_summary(spark, sf):
    return rounded(stats.bbox_summary(_class_boxes(spark, sf)))


@query(
    "bbox_slope",
    f"""WITH RECURSIVE {_CLASS_BOX}, s AS (SELECT class, count(*) AS n,
      covar_pop(width, height) / var_pop(width) AS slope, avg(width) AS mw, avg(height) AS mh
      FROM box GROUP BY class)
    SELECT class, n, {rnd('slope')} AS slope, {rnd('mh - slope * mw')} AS intercept FROM s""",
)
def bbox_slope(spark, sf):
    return rounded(stats.bbox_slope(_class_boxes(spark, sf)))


# ---- polygons ------------------------------------------------------------------------------------


@query(
    "polygon_mask",
    f'WITH {X.PX}, {X.POLY} SELECT image_id, polygon_id, y AS "row", x AS col FROM hit',
)
def polygon_mask(spark, sf):
    px = X.pixels(spark, sf).select("image_id", "row", "col")
    hits = PG.pixels_in_polygons(px, X.polygons(spark, sf), band=4)
    return hits.select("image_id", "polygon_id", "row", "col")


@query(
    "polygon_lch",
    f"""WITH {X.PX}, {X.POLY}, {X.lch_ctes('hit')}, s AS (SELECT image_id, polygon_id,
      {", ".join(f"{rnd(f'median({m})')} AS {m}_median, {rnd(f'avg({m})')} AS {m}_mean" for m in 'lch')},
      count(*) AS pixel_count FROM lch GROUP BY ALL)
    SELECT p.image_id, p.polygon_id, {", ".join(f"{m}_{k}" for m in 'lch' for k in ('median', 'mean'))},
    coalesce(pixel_count, 0) AS pixel_count
    FROM (SELECT DISTINCT image_id, polygon_id FROM corner) p LEFT JOIN s USING (image_id, polygon_id)""",
)
def polygon_lch(spark, sf):
    px = X.pixels(spark, sf).select("image_id", "row", "col", "r", "g", "b")
    poly = X.polygons(spark, sf)
    return rounded(colours.polygon_lch(PG.pixels_in_polygons(px, poly), poly))


@query(
    "overlay_last_wins",
    f"""WITH {X.PX}, {X.POLY} SELECT image_id, y AS "row", x AS col,
    arg_max(CASE polygon_id WHEN 1 THEN 'scar' ELSE 'redness' END, polygon_id) AS class
    FROM hit GROUP BY image_id, y, x""",
)
def overlay_last_wins(spark, sf):
    px = X.pixels(spark, sf).select("image_id", "row", "col")
    return P.overlay_last_wins(PG.pixels_in_polygons(px, X.polygons(spark, sf)))


@query(
    "rasterise_all",
    f"""WITH {X.PX}, {X.POLY}, a AS (SELECT image_id, polygon_id, count(*) AS area FROM hit GROUP BY ALL),
    p AS (SELECT DISTINCT image_id, polygon_id FROM corner),
    s AS (SELECT p.image_id, label % 3 != p.polygon_id % 3 AS usable, area FROM p
      JOIN embeddings e ON e.vec_id = p.image_id LEFT JOIN a USING (image_id, polygon_id))
    SELECT image_id, count(*) FILTER (usable AND area IS NOT NULL) AS saved,
    count(*) FILTER (NOT usable) AS skipped, count(*) FILTER (usable AND area IS NULL) AS failed,
    coalesce(sum(area) FILTER (usable), 0)::BIGINT AS mask_pixels,
    count(*) FILTER (usable AND area IS NULL) = 0 AS ok FROM s GROUP BY image_id""",
)
def rasterise_all(spark, sf):
    _, outcome = PG.rasterise_all(X.polygons(spark, sf), X.pixels(spark, sf))
    return outcome


@query(
    "polygon_bounds",
    f"""WITH {X.POLY.split('edge AS')[0].rstrip().rstrip(',')}
    SELECT image_id, polygon_id, {rnd('min(vx)')} AS x_min, {rnd('max(vx)')} AS x_max,
    {rnd('min(vy)')} AS y_min, {rnd('max(vy)')} AS y_max FROM corner GROUP BY ALL""",
)
def polygon_bounds(spark, sf):
    b = G.polygon_bounds(F.col("vertices"))
    names = ("x_min", "x_max", "y_min", "y_max")
    return rounded(
        X.polygons(spark, sf).select(
            "image_id", "polygon_id", *[v.alias(n) for n, v in zip(names, b, strict=True)]
        )
    )


@query(
    "cached_colour",
    """WITH p AS (SELECT event_id AS image_id, user_id, event_type AS class, value, event_id FROM events)
    SELECT user_id AS image_id, class, arg_max(value, event_id) AS l_median FROM p
    WHERE event_id % 3 != 0 AND event_id % 5 != 0 GROUP BY 1, 2""",
)
def cached_colour(spark, sf):
    ev = X.table(spark, sf, "events")
    lch = F.struct(F.col("value").alias("L_median"), F.lit(1).alias("count"))
    polys = ev.select(
        F.col("user_id").alias("image_id"), F.col("event_type").alias("class"),
        F.col("event_id").alias("list_pos"), (F.col("event_id") % 3 != 0).alias("complete"),
        F.when(F.col("event_id") % 5 != 0, lch).alias("lch_data"),
    )
    return PG.cached_colour(polys).select(
        "image_id", "class", F.col("lch.L_median").alias("l_median")
    )


@query(
    "edit_polygons",
    """WITH b AS (SELECT o_custkey AS image_id, row_number() OVER (PARTITION BY o_custkey
      ORDER BY o_orderkey) * 2 AS id, o_orderkey FROM orders),
    top AS (SELECT image_id, max(id) AS top FROM b GROUP BY 1),
    k AS (SELECT b.*, image_id % 5 AS act FROM b),
    kept AS (SELECT image_id, CASE WHEN act = 3 AND id = 2 THEN 3 ELSE id END AS id,
      CASE WHEN act = 2 AND id = 2 THEN 'redness' ELSE 'scar' END AS class, 'kept' AS kind FROM k
      WHERE NOT (act = 1 AND id = 2)),
    added AS (SELECT image_id, top + 1 AS id, 'necrosis' AS class, 'kept' AS kind FROM top
      WHERE image_id % 5 = 0 UNION ALL
      SELECT image_id, top + 2, 'hematoma', 'kept' FROM top WHERE image_id % 5 = 0)
    SELECT image_id, id, class, kind FROM kept UNION ALL SELECT * FROM added
    UNION ALL SELECT image_id, 2, CASE WHEN top >= 4 THEN 'id in use' ELSE 'not rejected' END, 'rejected'
    FROM top WHERE image_id % 5 = 4 AND top >= 4
    UNION ALL SELECT image_id, 4, 'polygon not found', 'rejected' FROM top
    WHERE image_id % 5 = 1 AND top < 4""",
)
def edit_polygons(spark, sf):
    """Customers as images, their orders as polygons numbered 2, 4, ...; one edit pattern per residue."""
    from pyspark.sql import Window as W

    orders = X.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("image_id"), "o_orderkey"
    )
    place = F.row_number().over(W.partitionBy("image_id").orderBy("o_orderkey")) * 2
    ring = F.array(F.array(F.lit(0.0), F.lit(0.0)))
    base = orders.select(
        "image_id", place.cast("int").alias("id"), F.lit("scar").alias("class"),
        ring.alias("vertices"), F.lit(None).cast(S.POLYGON_STRUCT["lch_data"].dataType).alias("lch_data"),
    )
    top = base.groupBy("image_id").agg(F.max("id").alias("top"))
    act = F.col("image_id") % 5

    def change(when, seq, action, id_=None, new_id=None, class_=None):
        return top.where(when).select(
            "image_id", F.lit(seq).alias("seq"), F.lit(action).alias("action"),
            (id_ if id_ is not None else F.lit(None)).cast("int").alias("id"),
            (new_id if new_id is not None else F.lit(None)).cast("int").alias("new_id"),
            F.lit(class_).cast("string").alias("class"),
            F.lit(None).cast("array<array<double>>").alias("vertices"),
        )

    edits = [
        change(act == 0, 1, "add", F.lit(2), class_="necrosis"),
        change(act == 0, 2, "add", class_="hematoma"),
        change(act == 1, 1, "remove", F.lit(2)),
        change((act == 1) & (F.col("top") < 4), 2, "remove", F.lit(4)),
        change(act == 2, 1, "replace", F.lit(2), class_="redness"),
        change(act == 3, 1, "renumber", F.lit(2), F.lit(3)),
        change((act == 4) & (F.col("top") >= 4), 1, "renumber", F.lit(2), F.lit(4)),
    ]
    changes = edits[0]
    for e in edits[1:]:
        changes = changes.unionByName(e)
    done, rejected = PG.edit_polygons(base, changes)
    return done.select("image_id", "id", "class", F.lit("kept").alias("kind")).unionByName(
        rejected.select("image_id", "id", F.col("reason").alias("class"), F.lit("rejected").alias("kind"))
    )


@query(
    "rotated_rectangle",
    f"""WITH q AS (SELECT p_partkey, (p_size % 7)::DOUBLE AS x1, (p_size % 5)::DOUBLE AS y1,
      (p_size % 11 + 8)::DOUBLE AS x2, (p_size % 3 + 6)::DOUBLE AS y2, p_size * 7.0 AS deg,
      (p_partkey % 17)::DOUBLE AS px, (p_partkey % 13)::DOUBLE AS py FROM part),
    c AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, cos(radians(deg)) AS co,
      sin(radians(deg)) AS si FROM q),
    k AS (SELECT p_partkey, cx, cy, co, si, px, py, x1, y1, x2, y2,
      unnest([x1, x2, x2, x1]) AS vx, unnest([y1, y1, y2, y2]) AS vy FROM c),
    r AS (SELECT p_partkey, min((vx - cx) * co - (vy - cy) * si + cx) AS x_min,
      max((vx - cx) * co - (vy - cy) * si + cx) AS x_max,
      min((vx - cx) * si + (vy - cy) * co + cy) AS y_min,
      max((vx - cx) * si + (vy - cy) * co + cy) AS y_max FROM k GROUP BY 1)
    SELECT c.p_partkey, {rnd_as('x_min', 'x_max', 'y_min', 'y_max')},
    abs((px - cx) * co + (py - cy) * si) <= abs(x2 - x1) / 2 AND
    abs((py - cy) * co - (px - cx) * si) <= abs(y2 - y1) / 2 AS inside,
    5 AS n_points FROM c JOIN r USING (p_partkey)""",
)
def rotated_rectangle(spark, sf):
    p = X.table(spark, sf, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    x1, y1 = (size % 7).cast("double"), (size % 5).cast("double")
    x2, y2 = (size % 11 + 8).cast("double"), (size % 3 + 6).cast("double")
    deg = size * 7.0
    b = G.rotated_bounds(x1, y1, x2, y2, deg)
    inside = G.in_rotated_rectangle(
        (key % 17).cast("double"), (key % 13).cast("double"), x1, y1, x2, y2, deg
    )
    return rounded(
        p.select(
            "p_partkey",
            *[v.alias(n) for n, v in zip(("x_min", "x_max", "y_min", "y_max"), b, strict=True)],
            inside.alias("inside"),
            F.size(G.rotated_rectangle(x1, y1, x2, y2, deg)).alias("n_points"),
        )
    )


@query(
    "display_to_pixel",
    f"""SELECT p_partkey, (100 - round_even(p_retailprice / 10, 0) + 1)::INT AS "row",
    round_even(p_retailprice / 7, 0)::INT AS col, {rnd('p_size * 4.0')} AS x,
    {rnd('(p_size + 1) * 2.0')} AS y FROM part""",
)
def display_to_pixel(spark, sf):
    p = X.table(spark, sf, "part")
    row, col = G.axis_to_pixel(F.col("p_retailprice") / 7, F.col("p_retailprice") / 10, F.lit(100))
    v = G.scale_vertices(
        F.array(F.array(F.col("p_size").cast("double"), F.col("p_size") + 1.0)), 4.0, 2.0
    )
    return rounded(
        p.select("p_partkey", row.cast("int").alias("row"), col.cast("int").alias("col"),
                 v[0][0].alias("x"), v[0][1].alias("y"))
    )


# ---- markers and warping -------------------------------------------------------------------------


def _markers(spark, sf):
    """Up to four components per image as markers, with their centroids."""
    return C.top_markers(C.component_stats(_labelled(spark, sf), 2), 4).select(
        "image_id", "marker", "centroid_row", "centroid_col"
    )


_MARKERS = f"""{X.PX}, {_ON}, {_components('lit', _FOUR)},
st AS (SELECT image_id, label, count(*) AS size, avg(y) AS cy, avg(x) AS cx FROM lab
  GROUP BY image_id, label HAVING count(*) >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY label) AS k FROM st),
mk AS (SELECT image_id, cy, cx, row_number() OVER (PARTITION BY image_id ORDER BY size DESC, label)
  AS marker FROM k WHERE k <= 4)"""
_TARGETS = """tg AS (SELECT image_id, marker AS target,
  CASE WHEN marker <= 2 THEN 1.0 ELSE 7.0 END AS ty,
  CASE WHEN marker IN (1, 4) THEN 1.0 ELSE 7.0 END AS tx FROM mk)"""


@query(
    "canonical_positions",
    f"""WITH RECURSIVE {_MARKERS}, lim AS (SELECT image_id, min(cy) AS r0, max(cy) AS r1, min(cx) AS c0,
      max(cx) AS c1, ceil(max(cy) + 2) AS h, ceil(max(cx) + 2) AS w FROM mk GROUP BY 1)
    SELECT mk.image_id, marker AS target,
    {rnd('CASE WHEN marker <= 2 THEN 1.0 ELSE h - 1 END')} AS corner_row,
    {rnd('CASE WHEN marker IN (1, 4) THEN 1.0 ELSE w - 1 END')} AS corner_col,
    {rnd('1 + ((marker - 1) // 2) * (least(h, w) - 2)')} AS grid_row,
    {rnd('1 + ((marker - 1) % 2) * (least(h, w) - 2)')} AS grid_col,
    {rnd('CASE WHEN r1 > r0 THEN (cy - r0) / (r1 - r0) ELSE 0 END * (h - 2) + 1')} AS kept_row,
    {rnd('CASE WHEN c1 > c0 THEN (cx - c0) / (c1 - c0) ELSE 0 END * (w - 2) + 1')} AS kept_col
    FROM mk JOIN lim USING (image_id)""",
)
def canonical_positions(spark, sf):
    markers = _markers(spark, sf)
    out = None
    for mode, name in (("corners_4", "corner"), ("grid_2x2", "grid"), ("preserve_relative", "kept")):
        part = warp.canonical_positions(markers, mode, margin=1.0).select(
            "image_id", "target", F.col("target_row").alias(f"{name}_row"),
            F.col("target_col").alias(f"{name}_col"),
        )
        out = part if out is None else out.join(part, ["image_id", "target"])
    return rounded(out)


def _snapped_sql(value: str, lo: str, hi: str, n: str) -> str:
    step = f"(({hi} - {lo}) / nullif({n} - 1, 0))"
    return rnd(f"coalesce(CASE WHEN {step} > 0 THEN round_even(({value} - {lo}) / {step}, 0) * {step} ELSE 0 END, 0) + 1")


@query(
    "canonical_grids",
    f"""WITH RECURSIVE {_MARKERS}, lim AS (SELECT image_id, min(cy) AS r0, max(cy) AS r1, min(cx) AS c0,
      max(cx) AS c1, ceil(max(cy) + 2) AS h, ceil(max(cx) + 2) AS w, count(DISTINCT round_even(cy, 0)) AS nr,
      count(DISTINCT round_even(cx, 0)) AS nc FROM mk GROUP BY 1)
    SELECT mk.image_id, marker AS target,
    {rnd('1 + ((marker - 1) // 3) * (least(h, w) - 2) / 2')} AS grid_row,
    {rnd('1 + ((marker - 1) % 3) * (least(h, w) - 2) / 2')} AS grid_col,
    {_snapped_sql('cy', 'r0', 'r1', 'nr')} AS auto_row, {_snapped_sql('cx', 'c0', 'c1', 'nc')} AS auto_col
    FROM mk JOIN lim USING (image_id)""",
)
def canonical_grids(spark, sf):
    """The other two layouts: a grid of three by three, and the rows and columns that the markers form."""
    markers = _markers(spark, sf)
    parts = [
        warp.canonical_positions(markers, mode, margin=1.0).select(
            "image_id", "target", F.col("target_row").alias(f"{name}_row"), F.col("target_col").alias(f"{name}_col")
        )
        for mode, name in (("grid_3x3", "grid"), ("auto", "auto"))
    ]
    return rounded(parts[0].join(parts[1], ["image_id", "target"]))


@query(
    "correspond_spatial",
    f"""WITH RECURSIVE {_MARKERS}, {_TARGETS},
    a AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cy, cx, marker) AS k FROM mk),
    b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ty, tx, target) AS k FROM tg)
    SELECT image_id, marker, {rnd('cy')} AS centroid_row, {rnd('cx')} AS centroid_col, target,
    {rnd('ty')} AS target_row, {rnd('tx')} AS target_col FROM a JOIN b USING (image_id, k)""",
)
def correspond_spatial(spark, sf):
    markers = _markers(spark, sf)
    targets = warp.canonical_positions(markers, "corners_4", (8, 8), 1.0)
    return rounded(warp.correspond(markers, targets, "spatial_order"))


@query(
    "correspond_nearest",
    f"""WITH RECURSIVE {_MARKERS}, {_TARGETS},
    d AS (SELECT mk.image_id, marker, target, round(sqrt(pow(cy - ty, 2) + pow(cx - tx, 2)), 9) AS d
      FROM mk JOIN tg USING (image_id)),
    m1 AS (SELECT image_id, arg_min(target, (d, target)) AS t FROM d WHERE marker = 1 GROUP BY 1),
    m2 AS (SELECT d.image_id, any_value(m1.t) AS t1, arg_min(target, (d, target)) AS t FROM d JOIN m1
      USING (image_id) WHERE marker = 2 AND target != m1.t GROUP BY 1),
    m3 AS (SELECT d.image_id, any_value(t1) AS t1, any_value(m2.t) AS t2, arg_min(target, (d, target)) AS t
      FROM d JOIN m2 USING (image_id) WHERE marker = 3 AND target NOT IN (t1, m2.t) GROUP BY 1),
    m4 AS (SELECT d.image_id, arg_min(target, (d, target)) AS t FROM d JOIN m3 USING (image_id)
      WHERE marker = 4 AND target NOT IN (t1, t2, m3.t) GROUP BY 1)
    SELECT image_id, 1 AS marker, t AS target FROM m1 UNION ALL SELECT image_id, 2, t FROM m2
    UNION ALL SELECT image_id, 3, t FROM m3 UNION ALL SELECT image_id, 4, t FROM m4""",
)
def correspond_nearest(spark, sf):
    markers = _markers(spark, sf)
    targets = warp.canonical_positions(markers, "corners_4", (8, 8), 1.0)
    return warp.correspond(markers, targets, "nearest").select("image_id", "marker", "target")


def _points(spark, sf):
    """Per label and event type: nine control points and a smooth displacement from the data."""
    ev = X.table(spark, sf, "events").groupBy((F.col("event_id") % 500).alias("image_id")).agg(
        F.avg("value").alias("v"), F.count(F.lit(1)).alias("n")
    )
    grid = F.array(
        *[F.struct(F.lit(10.0 * r).alias("a"), F.lit(10.0 * c).alias("b"))
          for r in range(1, 4) for c in range(1, 4)]
    )
    v = F.col("v") / 100.0
    return ev.select("image_id", "v", F.explode(grid).alias("p")).select(
        "image_id",
        F.col("p.a").alias("from_row"),
        F.col("p.b").alias("from_col"),
        (F.col("p.a") + 5.0 + F.sin(F.col("p.b") / 10.0) * v).alias("to_row"),
        (F.col("p.b") * 1.5 + F.cos(F.col("p.a") / 10.0) * v).alias("to_col"),
    )


_POINTS_SQL = """
ev AS (SELECT event_id % 500 AS image_id, avg(value) / 100.0 AS v FROM events GROUP BY 1),
g AS (SELECT image_id, v, 10.0 * a AS a, 10.0 * b AS b FROM ev, (SELECT unnest([1, 2, 3]) AS a) ga,
  (SELECT unnest([1, 2, 3]) AS b) gb),
pt AS (SELECT image_id, a, b, a + 5.0 + sin(b / 10.0) * v AS ty, b * 1.5 + cos(a / 10.0) * v AS tx FROM g)
"""


@query(
    "tps_residual",
    f"""WITH {_POINTS_SQL} SELECT image_id, 'ok' AS status, 0.0::DOUBLE AS mean_residual,
    0.0::DOUBLE AS max_residual, {rnd('avg(sqrt(pow(ty - a, 2) + pow(tx - b, 2)))')} AS mean_displacement,
    {rnd('max(sqrt(pow(ty - a, 2) + pow(tx - b, 2)))')} AS max_displacement
    FROM pt GROUP BY image_id""",
)
def tps_residual(spark, sf):
    """An unregularised spline passes through its points: residual 0, known displacement."""
    points = _points(spark, sf)
    model = warp.fit_tps(points)
    mapped = warp.apply_tps(points, model)
    out = model.select("image_id", "status").join(warp.tps_residual(mapped), "image_id").join(
        warp.deformation(mapped), "image_id"
    )
    return rounded(out)


@query(
    "tps_affine_recovery",
    f"""WITH ev AS (SELECT event_id % 500 AS image_id, avg(value) AS v FROM events GROUP BY 1)
    SELECT image_id, {rnd('17.0 * 2 + v')} AS mapped_row, {rnd('23.0 * 2 - v')} AS mapped_col FROM ev""",
)
def tps_affine_recovery(spark, sf):
    """Scale by two and shift: an affine map is recovered away from the control points too."""
    ev = X.table(spark, sf, "events").groupBy((F.col("event_id") % 500).alias("image_id")).agg(
        F.avg("value").alias("v")
    )
    grid = F.array(
        *[F.struct(F.lit(10.0 * r).alias("a"), F.lit(10.0 * c).alias("b"))
          for r in range(1, 4) for c in range(1, 4)]
    )
    points = ev.select("image_id", "v", F.explode(grid).alias("p")).select(
        "image_id", F.col("p.a").alias("from_row"), F.col("p.b").alias("from_col"),
        (F.col("p.a") * 2 + F.col("v")).alias("to_row"),
        (F.col("p.b") * 2 - F.col("v")).alias("to_col"),
    )
    probe = ev.select("image_id", F.lit(17.0).alias("from_row"), F.lit(23.0).alias("from_col"))
    out = warp.apply_tps(probe, warp.fit_tps(points))
    return rounded(out.select("image_id", "mapped_row", "mapped_col"))


@query(
    "warp_shift",
    f"""WITH {X.PX}, k AS (SELECT vec_id AS image_id, (label % 3)::INT AS s FROM embeddings)
    SELECT p.image_id, p.y AS "row", p.x AS col, {rnd('coalesce(q.r, -1)')} AS r,
    CASE WHEN q.r > 0.5 THEN 1.0 ELSE 0.0 END AS m
    FROM px p JOIN k USING (image_id) LEFT JOIN px q ON q.image_id = p.image_id
    AND q.y = p.y + k.s AND q.x = p.x + 1""",
)
def warp_shift(spark, sf):
    """Target to source shift by (label % 3, 1): bilinear planes, nearest masks, fill outside."""
    images = X.images(spark, sf).withColumn(
        "m", F.transform("r", lambda v: F.when(v > 0.5, 1.0).otherwise(0.0))
    )
    e = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    corners = F.array(*[F.struct(F.lit(float(r)).alias("a"), F.lit(float(c)).alias("b"))
                        for r in (1, 8) for c in (1, 8)])
    points = e.select("image_id", "label", F.explode(corners).alias("p")).select(
        "image_id", F.col("p.a").alias("from_row"), F.col("p.b").alias("from_col"),
        (F.col("p.a") + F.col("label") % 3).alias("to_row"), (F.col("p.b") + 1.0).alias("to_col"),
    )
    model = warp.fit_tps(points)
    r = P.to_pixels(
        warp.warp_images(images.select("image_id", "height", "width", "r"), model, ["r"], fill=-1.0)
    )
    m = P.to_pixels(
        warp.warp_masks(images.select("image_id", "height", "width", "m"), model, ["m"])
    )
    keys = ["image_id", "row", "col"]
    return rounded(
        r.select(*keys, "r").join(m.select(*keys, "m"), keys)
    )


@query("dewarp")
def dewarp(spark, sf):
    """Rows only: iterative detection, a solve per image and bilinear resampling."""
    images = X.images(spark, sf).select("image_id", "height", "width", "r", "g", "b")
    px = X.pixels(spark, sf).select("image_id", "row", "col", "height", "width", "r", "g", "b")
    warped, status = warp.dewarp(
        images, px, ["r", "g", "b"], size=(8, 8), margin=1.0,
        threshold=0.45, radius=0, min_area=2,
    )
    means = P.to_pixels(warped).groupBy("image_id").agg(F.avg("r").alias("mean_r"))
    return rounded(status.join(means, "image_id", "left"))


# ---- resampling ----------------------------------------------------------------------------------


@query(
    "resize_nearest",
    f"""WITH {X.PX}, g AS (SELECT a.y, b.x, least(8, greatest(1, round_even(a.y * 8 / 5.0, 0)))::INT AS sy,
      least(8, greatest(1, round_even(b.x * 8 / 3.0, 0)))::INT AS sx FROM (SELECT unnest(range(1, 6)) AS y) a,
      (SELECT unnest(range(1, 4)) AS x) b)
    SELECT image_id, g.y AS "row", g.x AS col, {rnd('r')} AS r, {rnd('p_scar')} AS p_scar
    FROM px JOIN g ON px.y = g.sy AND px.x = g.sx""",
)
def resize_nearest(spark, sf):
    images = X.images(spark, sf).select("image_id", "height", "width", "r", "p_scar")
    small = resample.resize(images, ["r", "p_scar"], None, (5, 3), "nearest")
    return rounded(P.to_pixels(small).drop("height", "width"))


@query(
    "resize_bilinear",
    f"""WITH {X.PX}, g AS (SELECT a.y, b.x, (a.y - 1) * 7 / 3.0 + 1 AS sy, (b.x - 1) * 7 / 4.0 + 1 AS sx
      FROM (SELECT unnest(range(1, 5)) AS y) a, (SELECT unnest(range(1, 6)) AS x) b),
    h AS (SELECT *, floor(sy)::INT AS y0, floor(sx)::INT AS x0, sy - floor(sy) AS fy, sx - floor(sx) AS fx
      FROM g)
    SELECT image_id, h.y AS "row", h.x AS col, {rnd('''sum(r *
      (CASE WHEN px.y = y0 THEN 1 - fy ELSE 0 END + CASE WHEN px.y = least(y0 + 1, 8) THEN fy ELSE 0 END) *
      (CASE WHEN px.x = x0 THEN 1 - fx ELSE 0 END + CASE WHEN px.x = least(x0 + 1, 8) THEN fx ELSE 0 END))''')} AS r
    FROM px JOIN h ON px.y BETWEEN y0 AND y0 + 1 AND px.x BETWEEN x0 AND x0 + 1
    GROUP BY image_id, h.y, h.x""",
)
def resize_bilinear(spark, sf):
    images = X.images(spark, sf).select("image_id", "height", "width", "r")
    return rounded(
        P.to_pixels(resample.resize(images, ["r"], None, (4, 5))).drop("height", "width")
    )


@query(
    "resize_quarter",
    f"""WITH {X.PX} SELECT image_id, ((y - 2) // 4 + 1)::INT AS "row", ((x - 2) // 4 + 1)::INT AS col,
    {rnd('avg(r)')} AS r FROM px WHERE y IN (2, 3, 6, 7) AND x IN (2, 3, 6, 7) GROUP BY ALL""",
)
def resize_quarter(spark, sf):
    images = X.images(spark, sf).select("image_id", "height", "width", "r")
    return rounded(P.to_pixels(resample.resize(images, ["r"])).drop("height", "width"))


@query(
    "rotate_any",
    f"""WITH {X.PX}, g AS (SELECT a.y, b.x, a.y - 6.0 AS dy, b.x - 6.0 AS dx
      FROM (SELECT unnest(range(1, 12)) AS y) a, (SELECT unnest(range(1, 12)) AS x) b),
    s AS (SELECT y, x, round(dy * cos(radians(30)) - dx * sin(radians(30)) + 4.5, 9) AS sy,
      round(dy * sin(radians(30)) + dx * cos(radians(30)) + 4.5, 9) AS sx FROM g),
    h AS (SELECT *, floor(sy)::INT AS y0, floor(sx)::INT AS x0, sy - floor(sy) AS fy, sx - floor(sx) AS fx,
      sy BETWEEN 1 AND 8 AND sx BETWEEN 1 AND 8 AS ins FROM s),
    v AS (SELECT image_id, h.y, h.x, sum(r *
      (CASE WHEN px.y = y0 THEN 1 - fy ELSE 0 END + CASE WHEN px.y = least(y0 + 1, 8) THEN fy ELSE 0 END) *
      (CASE WHEN px.x = x0 THEN 1 - fx ELSE 0 END + CASE WHEN px.x = least(x0 + 1, 8) THEN fx ELSE 0 END)) AS r
      FROM px JOIN h ON ins AND px.y BETWEEN y0 AND y0 + 1 AND px.x BETWEEN x0 AND x0 + 1
      GROUP BY image_id, h.y, h.x)
    SELECT i.image_id, h.y AS "row", h.x AS col, {rnd('coalesce(v.r, 0.5)')} AS r
    FROM (SELECT DISTINCT image_id FROM px) i CROSS JOIN h
    LEFT JOIN v ON v.image_id = i.image_id AND v.y = h.y AND v.x = h.x""",
)
def rotate_any(spark, sf):
    images = X.images(spark, sf).select("image_id", "height", "width", "r")
    return rounded(P.to_pixels(resample.rotate_any(images, ["r"], 30.0)).drop("height", "width"))


_READ = " + ".join(
    f"l[(r{i} - 1) * 8 + c{j}] * {'fr' if i else '(1 - fr)'} * {'fc' if j else '(1 - fc)'}" for i in (0, 1) for j in (0, 1)
)


@query(
    "marker_closeup",
    f"""WITH RECURSIVE {X.PX}, lit AS (SELECT image_id, y, x FROM px WHERE r >= 0.45 AND g >= 0.45 AND b >= 0.45),
    {_components('lit', _FOUR)}, {_boxes()},
    early AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY label) AS k FROM box WHERE n >= 3),
    best AS (SELECT *, round(width, 9) AS p, round(height, 9) AS q FROM early WHERE k <= 20
      QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, label) = 1),
    ax2 AS (SELECT image_id, cy, cx, greatest(p, q) AS w, least(p, q) AS h,
      CASE WHEN p > q THEN [sin(th), cos(th)] WHEN q > 0 THEN [cos(th), -sin(th)] ELSE [0.0, 1.0] END AS u,
      CASE WHEN p > q AND q > 0 THEN [-cos(th), sin(th)] WHEN p <= q AND p > 0 THEN [-sin(th), -cos(th)] ELSE [1.0, 0.0] END AS v
      FROM best),
    dims AS (SELECT *, greatest(1, round_even(h, 0))::INT AS oh, greatest(1, round_even(w, 0))::INT AS ow FROM ax2),
    cells AS (SELECT *, unnest(range(1, oh * ow + 1)) AS k FROM dims),
    pos AS (SELECT image_id, oh, ow, cy, cx, u, v, (k - 1) // ow + 1 - oh / 2 AS lr, (k - 1) % ow + 1 - ow / 2 AS lc FROM cells),
    src AS (SELECT image_id, oh, ow, round(cy + lc * u[1] + lr * v[1], 9) AS sr, round(cx + lc * u[2] + lr * v[2], 9) AS sc FROM pos),
    lists AS (SELECT image_id, list(r ORDER BY y, x) AS l FROM px GROUP BY image_id),
    f AS (SELECT src.*, l, sr BETWEEN 1 AND 8 AND sc BETWEEN 1 AND 8 AS inside, greatest(1, least(8, sr)) AS r,
      greatest(1, least(8, sc)) AS c FROM src JOIN lists USING (image_id)),
    z AS (SELECT *, floor(r)::INT AS r0, floor(c)::INT AS c0, least(floor(r)::INT + 1, 8) AS r1, least(floor(c)::INT + 1, 8) AS c1,
      r - floor(r) AS fr, c - floor(c) AS fc, l[((round_even(r, 0) - 1) * 8 + round_even(c, 0))::INT] >= 0.45 AS lit FROM f),
    seen AS (SELECT image_id, ow, oh, avg(CASE WHEN inside AND lit THEN {_READ} ELSE 0.5 END) AS mean_r FROM z GROUP BY ALL)
    SELECT i.image_id, coalesce(ow, 100) AS height, coalesce(oh, 100) AS width, {rnd('coalesce(mean_r, 0.5)')} AS mean_r
    FROM (SELECT DISTINCT image_id FROM px) i LEFT JOIN seen USING (image_id)""",
)
def marker_closeup(spark, sf):
    """The largest marker of every picture cut out along its box axes."""
    px = X.pixels(spark, sf).select("image_id", "row", "col", "height", "width", "r", "g", "b")
    markers = C.detect_markers(px, 0.45, 0, 3).where("marker = 1")
    on = F.transform("r", lambda v: F.when(v >= 0.45, 1.0).otherwise(0.0))
    images = X.images(spark, sf).select("image_id", "height", "width", "r", "g", "b", on.alias("m"))
    cut = resample.marker_closeup(images, markers, ["r", "g", "b"], "m")
    return rounded(
        P.to_pixels(cut).groupBy("image_id", "height", "width").agg(F.avg("r").alias("mean_r"))
    )


@query(
    "edits_that_meet",
    """WITH e AS (SELECT vec_id AS image_id, label % 2 = 1 AS odd FROM embeddings),
    rows AS (SELECT image_id, unnest(CASE WHEN odd THEN [
        {'kind': 'polygon', 'id': 5, 'what': 'scar'}, {'kind': 'polygon', 'id': 2, 'what': 'redness'},
        {'kind': 'polygon', 'id': 6, 'what': 'necrosis'}, {'kind': 'reject', 'id': 1, 'what': 'polygon already edited'},
        {'kind': 'reject', 'id': 2, 'what': 'id in use'}, {'kind': 'reject', 'id': 9, 'what': 'polygon not found'}]
      ELSE [{'kind': 'polygon', 'id': 1, 'what': 'hematoma'}, {'kind': 'polygon', 'id': 5, 'what': 'redness'},
        {'kind': 'polygon', 'id': 6, 'what': 'necrosis'}, {'kind': 'reject', 'id': 1, 'what': 'id in use'},
        {'kind': 'reject', 'id': 9, 'what': 'polygon not found'}] END) AS r FROM e)
    SELECT image_id, r.kind AS kind, r.id AS id, r.what AS what FROM rows""",
)
def edits_that_meet(spark, sf):
    """Five edits of every image that get into each other's way, in two ways by the parity of its label."""
    polygons = X.polygons(spark, sf)
    known = polygons.select(
        "image_id", F.col("polygon_id").alias("id"), "class", "vertices", F.lit(None).cast("double").alias("lch_data")
    )
    none, first = F.lit(None), F.when(F.col("label") % 2 == 1, 5).otherwise(2)
    edits = [
        (1, "renumber", F.lit(1), first, none),
        (2, "replace", F.lit(1), none, F.lit("hematoma")),
        (3, "renumber", F.lit(2), F.lit(5), none),
        (4, "add", F.lit(5), none, F.lit("necrosis")),
        (5, "remove", F.lit(9), none, none),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("seq"), F.lit(a).alias("action"), i.cast("int").alias("id"), to.cast("int").alias("new_id"),
                c.cast("string").alias("class"), F.lit(None).cast("array<array<double>>").alias("vertices"),
            )
            for n, a, i, to, c in edits
        ]
    )
    images = polygons.select("image_id", "label").distinct()
    changes = images.select("image_id", F.explode(rows).alias("e")).select("image_id", "e.*")
    left, refused = PG.edit_polygons(known, changes)
    kept = left.select("image_id", F.lit("polygon").alias("kind"), "id", F.col("class").alias("what"))
    return kept.unionByName(refused.select("image_id", F.lit("reject").alias("kind"), "id", F.col("reason").alias("what")))
