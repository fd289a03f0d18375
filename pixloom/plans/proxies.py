"""Images, visits, polygons and predictions derived from the supplied tables.

Every embedding is read as an 8x8 image whose planes are shifted copies of the
vector; every event is a visit. The SQL twins serve the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixloom import schema as S
from pixloom.functions.scalars import clamp

SIDE = 8
CELLS = SIDE * SIDE
CHANNEL_SHIFT = {"r": 0, "g": 21, "b": 42}
CLASS_SHIFT = {"scar": 7, "redness": 15, "hematoma": 29, "necrosis": 37, "background": 51}


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table; the schema of a path is read from its footers once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        "embedding",
        F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("i"),
    )

    def at(shift: int):
        return F.get("embedding", (F.col("i") + shift) % CELLS).cast("double")

    planes = {c: clamp(at(s) + 0.5, 0.0, 1.0) for c, s in CHANNEL_SHIFT.items()}
    weights = {
        f"w_{c}": F.exp(at(s) * 6.0) * (2.0 if c == "background" else 1.0)
        for c, s in CLASS_SHIFT.items()
    }
    wide = cells.select(
        "image_id",
        F.expr(f"i div {SIDE} + 1").cast("int").alias("row"),
        (F.col("i") % SIDE + 1).cast("int").alias("col"),
        F.lit(SIDE).alias("height"),
        F.lit(SIDE).alias("width"),
        *[v.alias(k) for k, v in planes.items()],
        *[v.alias(k) for k, v in weights.items()],
    )
    total = sum(F.col(w) for w in weights)
    return wide.select(
        "image_id", "row", "col", "height", "width", *planes,
        *[(F.col(f"w_{c}") / total).alias(S.p_col(c)) for c in S.CLASSES],
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same images as planar rows; built row by row, no shuffle."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    base = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), e.alias("e"))
    steps = F.sequence(F.lit(0), F.lit(CELLS - 1))

    def plane(shift: int, f):
        return F.transform(steps, lambda i: f(F.get("e", (i + shift) % CELLS)))

    def weight(c: str):
        factor = 2.0 if c == "background" else 1.0
        return plane(CLASS_SHIFT[c], lambda x: F.exp(x * 6.0) * factor).alias(f"w_{c}")

    channels = [
        plane(s, lambda x: clamp(x + 0.5, 0.0, 1.0)).alias(c) for c, s in CHANNEL_SHIFT.items()
    ]
    wide = base.select("image_id", *channels, *[weight(c) for c in S.CLASSES])
    zipped = F.arrays_zip(*[F.col(f"w_{c}") for c in S.CLASSES])

    def share(c: str):
        return F.transform(
            zipped, lambda z: z[f"w_{c}"] / sum(z[f"w_{k}"] for k in S.CLASSES)
        ).alias(S.p_col(c))

    return wide.select(
        "image_id",
        F.lit(SIDE).alias("height"),
        F.lit(SIDE).alias("width"),
        *CHANNEL_SHIFT,
        *[share(c) for c in S.CLASSES],
    )


MASK_LEVEL = 0.25


def mask_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same images with hard class masks, as annotated pictures have them."""
    df = images(spark, sf_dir)

    def hard(name: str):
        return F.transform(name, lambda v: F.when(v > MASK_LEVEL, 1.0).otherwise(0.0))

    return df.withColumns({p: hard(p) for p in S.P_COLUMNS})


def mask_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pixels(spark, sf_dir)
    return df.withColumns(
        {p: F.when(F.col(p) > MASK_LEVEL, 1.0).otherwise(0.0) for p in S.P_COLUMNS}
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ledger rows."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("image_index"),
        F.col("user_id").alias("patient_id"),
        F.to_date("ts").alias("visit_date"),
        F.col("event_type").alias("class"),
        "value",
        "props",
        "ts",
    )


def event_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered visits of events with colour stand-ins from ``value``."""
    from pixloom.operators.visits import visit_ordinal

    numbered = visit_ordinal(visits(spark, sf_dir))
    return numbered.select(
        "patient_id",
        "t",
        "class",
        F.col("value").alias("l_median"),
        (F.col("value") / 2.0).alias("c_median"),
        F.pmod(F.col("value") * 7.0, F.lit(360.0)).alias("h_median"),
    )


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two polygons per image whose corners follow its label; every third label is open."""
    base = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.col("label").cast("double").alias("lab"), "label"
    )
    lab = F.col("lab")

    def ring(points):
        return F.array(*[F.array(*[p if hasattr(p, "alias") else F.lit(float(p)) for p in xy])
                         for xy in points])

    first = ring([(lab * 0.3 + 1.0, 1.0), (7.0, 2.0), (8.5, lab * 0.2 + 5.0), (4.0, 8.0),
                  (1.0, 6.0)])
    second = ring([(3.0, 3.0), (lab * 0.5 + 4.0, 3.0), (4.0, lab * 0.4 + 4.5)])
    parts = F.array(
        *[
            F.struct(
                F.lit(k).alias("polygon_id"),
                F.lit(c).alias("class"),
                F.lit(S.CLASS_NAMES_DE[c]).alias("class_name"),
                v.alias("vertices"),
                (F.col("label") % 3 != k % 3).alias("complete"),
            )
            for k, c, v in ((1, "scar", first), (2, "redness", second))
        ]
    )
    return base.select("image_id", "label", F.posexplode(parts).alias("pos", "p")).select(
        "image_id", "label", (F.col("pos") + 1).alias("list_pos"), "p.*"
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-class pixels: logits from one shift of the embedding, truth from the class shares."""
    px = pixels(spark, sf_dir)
    logits = [F.col("r") * 4, F.col("g") * 4, F.col("b") * 4, F.col("p_scar") * 3,
              (1.0 - F.col("r")) * 4]
    return px.select(
        "image_id", "row", "col", "height", "width",
        F.array(*logits).alias("logits"),
        F.array(*[F.rint(S.p_col(c)) for c in S.CLASSES]).alias("truth"),
    )


def label_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-class rows: truth from document quality, logits from document length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    known = table(spark, sf_dir, "labels").select("doc_id", "quality")
    z = F.ln(F.col("n_chars") + 1.0) - 6.0
    return docs.join(known, "doc_id").select(
        F.col("doc_id").alias("image_id"),
        "source",
        F.array(z, -z).alias("logits"),
        F.array(F.col("quality").cast("double"), 1.0 - F.col("quality")).alias("truth"),
    )


def telemetry(events: DataFrame) -> DataFrame:
    """Events as observations of one run per event type."""
    return events.select(
        F.col("event_type").alias("run_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit("observation").alias("kind"),
        F.col("value").alias("error"),
        (F.col("value") * 10.0).alias("absolute_performance"),
        F.lit(1).cast("long").alias("observation_delta"),
        F.col("event_id").alias("seq"),
    )


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage-shaped rows over line items: every parameter is arithmetic of the row."""
    li = table(spark, sf_dir, "lineitem")
    qty, line = F.col("l_quantity"), F.col("l_linenumber")
    classes = F.array(*[F.lit(c) for c in S.CLASSES])
    share = {c: (F.col("l_discount") * 100 + i * 7 + line) for i, c in enumerate(S.CLASSES)}
    total = sum(share.values())
    return li.select(
        (F.col("l_orderkey") * 8 + line).alias("augmented_index"),
        F.col("l_suppkey").alias("source_index"),
        F.get(classes, (F.col("l_partkey") % 5).cast("int")).alias("target_class"),
        (qty * 0.01 + 0.8).alias("scale_factor"),
        (F.col("l_tax") * 100 - 4.0).alias("shear_x_angle"),
        (F.col("l_discount") * 100 - 5.0).alias("shear_y_angle"),
        (qty * 7.0).alias("rotation_angle"),
        (F.col("l_tax") * 5 + 0.8).alias("brightness_factor"),
        (F.col("l_discount") * 4 - 0.2).alias("saturation_offset"),
        (qty * 0.04 + 1.0).alias("blur_sigma"),
        *[(v / total * 100.0).alias(f"{c}_percentage") for c, v in share.items()],
        ((line - 1) % 4 + 1).cast("int").alias("size_multiplier"),
        (((line - 1) % 4 + 1) * 50).cast("int").alias("patch_height"),
        (((line - 1) % 4 + 1) * 100).cast("int").alias("patch_width"),
        ((line + F.col("l_partkey")) % 4 + 1).cast("int").alias("growth_iterations"),
        (F.col("l_extendedprice") % 100.0).alias("actual_fg_percentage"),
        (((line - 1) % 4 == 3) & (F.col("l_extendedprice") % 100.0 > 50.0)).alias(
            "max_size_reached"
        ),
    )


# ---- SQL twins -------------------------------------------------------------------------------


def _at(shift: int) -> str:
    return f"v[(i + {shift}) % {CELLS} + 1]::DOUBLE"


_CHANNELS = ", ".join(
    f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_at(s)} + 0.5)) AS {c}"
    for c, s in CHANNEL_SHIFT.items()
)
_WEIGHTS = ", ".join(
    f"exp({_at(s)} * 6.0) * {2.0 if c == 'background' else 1.0} AS w_{c}"
    for c, s in CLASS_SHIFT.items()
)
_TOTAL = "(" + " + ".join(f"w_{c}" for c in S.CLASSES) + ")"
_SHARES = ", ".join(f"w_{c} / {_TOTAL} AS p_{c}" for c in S.CLASSES)

PX = f"""
px0 AS (SELECT vec_id AS image_id, embedding AS v, unnest(range({CELLS})) AS i FROM embeddings),
px1 AS (SELECT image_id, (i // {SIDE} + 1)::INT AS y, (i % {SIDE} + 1)::INT AS x,
        {_CHANNELS}, {_WEIGHTS} FROM px0),
px AS (SELECT image_id, y, x, {SIDE} AS height, {SIDE} AS width, r, g, b, {_SHARES} FROM px1)
"""

CLASS_LONG = "clong AS (" + " UNION ALL ".join(
    f"SELECT image_id, y, x, r, g, b, '{c}' AS class, {i} AS ci, p_{c} AS p FROM px"
    for i, c in enumerate(S.CLASSES, start=1)
) + ")"

VIS = """
vis AS (SELECT event_id AS image_index, user_id AS patient_id, ts::DATE AS visit_date,
        event_type AS class, value, props, ts FROM events)
"""

ORDERED = """
ordered AS (SELECT *, row_number() OVER (PARTITION BY patient_id
            ORDER BY visit_date, image_index) AS t FROM vis)
"""

TIMELINE = """
timeline AS (SELECT patient_id, t, class, value AS l, value / 2.0 AS c,
             value * 7.0 - floor(value * 7.0 / 360.0) * 360.0 AS h FROM ordered)
"""

POLY = """
poly0 AS (SELECT vec_id AS image_id, label, label::DOUBLE AS lab FROM embeddings),
corner AS (
  SELECT image_id, 1 AS polygon_id, 1 AS k, 5 AS n, lab * 0.3 + 1.0 AS vx, 1.0::DOUBLE AS vy FROM poly0
  UNION ALL SELECT image_id, 1, 2, 5, 7.0, 2.0 FROM poly0
  UNION ALL SELECT image_id, 1, 3, 5, 8.5, lab * 0.2 + 5.0 FROM poly0
  UNION ALL SELECT image_id, 1, 4, 5, 4.0, 8.0 FROM poly0
  UNION ALL SELECT image_id, 1, 5, 5, 1.0, 6.0 FROM poly0
  UNION ALL SELECT image_id, 2, 1, 3, 3.0, 3.0 FROM poly0
  UNION ALL SELECT image_id, 2, 2, 3, lab * 0.5 + 4.0, 3.0 FROM poly0
  UNION ALL SELECT image_id, 2, 3, 3, 4.0, lab * 0.4 + 4.5 FROM poly0),
edge AS (SELECT a.image_id, a.polygon_id, a.vx AS x1, a.vy AS y1, b.vx AS x2, b.vy AS y2
         FROM corner a JOIN corner b ON a.image_id = b.image_id AND a.polygon_id = b.polygon_id
         AND b.k = CASE WHEN a.k = 1 THEN a.n ELSE a.k - 1 END),
hit AS (SELECT px.image_id, e.polygon_id, px.y, px.x, any_value(px.r) AS r, any_value(px.g) AS g,
        any_value(px.b) AS b
        FROM px JOIN edge e ON px.image_id = e.image_id
        GROUP BY px.image_id, e.polygon_id, px.y, px.x
        HAVING sum(CASE WHEN (e.y1 > px.y) != (e.y2 > px.y) AND
               px.x < (e.x2 - e.x1) * (px.y - e.y1) / (e.y2 - e.y1) + e.x1
               THEN 1 ELSE 0 END) % 2 = 1)
"""


def lin(x: str) -> str:
    return f"(CASE WHEN {x} <= 0.04045 THEN {x} / 12.92 ELSE pow(({x} + 0.055) / 1.055, 2.4) END)"


def _labf(t: str) -> str:
    return (
        f"(CASE WHEN {t} > {216.0 / 24389.0!r} THEN cbrt({t}) "
        f"ELSE ({t} * {24389.0 / 27.0!r} + 16.0) / 116.0 END)"
    )


def lch_ctes(source: str, out: str = "lch") -> str:
    """CTEs adding l, c, h to a table with r, g, b."""
    return f"""
{out}1 AS (SELECT *, {lin('r')} AS lr, {lin('g')} AS lg, {lin('b')} AS lb FROM {source}),
{out}2 AS (SELECT *, (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047 AS tx,
          (0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb) AS ty,
          (0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883 AS tz FROM {out}1),
{out}3 AS (SELECT *, {_labf('tx')} AS fx, {_labf('ty')} AS fy, {_labf('tz')} AS fz FROM {out}2),
{out}4 AS (SELECT *, fy * 116.0 - 16.0 AS l, (fx - fy) * 500.0 AS aa, (fy - fz) * 200.0 AS bb
          FROM {out}3),
{out} AS (SELECT *, sqrt(aa * aa + bb * bb) AS c,
          CASE WHEN degrees(atan2(bb, aa)) < 0 THEN degrees(atan2(bb, aa)) + 360.0
          ELSE degrees(atan2(bb, aa)) END AS h FROM {out}4)
"""


def hsv_ctes(source: str, out: str = "hsv") -> str:
    return f"""
{out}1 AS (SELECT *, greatest(r, g, b) AS val, greatest(r, g, b) - least(r, g, b) AS d
          FROM {source}),
{out}2 AS (SELECT *, CASE WHEN d = 0 THEN 0.0 WHEN val = r THEN (g - b) / d
          WHEN val = g THEN (b - r) / d + 2.0 ELSE (r - g) / d + 4.0 END AS h6 FROM {out}1),
{out} AS (SELECT *, CASE WHEN h6 < 0 THEN h6 + 6.0 ELSE h6 END / 6.0 AS hue,
          CASE WHEN val = 0 THEN 0.0 ELSE d / val END AS sat FROM {out}2)
"""


_L_TOTAL = "(" + " + ".join(
    f"(l_discount * 100 + {i * 7} + l_linenumber)" for i in range(5)
) + ")"
LINEAGE = f"""
lineage AS (SELECT l_orderkey * 8 + l_linenumber AS augmented_index, l_suppkey AS source_index,
  (['scar','redness','hematoma','necrosis','background'])[l_partkey % 5 + 1] AS target_class,
  l_quantity * 0.01 + 0.8 AS scale_factor, l_tax * 100 - 4.0 AS shear_x_angle,
  l_discount * 100 - 5.0 AS shear_y_angle, l_quantity * 7.0 AS rotation_angle,
  l_tax * 5 + 0.8 AS brightness_factor, l_discount * 4 - 0.2 AS saturation_offset,
  l_quantity * 0.04 + 1.0 AS blur_sigma,
  {", ".join(f"(l_discount * 100 + {i * 7} + l_linenumber) / {_L_TOTAL} * 100.0 AS {c}_percentage"
             for i, c in enumerate(S.CLASSES))},
  (l_linenumber - 1) % 4 + 1 AS size_multiplier, ((l_linenumber - 1) % 4 + 1) * 50 AS patch_height,
  ((l_linenumber - 1) % 4 + 1) * 100 AS patch_width,
  (l_linenumber + l_partkey) % 4 + 1 AS growth_iterations,
  l_extendedprice % 100.0 AS actual_fg_percentage,
  ((l_linenumber - 1) % 4 = 3) AND (l_extendedprice % 100.0 > 50.0) AS max_size_reached
  FROM lineitem)
"""


def uniform_sql(seed: int, name: str, *ids: str) -> str:
    """SQL twin of ``scalars.uniform``."""
    parts = " || '|' || ".join(f"({i})::VARCHAR" for i in ids)
    return (
        f"(('0x' || substr(md5('{seed}|{name}|' || {parts}), 1, 13))::BIGINT::DOUBLE"
        f" / {float(1 << 52)!r})"
    )


def index_sql(seed: int, name: str, size: str, *ids: str) -> str:
    return f"floor({uniform_sql(seed, name, *ids)} * ({size}))::BIGINT"
