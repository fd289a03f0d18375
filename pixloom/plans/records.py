"""Registered queries: visits, cohort timelines, ledgers, inventories, trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixloom import schema as S
from pixloom.functions.scalars import uniform
from pixloom.operators import augment, cohort, colours, polygons, stats, trials, visits
from pixloom.plans import proxies as X
from pixloom.plans.registry import query, rnd, rnd_as, rounded
from pixloom.plans.statistics import CLASS_LCH_SQL
from pixloom.session import scratch_path
from pixloom.sources import images as sources
from pixloom.sources import ledger


@query(
    "visit_ordinal",
    f"WITH {X.VIS}, {X.ORDERED} SELECT image_index, patient_id, visit_date, t FROM ordered",
)
def visit_ordinal(spark, sf):
    v = X.visits(spark, sf).select("image_index", "patient_id", "visit_date")
    return visits.visit_ordinal(v)


_GAPS = """gaps AS (SELECT patient_id, t AS gap, (lead(visit_date) OVER (PARTITION BY patient_id
  ORDER BY t) - visit_date)::INT AS days FROM ordered QUALIFY days IS NOT NULL)"""


@query("visit_gaps", f"WITH {X.VIS}, {X.ORDERED}, {_GAPS} SELECT * FROM gaps")
def visit_gaps(spark, sf):
    return visits.visit_gaps(visit_ordinal(spark, sf))


@query(
    "gap_histogram",
    f"""WITH {X.VIS}, {X.ORDERED}, {_GAPS},
    n AS (SELECT gap, days, count(*) AS n FROM gaps GROUP BY ALL),
    f AS (SELECT gap, unnest(range(min(days), max(days) + 1))::INT AS days FROM n GROUP BY gap)
    SELECT f.gap, f.days, coalesce(n, 0) AS n FROM f LEFT JOIN n USING (gap, days)""",
)
def gap_histogram(spark, sf):
    return visits.gap_histogram(visit_gaps(spark, sf))


_M = ("l", "c", "h")
_COHORT = f"""
stat AS (SELECT class, t, count(*) AS n, {", ".join(
    f"count({m}) AS n_{m}, avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std,"
    f" quantile_cont({m}, 0.25) AS {m}_q25, median({m}) AS {m}_median,"
    f" quantile_cont({m}, 0.75) AS {m}_q75" for m in _M)} FROM timeline GROUP BY class, t)
"""
_COLS = [f"{m}_{k}" for m in _M for k in ("mean", "std", "q25", "median", "q75")]


@query(
    "cohort_stats",
    f"""WITH {X.VIS}, {X.ORDERED}, {X.TIMELINE}, {_COHORT}
    SELECT class, t, n, n_l, n_c, n_h, {rnd_as(*_COLS)} FROM stat""",
)
def cohort_stats(spark, sf):
    return rounded(cohort.cohort_stats(X.event_timeline(spark, sf)))


@query(
    "cohort_stats_first_patient_length",
    f"""WITH {X.VIS}, {X.ORDERED}, timeline0 AS (SELECT patient_id, t, class, value AS l,
      value / 2.0 AS c, value * 7.0 - floor(value * 7.0 / 360.0) * 360.0 AS h FROM ordered),
    lim AS (SELECT max(t) AS k FROM timeline0 WHERE patient_id = (SELECT min(patient_id) FROM timeline0)),
    timeline AS (SELECT timeline0.* FROM timeline0, lim WHERE t <= k), {_COHORT}
    SELECT class, t, n, {rnd_as('l_mean', 'l_median')} FROM stat""",
)
def cohort_stats_first_patient_length(spark, sf):
    out = cohort.cohort_stats(X.event_timeline(spark, sf), mode="reference")
    return rounded(out.select("class", "t", "n", "l_mean", "l_median"))


def _shown(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL THEN '---' ELSE printf('%.1f', round_even({c}, 1)) END AS {c}"
    )


@query(
    "cohort_table",
    f"""WITH {X.VIS}, {X.ORDERED}, timeline AS (SELECT patient_id, t, class, value * 1.001 AS l,
      value * 0.5001 AS c, value * 0.3003 AS h FROM ordered), {_COHORT}
    SELECT class, 'T' || t AS timepoint,
    {", ".join(_shown(f"{m}_{k}") for m in _M for k in ("mean", "std"))} FROM stat""",
)
def cohort_table(spark, sf):
    tl = X.event_timeline(spark, sf).withColumns(
        {
            "c_median": F.col("l_median") * 0.5001,
            "h_median": F.col("l_median") * 0.3003,
            "l_median": F.col("l_median") * 1.001,
        }
    )
    return cohort.cohort_table(cohort.cohort_stats(tl))


_SCALE = {"l": "100.0", "c": "150.0", "h": "360.0"}
_BANDS = " UNION ALL ".join(
    f"""SELECT class, t, '{m}' AS measure, {m}_mean / {s} AS mean,
    ({m}_mean - {m}_std) / {s} AS lower, ({m}_mean + {m}_std) / {s} AS upper,
    {m}_median / {s} AS median, {m}_q25 / {s} AS q25, {m}_q75 / {s} AS q75 FROM stat
    WHERE {m}_std IS NOT NULL"""
    for m, s in _SCALE.items()
)


@query(
    "cohort_bands",
    f"""WITH {X.VIS}, {X.ORDERED}, {X.TIMELINE}, {_COHORT}, bands AS ({_BANDS})
    SELECT class, t, measure, {rnd_as('mean', 'lower', 'upper', 'median', 'q25', 'q75')}
    FROM bands""",
)
def cohort_bands(spark, sf):
    return rounded(cohort.cohort_bands(cohort.cohort_stats(X.event_timeline(spark, sf))))


@query(
    "patient_timeline",
    f"""WITH {X.VIS}, {CLASS_LCH_SQL},
    kept AS (SELECT * FROM vis WHERE image_index IN (SELECT image_id FROM px)),
    o AS (SELECT image_index, patient_id, visit_date, row_number() OVER (PARTITION BY patient_id
          ORDER BY visit_date, image_index) AS t FROM kept)
    SELECT patient_id, t, visit_date, c.* FROM o
    JOIN (SELECT image_id AS image_index, * EXCLUDE (image_id) FROM class_lch) c USING (image_index)""",
)
def patient_timeline(spark, sf):
    lch = colours.class_lch(X.pixels(spark, sf))
    v = X.visits(spark, sf).select("image_index", "patient_id", "visit_date")
    return rounded(cohort.patient_timeline(v, lch))


@query(
    "patient_timeline_region",
    f"""WITH {X.VIS}, {X.PX}, m AS (SELECT * FROM px WHERE p_background > 0.6), {X.lch_ctes('m')},
    s AS (SELECT image_id, {", ".join(f"median({v}) AS {v}_median" for v in 'lch')},
          count(*) AS pixel_count FROM lch GROUP BY image_id),
    o AS (SELECT image_index, patient_id, visit_date, row_number() OVER (PARTITION BY patient_id
          ORDER BY visit_date, image_index) AS t FROM vis
          WHERE image_index IN (SELECT image_id FROM px))
    SELECT image_index, patient_id, t, {rnd_as('l_median', 'c_median', 'h_median')},
    coalesce(pixel_count, 0) AS pixel_count, 'polygon_region' AS class
    FROM o LEFT JOIN s ON s.image_id = o.image_index""",
)
def patient_timeline_region(spark, sf):
    px = X.pixels(spark, sf)
    lch = colours.mask_lch(px, F.col("p_background") > 0.6).where("pixel_count > 0")
    v = X.visits(spark, sf).select("image_index", "patient_id", "visit_date")
    images = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"))
    out = cohort.patient_timeline_polygon(v, images, lch)
    return rounded(
        out.select("image_index", "patient_id", "t", "l_median", "c_median", "h_median",
                   "pixel_count", "class")
    )


@query(
    "failed_patients",
    f"""WITH {X.VIS} SELECT DISTINCT patient_id FROM vis WHERE patient_id NOT IN
    (SELECT patient_id FROM vis WHERE image_index IN (SELECT vec_id FROM embeddings WHERE label = 3))""",
)
def failed_patients(spark, sf):
    v = X.visits(spark, sf).select("image_index", "patient_id", "visit_date")
    measured = X.table(spark, sf, "embeddings").where("label = 3").select(
        F.col("vec_id").alias("image_id"), F.lit(1.0).alias("l_median")
    )
    return cohort.failed_patients(v, cohort.patient_timeline(v, measured))


@query(
    "trajectories",
    f"""WITH {X.VIS}, {X.ORDERED}, {X.TIMELINE} SELECT patient_id, class, t, {rnd('l / 100.0')} AS l,
    {rnd('c / 150.0')} AS c, {rnd('h / 360.0')} AS h FROM timeline""",
)
def trajectories(spark, sf):
    return rounded(cohort.trajectories(X.event_timeline(spark, sf)))


@query(
    "image_counts",
    """WITH c AS (SELECT o_custkey AS patient_id, count(*) AS n_images FROM orders GROUP BY 1)
    SELECT patient_id, n_images, n_images = 10 AS exact FROM c""",
)
def image_counts(spark, sf):
    orders = X.table(spark, sf, "orders").select(F.col("o_custkey").alias("patient_id"))
    counts = visits.image_counts(orders)
    exact = visits.filter_exact_count(counts, 10).select("patient_id", F.lit(True).alias("exact"))
    return visits.filter_exact_count(counts, 0).join(exact, "patient_id", "left").fillna(
        {"exact": False}
    )


@query(
    "count_of_counts",
    """WITH c AS (SELECT o_custkey, count(*) AS n_images FROM orders GROUP BY 1)
    SELECT 0::BIGINT AS n_images, count(*) AS n_patients FROM c UNION ALL
    SELECT n_images, count(*) FROM c WHERE n_images >= 2 GROUP BY n_images""",
)
def count_of_counts(spark, sf):
    orders = X.table(spark, sf, "orders").select(F.col("o_custkey").alias("patient_id"))
    return visits.count_of_counts(visits.image_counts(orders))


@query(
    "distinct_sizes",
    "SELECT DISTINCT p_size FROM part WHERE p_size IS NOT NULL",
)
def distinct_sizes(spark, sf):
    return visits.distinct_sorted(X.table(spark, sf, "part"), "p_size")


# Texts of very different shape stand in for typed ledger fields.
_RAW = """raw AS (SELECT event_id AS image_index,
  CASE event_id % 8 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y/%m/%d')
    WHEN 2 THEN '2024-02-30' WHEN 3 THEN '' WHEN 4 THEN '2999-01-01' WHEN 5 THEN '2024-1-9'
    ELSE strftime(ts, '%Y-%m-%d') END AS visit_date,
  CASE event_id % 5 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN ' ' || user_id::VARCHAR || ' '
    WHEN 2 THEN '-' || user_id::VARCHAR WHEN 3 THEN event_type ELSE user_id::VARCHAR END AS patient_id,
  repeat(props, (event_id % 97)::INT) AS info FROM events)"""


def _raw_ledger(spark, sf):
    ev = X.table(spark, sf, "events")
    k, m = F.col("event_id") % 8, F.col("event_id") % 5
    good = F.date_format("ts", "yyyy-MM-dd")
    date = (
        F.when(k == 1, F.date_format("ts", "yyyy/MM/dd"))
        .when(k == 2, F.lit("2024-02-30"))
        .when(k == 3, F.lit(""))
        .when(k == 4, F.lit("2999-01-01"))
        .when(k == 5, F.lit("2024-1-9"))
        .otherwise(good)
    )
    uid = F.col("user_id").cast("string")
    patient = (
        F.when(m == 1, F.concat(F.lit(" "), uid, F.lit(" ")))
        .when(m == 2, F.concat(F.lit("-"), uid))
        .when(m == 3, F.col("event_type"))
        .otherwise(uid)
    )
    info = F.expr("repeat(props, cast(event_id % 97 as int))")
    return ev.select(
        F.col("event_id").alias("image_index"), date.alias("visit_date"),
        patient.alias("patient_id"), info.alias("info"),
    )


def _reason_sql(empty_ok: bool) -> str:
    missing = "visit_date = ''"
    first = "false" if empty_ok else missing
    return f"""CASE WHEN {first} THEN 'date format'
    WHEN NOT ({missing}) AND NOT regexp_matches(visit_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN 'date format'
    WHEN NOT ({missing}) AND try_cast(visit_date AS DATE) IS NULL THEN 'not a date'
    WHEN NOT ({missing}) AND try_cast(visit_date AS DATE) > DATE '2026-01-01' THEN 'date in future'
    WHEN trim(patient_id) = '' THEN 'patient missing'
    WHEN try_cast(trim(patient_id) AS INT) IS NULL THEN 'patient not a number'
    WHEN try_cast(trim(patient_id) AS INT) <= 0 THEN 'patient not positive'
    WHEN length(info) > 500 THEN 'info too long' END"""


@query(
    "validate_visits",
    f"""WITH {_RAW}, c AS (SELECT image_index, {_reason_sql(True)} AS lenient,
    {_reason_sql(False)} AS strict FROM raw) SELECT image_index,
    coalesce(lenient, 'valid') AS lenient, coalesce(strict, 'valid') AS strict FROM c""",
)
def validate_visits(spark, sf):
    raw = _raw_ledger(spark, sf)
    today = F.lit("2026-01-01").cast("date")
    out = []
    for profile, name in (("optional_date", "lenient"), ("required_date", "strict")):
        good, bad = visits.validate_visits(raw, profile, today)
        out.append(
            good.select("image_index", F.lit("valid").alias(name)).unionByName(
                bad.select("image_index", F.col("reason").alias(name))
            )
        )
    return out[0].join(out[1], "image_index")


@query(
    "clean_ledger",
    f"""WITH {_RAW} SELECT image_index, coalesce(visit_date, '') AS visit_date,
    try_cast(trim(patient_id) AS INT) AS patient_id, coalesce(info, '') AS info FROM raw
    WHERE try_cast(trim(patient_id) AS INT) IS NOT NULL""",
)
def clean_ledger(spark, sf):
    return visits.clean_visits(
        _raw_ledger(spark, sf).withColumn("filename", F.lit(None).cast("string"))
    ).drop("filename")


@query(
    "upsert_visits",
    f"""WITH {X.VIS}, base AS (SELECT image_index, visit_date, patient_id, props AS info,
      DATE '2024-01-01' AS created_at, DATE '2024-01-01' AS updated_at FROM vis),
    ch AS (SELECT l_orderkey AS image_index, max(l_shipdate)::DATE AS visit_date,
      count(*)::VARCHAR AS info FROM lineitem GROUP BY l_orderkey)
    SELECT coalesce(b.image_index, c.image_index) AS image_index,
    coalesce(c.visit_date, b.visit_date) AS visit_date, b.patient_id,
    coalesce(c.info, b.info) AS info, coalesce(b.created_at, DATE '2025-06-01') AS created_at,
    CASE WHEN c.image_index IS NOT NULL THEN DATE '2025-06-01' ELSE b.updated_at END AS updated_at
    FROM base b FULL JOIN ch c ON b.image_index = c.image_index""",
)
def upsert_visits(spark, sf):
    day = F.lit("2024-01-01").cast("date")
    base = visits.stamp_visits(
        X.visits(spark, sf).select(
            "image_index", "visit_date", "patient_id", F.col("props").alias("info")
        ),
        day,
    )
    changes = X.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("image_index")).agg(
        F.max("l_shipdate").cast("date").alias("visit_date"),
        F.count(F.lit(1)).cast("string").alias("info"),
    )
    return visits.upsert_visits(base, changes, F.lit("2025-06-01").cast("date"))


@query(
    "append_and_latest",
    f"""WITH {X.VIS}, k AS (SELECT patient_id AS image_index, max(ts) AS ts FROM vis GROUP BY 1)
    SELECT image_index, 'new' AS info, TIMESTAMP '2025-06-01 00:00:00' AS updated_at FROM k
    WHERE image_index % 2 = 0 UNION ALL
    SELECT k.image_index, v.props AS info, k.ts FROM k JOIN vis v
    ON v.patient_id = k.image_index AND v.ts = k.ts WHERE k.image_index % 2 = 1""",
)
def append_and_latest(spark, sf):
    old = X.visits(spark, sf).select(
        F.col("patient_id").alias("image_index"), F.col("props").alias("info"),
        F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
    )
    fresh = old.where("image_index % 2 = 0").select("image_index").distinct().withColumn(
        "info", F.lit("new")
    )
    stamp = F.lit("2025-06-01 00:00:00").cast("timestamp")
    merged = visits.append_visit(old, fresh, stamp)
    return visits.latest_versions(merged).select("image_index", "info", "updated_at")


@query(
    "find_visit",
    f"""WITH {X.VIS}, f AS (SELECT patient_id AS image_index, arg_min(visit_date, image_index) AS visit_date,
      min(image_index) AS first_event FROM vis GROUP BY 1)
    SELECT c_custkey AS image_index, f.first_event IS NOT NULL AS found, visit_date, first_event
    FROM customer LEFT JOIN f ON f.image_index = c_custkey""",
)
def find_visit(spark, sf):
    led = X.visits(spark, sf).select(
        F.col("patient_id").alias("image_index"), "visit_date",
        F.col("image_index").alias("first_event"),
    )
    wanted = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("image_index"))
    return visits.find_visit(led, wanted, "first_event")


@query(
    "join_images",
    f"""WITH {X.VIS} SELECT label, count(*) AS visits FROM vis JOIN embeddings ON vec_id = image_index
    GROUP BY label UNION ALL SELECT -1, count(*) FROM vis
    WHERE image_index NOT IN (SELECT vec_id FROM embeddings)""",
)
def join_images(spark, sf):
    images = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    found, lost = visits.join_images(X.visits(spark, sf), images)
    return (
        found.groupBy("label").agg(F.count(F.lit(1)).alias("visits"))
        .unionByName(lost.agg(F.lit(-1).alias("label"), F.count(F.lit(1)).alias("visits")))
    )


# ---- files and inventories ---------------------------------------------------------------------


@query(
    "verify_dataset",
    """WITH f AS (SELECT CASE WHEN doc_id % 50 = 7 THEN -1 ELSE doc_id END AS image_id,
      n_chars AS length FROM documents JOIN labels USING (doc_id)),
    m AS (SELECT count(*) AS n FROM documents WHERE doc_id > 0 AND doc_id NOT IN
      (SELECT image_id FROM f WHERE image_id > 0))
    SELECT m.n AS n_missing, (SELECT count(*) FROM f WHERE image_id <= 0) AS n_invalid,
    (SELECT sum(length)::BIGINT FROM f) AS total_bytes, false AS ok FROM m""",
)
def verify_dataset(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", "n_chars")
    known = X.table(spark, sf, "labels").select("doc_id")
    files = docs.join(known, "doc_id").select(
        F.when(F.col("doc_id") % 50 == 7, -1).otherwise(F.col("doc_id")).alias("image_id"),
        F.col("n_chars").alias("length"),
    )
    expected = docs.where("doc_id > 0").select(F.col("doc_id").alias("image_id"))
    verdict, _ = sources.verify_dataset(expected, files)
    return verdict


@query(
    "missing_top10",
    """SELECT doc_id + 1 AS image_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    ORDER BY doc_id LIMIT 10""",
)
def missing_top10(spark, sf):
    expected = X.table(spark, sf, "documents").select((F.col("doc_id") + 1).alias("image_id"))
    files = X.table(spark, sf, "labels").select(
        (F.col("doc_id") + 1).alias("image_id"), F.lit(1).alias("length")
    )
    return sources.verify_dataset(expected, files, shown=10)[1]


@query(
    "skip_existing",
    """SELECT doc_id AS image_id, 'todo' AS kind, 1::BIGINT AS n FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT NULL, 'skipped', count(*) FROM labels
    WHERE doc_id IN (SELECT doc_id FROM documents)""",
)
def skip_existing(spark, sf):
    todo = X.table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"))
    done = X.table(spark, sf, "labels").select(F.col("doc_id").alias("image_id"))
    rest, skipped = sources.skip_existing(todo, done)
    return rest.select("image_id", F.lit("todo").alias("kind"), F.lit(1).cast("long").alias("n")).unionByName(
        skipped.select(
            F.lit(None).cast("long").alias("image_id"), F.lit("skipped").alias("kind"),
            F.col("n_skipped").alias("n"),
        )
    )


# Documents act as recorded polygons, labelled documents as mask files on disk.
_NAMES = """
p AS (SELECT doc_id AS image_id, (doc_id % 7)::INT AS polygon_id,
  CASE WHEN doc_id % 2 = 0 THEN 'In_Narbe' ELSE 'Umgebung' END AS class_name FROM documents),
e AS (SELECT *, 'image_' || lpad(image_id::VARCHAR, greatest(3, length(image_id::VARCHAR))::INT, '0') ||
  '_polygon_' || class_name || '_' || polygon_id || '.png' AS expected FROM p),
r AS (SELECT *, CASE WHEN image_id % 3 = 0 THEN replace(expected, class_name, 'Alt_Name')
  WHEN image_id % 3 = 1 THEN expected END AS mask_file FROM e),
fl AS (SELECT r.image_id, coalesce(mask_file, expected) AS name FROM r
  JOIN labels l ON l.doc_id = r.image_id)
"""


def _recorded(spark, sf):
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"))
    p = docs.select(
        "image_id",
        (F.col("image_id") % 7).cast("int").alias("polygon_id"),
        F.when(F.col("image_id") % 2 == 0, "In_Narbe").otherwise("Umgebung").alias("class_name"),
    )
    expected = polygons.mask_filename(
        F.col("image_id"), F.col("class_name"), F.col("polygon_id")
    )
    p = p.withColumn("expected", expected)
    p = p.withColumn(
        "mask_file",
        F.when(
            F.col("image_id") % 3 == 0,
            F.replace(F.col("expected"), F.col("class_name"), F.lit("Alt_Name")),
        ).when(F.col("image_id") % 3 == 1, F.col("expected")),
    )
    known = X.table(spark, sf, "labels").select(F.col("doc_id").alias("image_id"))
    files = p.join(known, "image_id").select(
        "image_id", F.coalesce("mask_file", "expected").alias("name")
    )
    return p, files


@query(
    "rename_plan",
    f"""WITH {_NAMES} SELECT image_id, polygon_id, coalesce(mask_file, expected) AS old_name,
    expected AS new_name, CASE WHEN coalesce(mask_file, expected) = expected THEN 'unchanged'
    WHEN coalesce(mask_file, expected) NOT IN (SELECT name FROM fl) THEN 'missing'
    ELSE 'renamed' END AS status FROM r""",
)
def rename_plan(spark, sf):
    p, files = _recorded(spark, sf)
    return polygons.rename_plan(p, files)


@query(
    "mask_filenames_parsed",
    f"""WITH {_NAMES} SELECT image_id, expected AS name, image_id::INT AS parsed_id, class_name AS parsed_class,
    polygon_id AS parsed_polygon, split_part(expected, '_polygon', 1) AS folder FROM r""",
)
def mask_filenames_parsed(spark, sf):
    p, _ = _recorded(spark, sf)
    parsed = polygons.parse_mask_filename(F.col("expected"))
    return p.select(
        "image_id", F.col("expected").alias("name"),
        parsed["image_index"].alias("parsed_id"), parsed["class_name"].alias("parsed_class"),
        parsed["polygon_id"].alias("parsed_polygon"),
        polygons.folder_of(F.col("expected")).alias("folder"),
    )


@query(
    "mask_format",
    f"""WITH {_NAMES}, f2 AS (SELECT image_id, CASE WHEN image_id % 5 = 0 THEN 'image_polygon_mask.png'
      WHEN image_id % 5 = 1 THEN 'other.png' ELSE name END AS name FROM fl),
    rec AS (SELECT image_id, bool_or(mask_file IS NOT NULL) AS recorded FROM r WHERE image_id % 4 = 0
      GROUP BY 1),
    nm AS (SELECT image_id, bool_or(regexp_matches(name, '_polygon_.+_\\d+\\.png$')) AS sep,
      bool_or(name LIKE '%\\_polygon\\_mask.png' ESCAPE '\\') AS single FROM f2 GROUP BY 1)
    SELECT p.image_id, CASE WHEN coalesce(recorded, false) OR coalesce(sep, false) THEN 'separate_files'
    WHEN coalesce(single, false) THEN 'single_file' ELSE 'none' END AS mask_format
    FROM p LEFT JOIN rec USING (image_id) LEFT JOIN nm USING (image_id)""",
)
def mask_format(spark, sf):
    p, files = _recorded(spark, sf)
    named = files.withColumn(
        "name",
        F.when(F.col("image_id") % 5 == 0, "image_polygon_mask.png")
        .when(F.col("image_id") % 5 == 1, "other.png")
        .otherwise(F.col("name")),
    )
    return polygons.mask_format(p.where("image_id % 4 = 0"), named, p)


@query(
    "resolve_mask_source",
    """WITH i AS (SELECT doc_id AS image_id FROM documents),
    s AS (SELECT i.image_id, CASE WHEN image_id % 3 = 0 THEN 'c' || image_id END AS a,
      CASE WHEN image_id IN (SELECT doc_id FROM labels) THEN 's' || image_id END AS b,
      CASE WHEN image_id % 2 = 0 THEN 'r' || image_id END AS c FROM i)
    SELECT image_id, coalesce(a, b, c) AS path, CASE WHEN a IS NOT NULL THEN 'composite'
    WHEN b IS NOT NULL THEN 'single' WHEN c IS NOT NULL THEN 'rebuilt' END AS source FROM s""",
)
def resolve_mask_source(spark, sf):
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"))
    known = X.table(spark, sf, "labels").select(F.col("doc_id").alias("image_id"))

    def named(df, letter):
        return df.select(
            "image_id", F.concat(F.lit(letter), F.col("image_id").cast("string")).alias("path")
        )

    return polygons.resolve_mask_source(
        docs,
        [
            ("composite", named(docs.where("image_id % 3 = 0"), "c")),
            ("single", named(known, "s")),
            ("rebuilt", named(docs.where("image_id % 2 = 0"), "r")),
        ],
    )


@query(
    "attach_mask_files",
    f"""WITH {_NAMES}, k AS (SELECT image_id, coalesce(mask_file, expected) AS name FROM r)
    SELECT image_id, name, name IN (SELECT name FROM fl) AS present FROM k""",
)
def attach_mask_files(spark, sf):
    p, files = _recorded(spark, sf)
    found, lost = polygons.attach_mask_files(p, files.withColumn("path", F.col("name")))
    return found.select("image_id", "name", F.lit(True).alias("present")).unionByName(
        lost.select("image_id", "name", F.lit(False).alias("present"))
    )


@query(
    "class_mask_join",
    """WITH k AS (SELECT vec_id AS image_id, label, (label % 4 + 2)::BIGINT AS n FROM embeddings)
    SELECT image_id, CASE WHEN n < 5 THEN 'missing class mask'
    WHEN image_id % 10 = 3 THEN 'mask size differs from input' ELSE 'ok' END AS reason FROM k""",
)
def class_mask_join(spark, sf):
    from pixloom.operators.pixels import join_class_masks

    images = X.images(spark, sf).select("image_id", "height", "width", "r", *S.P_COLUMNS)
    labels = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    long = images.join(labels, "image_id").select(
        "image_id", "label",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("i"), F.lit(c).alias("class"),
                        F.when((F.col("image_id") % 10 == 3) & F.lit(c == "scar"), 4)
                        .otherwise(F.col("height")).alias("height"),
                        F.col("width").alias("width"), F.col(S.p_col(c)).alias("plane"),
                    )
                    for i, c in enumerate(S.CLASSES)
                ]
            )
        ).alias("e"),
    ).select("image_id", "label", "e.*").where("i < label % 4 + 2")
    inputs = images.select("image_id", "height", "width", "r")
    good, bad = join_class_masks(inputs, long)
    return good.select("image_id", F.lit("ok").alias("reason")).unionByName(bad)


@query(
    "polygon_documents",
    """WITH d AS (SELECT event_id, (event_id % 4)::INT AS version FROM events)
    SELECT event_id AS image_id, 1 AS list_pos, '' AS class_name, 1 AS sample_number, false AS complete
    FROM d WHERE version IN (2, 3)
    UNION ALL SELECT event_id, 2, 'Umgebung', 4, true FROM d WHERE version IN (2, 3)""",
)
def polygon_documents(spark, sf):
    ev = X.table(spark, sf, "events").select("event_id")
    text = F.concat(
        F.lit('{"version":'), (F.col("event_id") % 4).cast("string"),
        F.lit(',"image_index":'), F.col("event_id").cast("string"),
        F.lit(',"polygons":[{"id":1,"class":"scar","vertices":[[1,2],[3,4]]},'
              '{"id":2,"class":"hematoma","class_name":"Umgebung","sample_number":4,'
              '"vertices":[[0.5,1.5]],"complete":true,"lch_data":null}]}'),
    )
    docs = ev.select(F.from_json(text, S.POLYGON_DOCUMENT).alias("d")).select("d.*")
    first, _ = ledger.explode_polygons(docs)
    # Written to files of many documents and read once more, the rows must be the same.
    path = scratch_path(spark, "polygons")
    ledger.write_polygons(first, path)
    again, _ = ledger.read_polygons(spark, path)
    return again.select("image_id", "list_pos", "class_name", "sample_number", "complete")


# ---- trials and draws --------------------------------------------------------------------------


@query(
    "parameter_grid",
    """WITH d AS (SELECT DISTINCT l_discount AS v FROM lineitem), t AS (SELECT DISTINCT l_tax AS v FROM lineitem),
    s AS (SELECT DISTINCT p_size AS v FROM part)
    SELECT (round((((d.v - (SELECT min(v) FROM d)) / ((SELECT max(v) FROM d) - (SELECT min(v) FROM d)) - 0.5) * 2)::DOUBLE + 1.3e-9::DOUBLE, 6) + 0.0::DOUBLE) AS discount,
    (round((((t.v - (SELECT min(v) FROM t)) / ((SELECT max(v) FROM t) - (SELECT min(v) FROM t)) - 0.5) * 2)::DOUBLE + 1.3e-9::DOUBLE, 6) + 0.0::DOUBLE) AS tax,
    (round((((s.v - (SELECT min(v) FROM s)) / ((SELECT max(v) FROM s) - (SELECT min(v) FROM s)) - 0.5) * 2)::DOUBLE + 1.3e-9::DOUBLE, 6) + 0.0::DOUBLE) AS size
    FROM d, t, s""",
)
def parameter_grid(spark, sf):
    li = X.table(spark, sf, "lineitem").agg(
        F.array_sort(F.collect_set("l_discount")).alias("discount"),
        F.array_sort(F.collect_set("l_tax")).alias("tax"),
    )
    sizes = X.table(spark, sf, "part").agg(F.array_sort(F.collect_set("p_size")).alias("size"))
    lists = li.withColumn("size", sizes.scalar())
    grid = trials.parameter_grid(lists)
    names = ["discount", "tax", "size"]
    return rounded(trials.scale_grid(grid, trials.list_bounds(lists), names).select(*names))


@query(
    "rank_trials",
    f"""SELECT l_orderkey, l_linenumber, {rnd('((l_discount / 2) + 0.5) * (0.001 - 0.00001) + 0.00001')} AS rate,
    {rnd('l_extendedprice')} AS output FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 25""",
)
def rank_trials(spark, sf):
    t = X.table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("output"), "l_orderkey", "l_linenumber",
        F.col("l_discount").alias("rate"),
    )
    plain = trials.denormalise_parameters(t, {"rate": (0.00001, 0.001)})
    return rounded(trials.rank_trials(plain, "output", 25))


@query(
    "random_batch",
    f"""WITH n AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings),
    d AS (SELECT unnest(range(300)) AS draw),
    k AS (SELECT draw, {X.index_sql(5, 'batch', '(SELECT count(*) FROM embeddings)', 'draw')} + 1 AS rn
          FROM d) SELECT draw, vec_id, label FROM k JOIN n USING (rn)""",
)
def random_batch(spark, sf):
    e = X.table(spark, sf, "embeddings").select("vec_id", "label")
    return trials.random_batch(e, 300, 5, "vec_id")


@query(
    "quota",
    """WITH n AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
    q AS (SELECT source, total, round_even(total * 15 / 100.0, 0) AS s, round_even(total * 15 / 100.0, 0) AS r,
      round_even(total * 30 / 100.0, 0) AS h, round_even(total * 5 / 100.0, 0) AS k FROM n)
    SELECT source, total, 'scar' AS class, s::BIGINT AS count FROM q
    UNION ALL SELECT source, total, 'redness', r::BIGINT FROM q
    UNION ALL SELECT source, total, 'hematoma', h::BIGINT FROM q
    UNION ALL SELECT source, total, 'necrosis', k::BIGINT FROM q
    UNION ALL SELECT source, total, 'background', (total - s - r - h - k)::BIGINT FROM q""",
)
def quota(spark, sf):
    totals = X.table(spark, sf, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("total")
    )
    return augment.quota(totals)


_GRID = {
    "scale_factor": ("scale", 0.9, 0.01, 21), "shear_x_angle": ("shear_x", -10.0, 0.1, 201),
    "shear_y_angle": ("shear_y", -10.0, 0.1, 201),
    "rotation_angle": ("rotation", 1.0, 0.1, 3591),
    "brightness_factor": ("brightness", 0.8, 0.1, 5),
    "saturation_offset": ("saturation", -0.2, 0.1, 5), "blur_sigma": ("sigma", 1.0, 0.1, 21),
}


@query(
    "draw_parameters",
    f"""SELECT event_id, {", ".join(
        f"{rnd(f"round(({X.index_sql(9, n, str(k), 'event_id')} * {by} + {lo})::DOUBLE, 4)")} AS {c}"
        for c, (n, lo, by, k) in _GRID.items())},
    (['flipx', 'flipy', 'noop'])[{X.index_sql(9, 'flip', '3', 'event_id')} + 1] AS flip_type,
    ({X.index_sql(9, 'crop_y', '51', 'event_id')} + 1)::INT AS final_crop_y_start,
    ({X.index_sql(9, 'crop_x', '101', 'event_id')} + 1)::INT AS final_crop_x_start,
    ({X.index_sql(9, 'kernel', '3', 'event_id')} * 2 + 3)::INT AS blur_kernel_size FROM events""",
)
def draw_parameters(spark, sf):
    ev = X.table(spark, sf, "events").select("event_id")
    out = augment.draw_parameters(ev, 9, ["event_id"], (100, 150), (50, 50))
    return rounded(out.select(
        "event_id", *_GRID, "flip_type", "final_crop_y_start", "final_crop_x_start",
        "blur_kernel_size",
    ))


_PROFILE = f"""{X.PX}, profile AS (SELECT image_id AS source_index, {", ".join(
    f"sum(p_{c}) / count(*) * 100 AS {c}" for c in S.CLASSES)} FROM px GROUP BY image_id)"""


@query(
    "pick_source",
    f"""WITH {_PROFILE}, u AS (SELECT * FROM profile WHERE source_index NOT IN (8, 16)),
    w AS ({" UNION ALL ".join(f"SELECT source_index, '{c}' AS target_class, {c} + 0.01 AS w FROM u"
                              for c in S.CLASSES)}),
    c AS (SELECT *, sum(w) OVER (PARTITION BY target_class ORDER BY source_index) /
          sum(w) OVER (PARTITION BY target_class) AS hi FROM w),
    d AS (SELECT event_id, (['scar','redness','hematoma','necrosis','background'])[event_id % 5 + 1]
          AS target_class, {X.uniform_sql(3, 'source', 'event_id')} AS u FROM events),
    r AS (SELECT target_class, source_index, hi - w / sum(w) OVER (PARTITION BY target_class) AS lo, hi
          FROM c)
    SELECT event_id, d.target_class, r.source_index FROM d JOIN r
    ON r.target_class = d.target_class AND d.u > r.lo AND d.u <= r.hi""",
)
def pick_source(spark, sf):
    profile = stats.source_profile(X.pixels(spark, sf))
    excluded = spark.createDataFrame([(8,), (16,)], "source_index long")
    intervals = augment.source_intervals(profile, S.CLASSES, excluded)
    classes = F.array(*[F.lit(c) for c in S.CLASSES])
    draws = X.table(spark, sf, "events").select(
        "event_id", F.get(classes, (F.col("event_id") % 5).cast("int")).alias("target_class"),
        uniform(3, "source", F.col("event_id")).alias("u"),
    )
    return augment.pick_source(draws, intervals).drop("u")


@query(
    "shuffle_and_first",
    f"""SELECT doc_id, source FROM documents ORDER BY {X.uniform_sql(11, 'shuffle', 'doc_id')}, doc_id
    LIMIT 100""",
)
def shuffle_and_first(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", "source")
    placed = augment.shuffled_places(docs, 11, ["doc_id"])
    return augment.first_n(placed, "place", 100).drop("place")


@query(
    "stratified_pick",
    f"""WITH o AS (SELECT event_id, event_type, {X.uniform_sql(4, 'pick', 'event_id')} AS u FROM events),
    h AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY u, event_id) AS k FROM o)
    SELECT event_id, event_type FROM h ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, u, event_id LIMIT 10""",
)
def stratified_pick(spark, sf):
    ev = X.table(spark, sf, "events").select("event_id", "event_type")
    return augment.stratified_pick(ev, 4, "event_id", "event_type", 10)


@query(
    "cumulative_weights",
    f"""SELECT l_suppkey, l_id, {rnd('sum(q) OVER (PARTITION BY l_suppkey ORDER BY l_id)')} AS cum FROM
    (SELECT l_suppkey, l_orderkey AS l_id, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)""",
)
def cumulative_weights(spark, sf):
    from pixloom.operators.scale import blocked_cumsum

    li = X.table(spark, sf, "lineitem").groupBy(
        "l_suppkey", F.col("l_orderkey").alias("l_id")
    ).agg(F.sum("l_quantity").alias("q"))
    return rounded(blocked_cumsum(li, F.col("q"), "l_id", ["l_suppkey"]).drop("q"))


@query(
    "intermediate_size",
    """SELECT p_partkey, round_even(p_size * (p_partkey % 4 + 1) * 2.4, 0)::INT AS side FROM part""",
)
def intermediate_size(spark, sf):
    return X.table(spark, sf, "part").select(
        "p_partkey",
        augment.intermediate_size_column(F.col("p_size"), F.col("p_partkey") % 4 + 1).alias("side"),
    )


@query(
    "cycle_slots",
    f"""WITH s AS (SELECT unnest(range(15)) AS i), o AS (SELECT
      (['scar','scar','scar','scar','scar','scar','redness','redness','redness','redness','redness',
        'hematoma','necrosis','necrosis','necrosis'])[i + 1] AS class,
      row_number() OVER (ORDER BY {X.uniform_sql(2, 'cycle', 'i')}) - 1 AS slot FROM s)
    SELECT class, count(*) AS n FROM events JOIN o ON slot = event_id % 15 GROUP BY class""",
)
def cycle_slots(spark, sf):
    ev = X.table(spark, sf, "events").select("event_id")
    return ev.groupBy(augment.cycle_class(F.col("event_id"), 2).alias("class")).agg(
        F.count(F.lit(1)).alias("n")
    )
