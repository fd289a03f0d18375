import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixloom import schema as S
from pixloom.operators import cohort, polygons, visits
from pixloom.sources import images as sources
from pixloom.sources import ledger


def png(array: np.ndarray) -> bytes:
    """Minimal 8-bit PNG, grey or RGB."""
    h, w = array.shape[:2]
    colour = 2 if array.ndim == 3 else 0
    raw = b"".join(b"\0" + array[i].astype(np.uint8).tobytes() for i in range(h))

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    head = struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(
        b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("set")
    rng = np.random.default_rng(6)
    truth = {}
    for i in (1, 2, 3):
        d = root / f"image_{i:03d}"
        d.mkdir()
        rgb = rng.integers(0, 256, (4, 6, 3))
        truth[i] = rgb
        (d / f"image_{i:03d}_raw_adj.png").write_bytes(png(rgb))
        for c in S.CLASSES:
            shape = (3, 6) if (i == 2 and c == "scar") else (4, 6)
            (d / f"image_{i:03d}_seg_{c}.png").write_bytes(png(rng.integers(0, 2, shape) * 255))
        if i != 3:
            mask = np.zeros((4, 6))
            mask[1:3, 1:4] = 255
            (d / f"image_{i:03d}_polygon_mask.png").write_bytes(png(mask))
    return str(root), truth


def test_images_are_read_in_rgb_order(spark, folder):
    root, truth = folder
    rows = sources.load_single(spark, root, "raw_adj").collect()
    assert sorted(r["image_id"] for r in rows) == [1, 2, 3]
    for r in rows:
        got = np.stack([np.array(r[c]).reshape(4, 6) for c in "rgb"], axis=2)
        assert np.allclose(got, truth[r["image_id"]] / 255.0, atol=1e-6)


def test_pairs_need_matching_sizes(spark, folder):
    good, bad = sources.load_pairs(spark, folder[0])
    assert sorted(r["image_id"] for r in good.select("image_id").collect()) == [1, 3]
    assert [tuple(r) for r in bad.collect()] == [(2, "mask size differs from input")]


def test_inventory_and_verification(spark, folder):
    files = sources.inventory(spark, folder[0]).where("kind = 'polygon_mask'")
    verdict, missing = sources.verify_dataset(
        spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "image_id int"), files)
    v = verdict.first()
    assert (v["n_missing"], v["ok"]) == (2, False) and v["total_bytes"] > 0
    assert [r["image_id"] for r in missing.collect()] == [3, 4]


def test_polygon_dataset_isolates_failures(spark, folder, tmp_path):
    shares, errors = sources.generate_polygon_dataset(spark, folder[0], str(tmp_path / "out"))
    assert [r["image_id"] for r in shares.collect()] == [1]
    reasons = {r["image_id"]: r["reason"] for r in errors.collect()}
    assert reasons == {2: "mask size differs from input", 3: "no polygon mask"}
    saved, missing = sources.read_dataset(spark, str(tmp_path / "out"), "polygon", 2)
    outside = saved.where("row = 1")
    assert outside.agg(F.sum("p_scar"), F.min("p_background")).first() == (0.0, 1.0)
    assert [r["image_id"] for r in missing.collect()] == [2]


def test_dense_arrays_are_column_major(spark, tmp_path):
    cube = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    (tmp_path / "mask_007.bin").write_bytes(cube.tobytes(order="F"))
    (tmp_path / "mask_008.bin").write_bytes(b"short")
    rows = {r["image_id"]: r for r in
            sources.read_dense_bin(spark, str(tmp_path / "*.bin"), (2, 4, 3)).collect()}
    assert np.allclose(np.array(rows[7]["planes"][1]), cube[:, :, 1].ravel() / 255.0)
    assert rows[8]["planes"] is None and "24 bytes" in rows[8]["problem"]


GOOD = ["2025-11-29", "2024-01-15", "2020-12-31", ""]
BAD = ["not-a-date", "25-11-29", "2025/11/29", "2025.11.29", "11-29-2025", "2025-1-29", "2025-11-9",
       "2025-13-01", "2025-00-01", "2025-02-30", "2999-01-01"]


def test_date_validation(spark):
    df = spark.createDataFrame([(d, "5", "") for d in GOOD + BAD],
                               "visit_date string, patient_id string, info string")
    today = F.lit("2026-01-01").cast("date")
    ok, bad = visits.validate_visits(df, "optional_date", today)
    assert sorted(r["visit_date"] for r in ok.collect()) == sorted(GOOD)
    assert bad.count() == len(BAD)
    strict, _ = visits.validate_visits(df, "required_date", today)
    assert "" not in [r["visit_date"] for r in strict.collect()]
    long = spark.createDataFrame([("", "5", "x" * 501), ("", "0", ""), ("", "a", "")], df.schema)
    reasons = {r["reason"] for r in visits.validate_visits(long, today=today)[1].collect()}
    assert reasons == {"info too long", "patient not positive", "patient not a number"}


def test_exact_count_and_population(spark):
    counts = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 5)], "patient_id int, n_images long")
    assert [r["patient_id"] for r in visits.filter_exact_count(counts, 2).collect()] == [3]
    assert visits.filter_exact_count(counts, 0).count() == 4
    listed = {r["n_images"]: r["n_patients"] for r in visits.count_of_counts(counts).collect()}
    assert listed == {0: 4, 2: 1, 3: 1, 5: 1}


def test_bad_dates_and_missing_images_shift_ordinals(spark):
    raw = spark.createDataFrame(
        [(1, "2024-01-05", 7), (2, "2024-02-30", 7), (3, "2024-01-02", 7), (4, "2024-03-01", 7),
         (5, "2024-01-01", 8)], "image_index int, visit_date string, patient_id int")
    lch = spark.createDataFrame([(i, "scar", float(i)) for i in (1, 2, 4)],
                                "image_id int, class string, l_median double")
    out = cohort.patient_timeline(cohort.datable_visits(raw), lch)
    assert {(r["image_index"], r["t"]) for r in out.collect()} == {(1, 1), (4, 2)}
    lost = cohort.failed_patients(raw, out).collect()
    assert [r["patient_id"] for r in lost] == [8]


def test_nan_measures_are_ignored(spark):
    nan = float("nan")
    tl = spark.createDataFrame(
        [(1, "scar", 1, 10.0, 1.0, nan), (2, "scar", 1, 20.0, 3.0, nan), (3, "scar", 1, nan, 5.0, nan)],
        "patient_id int, class string, t int, l_median double, c_median double, h_median double")
    stats = cohort.cohort_stats(tl)
    r = stats.first()
    assert (r["l_mean"], r["l_median"], r["n_l"], r["h_mean"]) == (15.0, 15.0, 2, None)
    assert {b["measure"] for b in cohort.cohort_bands(stats).collect()} == {"l", "c"}
    assert cohort.cohort_table(stats).first()["h_mean"] == "---"


def test_ledger_and_polygon_documents(spark, tmp_path):
    csv = tmp_path / "visits.csv"
    csv.write_text("image_index,filename,visit_date,patient_id,info,created_at,updated_at\n"
                   "1,,2024-01-01,3,,,\n2,a.png,,x,hello,,\n")
    rows = ledger.read_visits(spark, str(csv)).collect()
    assert [(r["image_index"], r["filename"], r["info"]) for r in rows] == [(1, "", "")]
    new = spark.createDataFrame([(9, "b.png", "2024-02-02", 4, "")],
                                "image_index int, filename string, visit_date string, patient_id int, info string")
    ledger.write_visit(new, str(tmp_path / "log"))
    ledger.write_visit(new, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log")).collect()
    assert len(back) == 2 and back[0]["created_at"] == back[0]["updated_at"]

    doc = {"version": 2, "image_index": 4, "polygons": [
        {"id": 1, "class": "scar", "vertices": [[1, 2], [3, 4], [5, 1]], "complete": True,
         "lch_data": {"L_median": 50.0, "C_median": 1.0, "h_median": 2.0, "count": 9}}]}
    old = {"version": 1, "image_index": 5, "polygons": []}
    for name, d in (("a", doc), ("b", old)):
        (tmp_path / f"{name}.json").write_text(json.dumps(d, indent=1))
    polys, refused = ledger.read_polygon_files(spark, str(tmp_path / "*.json"))
    p = polys.first()
    assert (p["class_name"], p["sample_number"], p["lch_data"]["count"]) == ("", 1, 9)
    assert [r["image_index"] for r in refused.collect()] == [5]
    ledger.write_polygons(polys, str(tmp_path / "docs"), "pic")
    again, _ = ledger.read_polygons(spark, str(tmp_path / "docs" / "*.json"))
    row = again.first()
    assert row["version"] == 3 and row["mask_file"] == "pic_004_polygon__1.png"
    assert row["vertices"] == p["vertices"]
    # many documents in one file
    many = polys.withColumn("image_id", F.explode(F.sequence(F.lit(1), F.lit(6)))).coalesce(1)
    ledger.write_polygons(many, str(tmp_path / "many"))
    again, _ = ledger.read_polygons(spark, str(tmp_path / "many"))
    assert sorted(r["image_id"] for r in again.collect()) == [1, 2, 3, 4, 5, 6]


def test_polygon_edits(spark):
    lch = S.POLYGON_STRUCT["lch_data"].dataType
    base = spark.createDataFrame([(1, 1, "scar"), (1, 2, "scar"), (1, 5, "scar")],
                                 "image_id int, id int, class string").withColumns(
        {"vertices": F.lit(None).cast("array<array<double>>"), "lch_data": F.lit(None).cast(lch)})
    rows = [(1, 1, "add", None, None, "n1"), (1, 2, "add", 2, None, "n2"), (1, 3, "add", 9, None, "n3"),
            (1, 4, "remove", 1, None, None), (1, 5, "renumber", 5, 0, None)]
    changes = spark.createDataFrame(
        rows, "image_id int, seq int, action string, id int, new_id int, class string"
    ).withColumn("vertices", F.lit(None).cast("array<array<double>>"))
    done, rejected = polygons.edit_polygons(base, changes)
    assert {(r["id"], r["class"]) for r in done.collect()} == {
        (2, "scar"), (5, "scar"), (9, "n3"), (10, "n1"), (11, "n2")}
    assert [(r["id"], r["reason"]) for r in rejected.collect()] == [(5, "id not positive")]

    # edits that meet: two renumbers to one id, an add of that id, two edits of one polygon
    rows = [(1, 1, "renumber", 1, 3, None), (1, 2, "add", 3, None, "n1"), (1, 3, "renumber", 2, 3, None),
            (1, 4, "recolour", 5, None, None), (1, 5, "replace", 5, None, "n2"), (1, 6, "renumber", 2, 8, None)]
    changes = spark.createDataFrame(
        rows, "image_id int, seq int, action string, id int, new_id int, class string"
    ).withColumn("vertices", F.lit(None).cast("array<array<double>>"))
    done, rejected = polygons.edit_polygons(base, changes)
    ids = [r["id"] for r in done.collect()]
    assert len(ids) == len(set(ids)) == 4 and {3, 5} <= set(ids)
    assert {(r["seq"], r["reason"]) for r in rejected.collect()} >= {(3, "id in use"), (5, "polygon already edited")}


def test_ingest_reads_every_file_once(spark, tmp_path):
    from pixloom.streaming import telemetry as T

    inbox = tmp_path / "in" / "image_001"
    inbox.mkdir(parents=True)
    blank = np.zeros((2, 2))

    def drain():
        stream = sources_stream().select("path", "length")
        return T.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state")).count()

    def sources_stream():
        return T.ingest_stream(spark, str(tmp_path / "in"), per_trigger=1)

    (inbox / "image_001_raw_adj.png").write_bytes(png(blank))
    assert drain() == 1
    (inbox / "image_001_seg_scar.png").write_bytes(png(blank))
    assert drain() == 2


def test_one_corrupt_file_is_one_error(spark, folder, tmp_path):
    import shutil

    root = tmp_path / "images"
    shutil.copytree(folder[0], root)
    good, bad = sources.load_pairs(spark, str(root))
    kept, refused = {r["image_id"] for r in good.collect()}, {r["image_id"] for r in bad.collect()}
    broken = min(kept)
    next(root.rglob(f"*_{broken:03d}_raw_adj.png")).write_bytes(b"no picture")
    good, bad = sources.load_pairs(spark, str(root))
    assert {r["image_id"] for r in good.collect()} == kept - {broken}
    reasons = {r["image_id"]: r["reason"] for r in bad.collect()}
    assert set(reasons) == refused | {broken} and reasons[broken].startswith("unreadable file")


def test_histogram_counts_what_lies_outside(spark):
    from pixloom.operators import stats

    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.4, 1.0, 2.0, 3.0)], "v double")
    rows = {r["bin"]: r["n"] for r in stats.histogram(df, "v", 2, lo=0.0, hi=1.0).collect()}
    assert rows == {-1: 1, 0: 2, 1: 1, 2: 2}
