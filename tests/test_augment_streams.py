import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixloom import schema as S
from pixloom.operators import augment as A
from pixloom.operators import reports, trials
from pixloom.sources import ledger
from pixloom.streaming import telemetry as T
from helpers import image_frame, pixel_frame


def planes(seed, h=12, w=14):
    rng = np.random.default_rng(seed)
    out = {c: rng.random((h, w)) for c in "rgb"}
    pick = rng.choice(5, (h, w), p=[0.2, 0.15, 0.15, 0.1, 0.4])
    for i, c in enumerate(S.CLASSES):
        out[f"p_{c}"] = (pick == i).astype(float)
    return out


@pytest.fixture(scope="module")
def source(spark):
    images = pixels = None
    for i in (1, 2, 3):
        p = planes(i)
        im, px = image_frame(spark, p, i), pixel_frame(spark, p, i)
        images = im if images is None else images.unionByName(im)
        pixels = px if pixels is None else pixels.unionByName(px)
    return images, pixels.withColumn("image_id", F.col("image_id").cast("int"))


def test_quota(spark):
    totals = spark.createDataFrame([(1000,), (10,), (3,)], "total long")
    rows = A.quota(totals).collect()
    for total in (1000, 10, 3):
        assert sum(r["count"] for r in rows if r["total"] == total) == total
    assert {r["class"]: r["count"] for r in rows if r["total"] == 10} == {
        "scar": 2, "redness": 2, "hematoma": 3, "necrosis": 0, "background": 3}
    with pytest.raises(ValueError):
        A.quota(totals, {"scar": 50.0})


def test_balanced_dataset(spark, source, tmp_path):
    from pixloom.operators.stats import source_profile

    images, pixels = source
    profile = source_profile(pixels)
    counts = {"scar": 4, "background": 3}
    excluded = spark.createDataFrame([(2,)], "source_index int")
    stamp = F.lit("2025-01-01").cast("timestamp")
    args = (profile, counts, 5, (3, 3), 2)
    lineage, log = A.balanced_dataset(images, pixels, *args, excluded=excluded, created_at=stamp)
    rows = lineage.collect()
    assert lineage.columns[1:] == A.LINEAGE_COLUMNS and len(A.LINEAGE_COLUMNS) == 41
    assert sorted(r["augmented_index"] for r in rows) == list(range(1, 8))
    assert {r["source_index"] for r in rows} <= {1, 3}
    assert sum(s["accepted"] for s in log) == 7
    spread = (images.repartition(3), pixels.repartition(5, "col"))
    again, _ = A.balanced_dataset(*spread, *args, excluded=excluded, created_at=stamp)
    key = lambda r: r["augmented_index"]
    assert sorted(rows, key=key) == sorted(again.collect(), key=key)

    samples = A.render_samples(lineage, images)
    sizes = {r["sample_id"]: r["count"] for r in samples.groupBy("sample_id").count().collect()}
    for r in rows:
        assert sizes[r["sample_id"]] == r["patch_height"] * r["patch_width"]
    ledger.write_augmented(samples, lineage, str(tmp_path), excluded=excluded)
    meta, summary = ledger.read_augmented_metadata(spark, str(tmp_path))
    assert meta.count() == 7
    s = summary.first()
    assert s["distribution"] == counts and s["n_excluded"] == 1
    one = rows[0]["sample_id"]
    assert ledger.read_augmented_sample(spark, str(tmp_path), one).count() == sizes[one]
    assert reports.augmentation_summary(meta).first()["n_samples"] == 7


def test_smart_crop_of_small_and_absent(spark):
    zero, one = np.zeros((6, 6)), np.ones((6, 6))
    spot = zero.copy()
    spot[4, 4] = 1.0
    p = {f"p_{c}": zero for c in S.CLASSES}
    px = pixel_frame(spark, {**p, "p_scar": spot, "p_background": one - spot})
    samples = spark.createDataFrame([("a", 1, "scar"), ("b", 1, "necrosis"), ("c", 1, "background")],
                                    "sample_id string, source_index long, target_class string")
    got = {r["sample_id"]: r for r in A.smart_crop(px, samples, (3, 3), 1).collect()}
    assert (got["a"]["crop_y"], got["a"]["crop_x"]) == (4, 4)
    assert all(1 <= got[s][k] <= 4 for s in "bc" for k in ("crop_x", "crop_y"))
    whole = A.smart_crop(px, samples, (9, 9), 1).collect()
    assert all((r["crop_x"], r["crop_w"], r["crop_h"]) == (1, 6, 6) for r in whole)


def test_growth_states(spark):
    def sample(name, cells, h, w):
        zero = np.zeros((h, w))
        p = {f"p_{c}": zero for c in S.CLASSES}
        return pixel_frame(spark, {**p, "p_scar": cells, "p_background": 1 - cells}).withColumns(
            {"sample_id": F.lit(name), "target_class": F.lit("scar")})

    centre = np.zeros((8, 8))
    centre[3:5, 3:5] = 1
    px = sample("grow", centre, 8, 8).unionByName(sample("full", np.ones((8, 8)), 8, 8)).unionByName(
        sample("short", np.ones((5, 5)), 5, 5)).unionByName(sample("tiny", np.ones((1, 1)), 1, 1))
    got = {r["sample_id"]: r for r in A.grow_patch(px, (2, 2), 3).collect()}
    assert (got["grow"]["size_multiplier"], got["grow"]["growth_iterations"]) == (2, 2)
    assert (got["full"]["size_multiplier"], got["full"]["max_size_reached"]) == (3, True)
    assert (got["short"]["size_multiplier"], got["short"]["growth_iterations"]) == (2, 3)
    assert got["tiny"]["status"] == "too_small"


def test_growing_a_patch_reads_the_samples_once(spark):
    p = {f"p_{c}": np.full((4, 4), 0.2) for c in S.CLASSES}
    px = pixel_frame(spark, p).withColumns({"sample_id": F.lit("a"), "target_class": F.lit("scar")})
    made = px.mapInArrow(lambda batches: batches, px.schema)  # stands for the resampling
    grown = A.grow_patch(made, (2, 2), 3)
    assert grown.first()["status"] == "ok"
    plan = grown._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("MapInArrow") == 1


def test_class_cycle_takes_the_lowest_passing_attempt_and_few_more(spark):
    images = image_frame(spark, {**planes(3), "p_scar": np.full((12, 14), 0.6)}).withColumn("image_id", F.lit(1).cast("long"))
    even = images.withColumns({f"p_{c}": F.col("p_scar") for c in S.CLASSES})
    out, most = A.class_cycle_dataset(even, 6, 3, (4, 4))
    assert most == 1 and out.count() == 6
    mixed = image_frame(spark, planes(3)).withColumn("image_id", F.lit(1).cast("long"))
    found = []
    for tries in (2, 8):
        out, most = A.class_cycle_dataset(mixed, 15, 5, (3, 3), minimum_share=0.5, tries=tries)
        found.append(sorted((r["index"], r["attempt"]) for r in out.select("index", "attempt").collect()))
    assert found[0] == found[1] and max(a for _, a in found[0]) > 0


def test_grid_and_scaling(spark, tmp_path):
    lists = spark.createDataFrame([([1.0, 2.0], [5.0, 7.0, 9.0], [4.0])],
                                  "a array<double>, b array<double>, c array<double>")
    grid = trials.parameter_grid(lists)
    assert {(r["a"], r["b"], r["c"]) for r in grid.collect()} == {
        (a, b, 4.0) for a in (1, 2) for b in (5, 7, 9)}
    scaled = trials.scale_grid(grid, trials.list_bounds(lists), ["a", "b", "c"])
    assert {r["b"] for r in scaled.collect()} == {-1.0, 0.0, 1.0}
    back = trials.denormalise_parameters(scaled, {"b": (5.0, 9.0)})
    assert {r["b"] for r in back.collect()} == {5.0, 7.0, 9.0}
    out = grid.withColumn("output", -F.col("b"))
    trials.export_trials(out, str(tmp_path / "t"))
    rows = spark.read.csv(str(tmp_path / "t"), header=True, inferSchema=True).collect()
    assert all(r["output"] == -r["b"] for r in rows) and len(rows) == 6


def rows_of(deltas, kind="observation"):
    return [("run", k, kind, float(k), 10.0 * k, d, k) for k, d in enumerate(deltas, start=1)]


SF = "/root/testdata/sf0.001"
SCHEMA = ("run_id string, sec long, kind string, error double, absolute_performance double,"
          " observation_delta long, seq long")


def replay(spark, batches, tmp_path, make):
    """Each list of rows becomes one file, read one file at a time in order."""
    inbox = tmp_path / "in"
    frame = None
    for rows in batches:
        frame = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("sec"))
        frame.coalesce(1).write.mode("append").parquet(str(inbox))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(inbox))
    out = T.run_to_table(make(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    return sorted((r["emission"], r["observation"], r["value"]) for r in out.collect())


def test_rollup_keeps_state_between_batches(spark, tmp_path):
    rows = rows_of([3, 3, 3, 1, 20, 2])
    got = replay(spark, [rows[:2], rows[2:]], tmp_path, lambda s: T.error_rollup(s, 5))
    assert got == [(0, 3, 1.0), (0, 6, 2.0), (1, 9, 3.0), (1, 10, 4.0), (1, 30, 5.0)]


def test_reset_clears_history(spark, tmp_path):
    rows = rows_of([2, 2])
    control = [("run", 3, "reset", None, None, 0, 3)]
    later = [("run", k, "observation", float(k), 0.0, 2, k) for k in (4, 5, 6)]
    got = replay(spark, [rows + control + later], tmp_path, lambda s: T.error_rollup(s, 5))
    assert got == [(0, 2, 4.0), (0, 4, 5.0), (0, 6, 6.0)]


def walked(rows, limit, first_only):
    """The state machine row by row."""
    total, due, emission, held, out = 0, limit, 0, [], []
    for _, _, kind, value, _, delta, _ in rows:
        if kind != "observation":
            total, due, held = 0, limit, []
            if kind == "stop":
                break
            continue
        total, due = total + delta, due - delta
        if not (first_only and held):
            held.append((total, value))
        if due <= 0:
            out += [(emission, p, v) for p, v in held]
            due, held, emission = limit, [], emission + 1
    return out


@pytest.mark.parametrize("first_only", [False, True])
def test_stream_batch_and_walk_agree_on_deltas_resets_and_stops(spark, tmp_path, first_only):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(1, 400):
        kind = "stop" if k == 390 else "reset" if rng.random() < 0.03 else "observation"
        rows.append(("run", k, kind, float(k), 10.0 * k, int(rng.integers(0, 6)), k))
    want = sorted(walked(rows, 9, first_only))
    make = lambda s: T.rollup(s, 9, "error", first_only).where("kind = 'item'")
    assert replay(spark, [rows[:1], rows[1:130], rows[130:131], rows[131:]], tmp_path, make) == want
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("sec")).repartition(5)
    got = T.rollup_batch(frame, 9, "error", first_only).collect()
    assert sorted((r["emission"], r["observation"], r["value"]) for r in got) == want and len(want) > 40
    assert T.rollup_batch(frame.limit(0), 9, "error").count() == 0


def test_stop_of_the_control_run_ends_the_query(spark, tmp_path):
    inbox = tmp_path / "in"
    for k in range(4):
        rows = rows_of([1, 1, 1, 1]) + ([("control", 9, "stop", None, None, 0, 9)] if k == 1 else [])
        frame = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("sec"))
        frame.coalesce(1).write.mode("append").parquet(str(inbox))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(inbox))
    query = T.run_until_stop(T.rollup(stream, 2, "error"), str(tmp_path / "out"), str(tmp_path / "state"), "control")
    assert not query.isActive
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.where("kind = 'item'").count() == 8 and out.where("kind = 'stop'").count() == 1


@pytest.mark.parametrize("name", ["error_rollup", "performance_rollup", "snapshot_sample", "controlled_rollup"])
def test_rollups_follow_time_wherever_the_rows_lie(spark, tmp_path, name):
    import __spark_entry__ as entry
    from compare import TABLES, compare, connect

    for table in TABLES:
        (tmp_path / f"{table}.parquet").symlink_to(f"{SF}/{table}.parquet")
    (tmp_path / "events.parquet").unlink()
    events = pd.read_parquet(f"{SF}/events.parquet").sample(frac=1.0, random_state=3)
    events["ts"] = events["ts"].astype("datetime64[us]")
    events.to_parquet(tmp_path / "events.parquet", row_group_size=100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        con = connect(str(tmp_path))
        assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path)) is None
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_files_in_order_of_time(spark, tmp_path):
    rows = rows_of([1] * 500)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("sec")).repartition(7)
    T.write_in_order(frame, str(tmp_path / "in"), size=120)
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    seconds = [pd.read_parquet(f)["sec"] for f in files]
    assert sum(len(s) for s in seconds) == 500 and len(files) == 5
    assert all(a.max() < b.min() for a, b in zip(seconds, seconds[1:]))
    T.write_in_order(frame.limit(0), str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_small_emissions_share_a_frame():
    n = 5000
    kinds = np.array(["observation"] * n, dtype=object)
    kinds[100] = "reset"
    feed = T.Feed(2, False)
    frames = list(T._rows("run", feed.take(kinds, np.arange(n, dtype=float), np.ones(n, dtype=np.int64))))
    assert len(frames) == 1 and (frames[0]["kind"] == "item").sum() == 4998
    reset = frames[0][frames[0]["kind"] == "reset"]
    assert len(reset) == 1 and reset["value"].isna().all() and reset["observation"].isna().all()


def test_snapshot_is_the_first_item(spark, tmp_path):
    got = replay(spark, [rows_of([2] * 6)], tmp_path, lambda s: T.snapshot_sample(s, 4))
    assert [v for _, _, v in got] == [1.0, 3.0, 5.0]


def test_best_batch_size(spark):
    rates = spark.createDataFrame([(8, 1, 1.0), (8, 2, 9.0), (16, 1, 9.0), (16, 2, 2.0)],
                                  "config int, seq long, rate double")
    best = T.best_batch_size(rates, 1).where("is_best").first()
    assert (best["config"], best["mean_rate"]) == (8, 9.0)


def test_steps_fold_in_order_and_take_own_objects(spark):
    from pixloom.operators import resample as R

    row = {"scale_factor": 1.1, "shear_x_angle": 5.0, "shear_y_angle": -3.0, "rotation_angle": 30.0, "flip_type": "flipx"}
    stack = [np.random.default_rng(2).random((9, 11)) for _ in range(2)]
    m = np.eye(2)
    for name in R.CROP_FIRST:
        m = R.STEPS[name].matrix(row) @ m
    once = R.run_steps(stack, row, [R.Linear(lambda r: m)], 1)
    assert np.allclose(R.run_steps(stack, row, R.resolved(R.CROP_FIRST), 1), once)
    assert not np.allclose(R.run_steps(stack, row, R.resolved(R.GEOMETRY), 1)[0], once[0])
    dark = R.Effect(lambda planes, row, colours: np.concatenate([planes[:colours] * 0.5, planes[colours:]]))
    out = R.run_steps(stack, row, [dark], 1)
    assert np.allclose(out[0], stack[0] * 0.5) and np.allclose(out[1], np.rint(stack[1]))
    with pytest.raises(ValueError, match="unknown"):
        R.resolved(["no such"])


def test_remap_by_strips_is_remap_at_once(monkeypatch):
    from pixloom.functions import raster

    planes = [np.random.default_rng(3).random((20, 13)).astype(np.float32)]
    at = lambda r, c: (r * 0.7 + c * 0.1, c * 1.1 - 0.5)
    for method in ("nearest", "bilinear"):
        whole = raster.remap(planes, 17, 15, at, method, 0.25)
        monkeypatch.setattr(raster, "CELLS", 31)
        assert (raster.remap(planes, 17, 15, at, method, 0.25) == whole).all() and whole.dtype == np.float32
        monkeypatch.undo()
