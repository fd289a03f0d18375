import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixloom.functions import colour
from pixloom.operators import colours, metrics, resample, warp
from pixloom.operators.pixels import apply_mask, dominant_class, binarise_round
from helpers import image_frame, pixel_frame, plane_of

BRAD = np.array(colour.BRADFORD)


@pytest.mark.parametrize("src, ref", [("D65", "D50"), ("A", "D65"), ("F11", "E")])
def test_bradford_matrix(spark, src, ref):
    a, b = np.array(colour.ILLUMINANTS[src]), np.array(colour.ILLUMINANTS[ref])
    want = np.linalg.inv(BRAD) @ np.diag((BRAD @ b) / (BRAD @ a)) @ BRAD
    m = colour.bradford_matrix([F.lit(v) for v in a], [F.lit(v) for v in b])
    row = spark.range(1).select(*[m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)]).first()
    assert np.allclose(np.array(row).reshape(3, 3), want, atol=1e-10)
    moved = colour.adapt_colour([F.lit(v) for v in a], [F.lit(v) for v in a], [F.lit(v) for v in b])
    assert np.allclose(np.array(spark.range(1).select(*moved).first()), b, atol=1e-9)


def test_balancing_to_the_own_white_changes_nothing(spark):
    rng = np.random.default_rng(4)
    planes = {c: rng.random((5, 6)) for c in "rgb"}
    for p in planes.values():
        p[0, 0] = 0.0
    px = pixel_frame(spark, planes)
    white = spark.createDataFrame([(1, *colour.ILLUMINANTS["D50"])],
                                  "image_id int, white_x double, white_y double, white_z double")
    out = colours.white_balance(px, white, "D50").orderBy("row", "col").toPandas()
    for c in "rgb":
        # The two sRGB matrices are inverse to each other only to seven digits.
        assert np.allclose(out[c], planes[c].ravel(), atol=2e-5)
    assert out.loc[0, ["r", "g", "b"]].tolist() == [0, 0, 0]


def test_white_point_falls_back_to_d65(spark):
    px = pixel_frame(spark, {c: np.zeros((2, 2)) for c in "rgb"})
    r = colours.white_point(px).first()
    assert (r["white_x"], r["white_y"], r["white_z"]) == colour.ILLUMINANTS["D65"]
    assert r["white_pixels"] == 0


def test_hsv_and_lch_of_primaries(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (1.0, 1.0, 1.0)], "r double, g double, b double")
    hsv = df.select(*colour.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))).collect()
    assert tuple(hsv[0]) == (0, 1, 1) and hsv[1][0] == pytest.approx(1 / 3)
    assert tuple(hsv[2])[1:] == (0, 1)
    lch = df.select(*colour.rgb_to_lch(F.col("r"), F.col("g"), F.col("b"))).collect()
    assert lch[0][0] == pytest.approx(53.24, abs=0.01)
    assert lch[0][2] == pytest.approx(40.0, abs=0.05)
    assert lch[2][0] == pytest.approx(100, abs=0.01) and lch[2][1] < 0.05


def test_dominant_class_ties_and_rounding(spark):
    planes = {f"p_{c}": np.array([[v]]) for c, v in
              zip(("scar", "redness", "hematoma", "necrosis", "background"), (0.6, 0.6, 0, 0, 0.5))}
    px = pixel_frame(spark, planes)
    assert px.select(dominant_class().alias("c")).first()["c"] == "scar"
    assert binarise_round(px).first()["p_background"] == 0


def test_spline_identity_shift_scale_and_bad_points(spark):
    pts = [(10.0, 10.0), (10.0, 50.0), (50.0, 10.0), (50.0, 50.0), (30.0, 25.0)]
    rows = []
    for image, f in ((1, lambda r, c: (r, c)), (2, lambda r, c: (r + 5, c + 10)),
                     (3, lambda r, c: (2 * r, 2 * c))):
        rows += [(image, r, c, *f(r, c)) for r, c in pts]
    rows += [(4, float(i), float(i), 0.0, 0.0) for i in range(4)] + [(5, 1.0, 2.0, 3.0, 4.0)]
    names = ["image_id", "from_row", "from_col", "to_row", "to_col"]
    points = spark.createDataFrame(pd.DataFrame(rows, columns=names))
    model = warp.fit_tps(points)
    status = {r["image_id"]: r["status"] for r in model.collect()}
    assert [status[i] for i in range(1, 6)] == ["ok"] * 3 + ["collinear points", "too few points"]
    probe = spark.createDataFrame([(i, 21.0, 37.0) for i in (1, 2, 3)],
                                  "image_id long, from_row double, from_col double")
    got = {r["image_id"]: (r["mapped_row"], r["mapped_col"]) for r in
           warp.apply_tps(probe, model).collect()}
    assert got[1] == pytest.approx((21, 37), abs=1e-6)
    assert got[2] == pytest.approx((26, 47), abs=1e-6)
    assert got[3] == pytest.approx((42, 74), abs=1e-6)
    residual = warp.tps_residual(warp.apply_tps(points, model)).collect()
    assert max(r["max_residual"] for r in residual) < 1e-6


def test_regularised_spline_no_longer_interpolates(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.random((9, 4)) * 50, columns=["from_row", "from_col", "to_row", "to_col"])
    points = spark.createDataFrame(pdf.assign(image_id=1))
    out = warp.tps_residual(warp.apply_tps(points, warp.fit_tps(points, 100.0))).first()
    assert out["max_residual"] > 1e-3


def test_quarter_turns_by_any_angle(spark):
    plane = np.arange(12.0).reshape(3, 4)
    out = resample.rotate_any(image_frame(spark, {"r": plane}), ["r"], 90.0)
    assert np.allclose(plane_of(out, "r"), np.rot90(plane, -1))
    same = resample.rotate_any(image_frame(spark, {"r": plane}), ["r"], 0.05)
    assert np.allclose(plane_of(same, "r"), plane)


def test_crop_reads_the_window(spark):
    plane = np.arange(20.0).reshape(4, 5)
    df = image_frame(spark, {"r": plane}).withColumns(
        {"crop_y": F.lit(2), "crop_x": F.lit(3), "crop_h": F.lit(2), "crop_w": F.lit(3)}
    )
    assert (plane_of(resample.crop(df, ["r"], ["image_id"]), "r") == plane[1:3, 2:5]).all()


def test_closeup_of_a_level_bar(spark):
    plane = np.zeros((9, 12))
    plane[3:6, 2:11] = 1.0
    images = image_frame(spark, {"r": plane, "m": plane})
    ring = [4.0, 3.0, 4.0, 11.0, 6.0, 11.0, 6.0, 3.0]
    markers = spark.createDataFrame(
        [(1, 5.0, 7.0, ring)],
        "image_id int, centroid_row double, centroid_col double, corners array<double>")
    out = plane_of(resample.marker_closeup(images, markers, ["r"], "m"), "r")
    assert out.shape == (8, 2)  # cut 2 x 8, then turned for display
    assert out.max() == 1.0
    none = resample.marker_closeup(images, markers.limit(0), ["r"], "m")
    assert plane_of(none, "r").shape == (100, 100)


def test_closeup_of_a_square_ignores_the_last_bits_of_its_sides(spark):
    plane = np.arange(81.0).reshape(9, 9) / 81
    on = np.ones((9, 9))
    images = image_frame(spark, {"r": plane, "m": on})
    u, v = np.array([np.sin(0.7), np.cos(0.7)]), np.array([np.cos(0.7), -np.sin(0.7)])
    cuts = []
    for side in (2.0, 2.0 - 1e-12):  # along the axis, once longer and once shorter by noise
        ring = [5.0 + a * u * side / 2 + b * v for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        markers = spark.createDataFrame(
            [(1, 5.0, 5.0, np.concatenate(ring).tolist())],
            "image_id int, centroid_row double, centroid_col double, corners array<double>")
        cuts.append(plane_of(resample.marker_closeup(images, markers, ["r"], "m"), "r"))
    assert np.allclose(cuts[0], cuts[1])


def test_equally_near_targets_go_by_number(spark):
    markers = spark.createDataFrame(
        [(1, 1, 7 / 3, 17 / 3)], "image_id int, marker int, centroid_row double, centroid_col double")
    targets = spark.createDataFrame(
        [(1, 1, 1.0, 1.0), (1, 2, 7.0, 7.0)], "image_id int, target int, target_row double, target_col double")
    assert warp.correspond(markers, targets, "nearest").collect()[0]["target"] == 1


def test_losses(spark):
    df = spark.createDataFrame(
        [(1, [2.0, 0.0], [1.0, 0.0]), (1, [0.0, 3.0], [1.0, 0.0])],
        "image_id int, logits array<double>, truth array<double>",
    )
    p = [np.exp(2) / (np.exp(2) + 1), 1 / (np.exp(3) + 1)]
    want = np.mean([-np.log(v + metrics.EPSILON) for v in p])
    assert metrics.cross_entropy(df, 2).first()[0] == pytest.approx(want)
    focal = np.mean([-np.log(v + metrics.EPSILON) * (1 - v) ** 2 for v in p])
    assert metrics.focal_cross_entropy(df, [1.0, 1.0]).first()[0] == pytest.approx(focal)
    loss = {r["class"]: r["iou_loss"] for r in metrics.iou_loss(df, ["a", "b"]).collect()}
    assert loss == {"a": 0.5, "b": 1.0}
    strict = {r["class"]: r["iou_loss"] for r in
              metrics.iou_loss(df, ["a", "b"], mode="reference").collect()}
    assert strict == {"a": 0.5, "b": 1.0}


def test_mask_lch_of_image_without_mask(spark):
    px = pixel_frame(spark, {c: np.ones((2, 2)) for c in "rgb"})
    r = colours.mask_lch(px, F.lit(False)).first()
    assert r["pixel_count"] == 0 and r["l_median"] is None
    assert apply_mask(px, F.lit(False)).agg(F.sum("r")).first()[0] == 0


def test_marker_grids(spark):
    spots = [(r, c) for r in (10.2, 29.8, 50.1) for c in (9.9, 40.2, 69.7)]
    markers = spark.createDataFrame(
        [(1, i, r, c) for i, (r, c) in enumerate(spots, start=1)],
        "image_id int, marker int, centroid_row double, centroid_col double")

    def targets(mode, **kw):
        rows = warp.canonical_positions(markers, mode, (80, 100), 10.0, **kw).orderBy("target")
        return [(r["target_row"], r["target_col"]) for r in rows.collect()]

    assert targets("grid_3x3", spacing=20.0) == [(10 + 20 * i, 10 + 20 * j) for i in range(3) for j in range(3)]
    auto = targets("auto")
    assert auto[0] == (10, 10) and auto[8] == pytest.approx((49.9, 69.8))
    assert len(targets("corners_4")) == 4 and len(targets("grid_2x2")) == 4
    with pytest.raises(ValueError):
        targets("circle")


def test_circular_mean_of_hues(spark):
    from pixloom.operators.colours import circular_mean

    rows = [("red", 350.0), ("red", 10.0), ("none", 0.0), ("none", 180.0), ("one", 200.0), ("null", None)]
    df = spark.createDataFrame(rows, "k string, h double").groupBy("k").agg(circular_mean(F.col("h")).alias("m"))
    got = {r["k"]: r["m"] for r in df.collect()}
    assert min(got["red"], 360 - got["red"]) < 1e-9 and got["one"] == pytest.approx(200)
    assert got["none"] is None and got["null"] is None


def test_nearest_halves_go_to_the_even_position_from_one():
    from pixloom.functions import raster

    plane = np.arange(1.0, 7.0).reshape(6, 1)
    out = raster.remap([plane], 4, 1, lambda r, c: (r + 0.5, c), "nearest", 0.0)
    assert out[0, :, 0].tolist() == [2.0, 2.0, 4.0, 4.0]
