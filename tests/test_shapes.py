import numpy as np
import pytest
from pyspark.sql import functions as F

from pixloom.functions import geometry as G
from pixloom.operators import components as C
from pixloom.operators import morphology as M
from pixloom.operators import polygons as PG
from helpers import pixel_frame, white


def on(df, column="m"):
    return {(r["row"], r["col"]) for r in df.where(F.col(column)).collect()}


def mask(spark, rows):
    return pixel_frame(spark, {"m": np.array(rows, dtype=bool)})


def test_dilate_centre(spark):
    m = mask(spark, [[0, 0, 0], [0, 1, 0], [0, 0, 0]])
    assert len(on(M.dilate(m, "m", 1))) == 9
    assert on(M.dilate(m, "m", 0)) == {(2, 2)}


def test_erode_border(spark):
    assert on(M.erode(mask(spark, np.ones((3, 3))), "m", 1)) == {(2, 2)}


def test_close_thin_line_vanishes(spark):
    assert on(M.close(mask(spark, [[1, 1, 0, 1, 1]]), "m", 1)) == set()


def test_open_is_inside_mask_and_close_keeps_the_interior(spark):
    rng = np.random.default_rng(3)
    cells = rng.random((14, 11)) < 0.6
    m = mask(spark, cells)
    full = {(r + 1, c + 1) for r, c in zip(*np.nonzero(cells))}
    assert on(M.open_(m, "m", 1)) <= full
    inner = {(r, c) for r, c in full if 2 < r <= 12 and 2 < c <= 9}
    assert inner <= on(M.close(m, "m", 1))


def test_contour(spark):
    square = np.zeros((9, 9))
    square[2:7, 2:7] = 1
    assert len(on(M.contour(mask(spark, square), "m"), "contour")) == 16
    point = np.zeros((5, 5))
    point[2, 2] = 1
    assert on(M.contour(mask(spark, point), "m"), "contour") == {(3, 3)}
    assert on(M.contour(mask(spark, np.zeros((4, 4))), "m"), "contour") == set()


def test_components_of_white_boxes(spark):
    one = C.find_components(white(spark, 100, 100, [(20, 40, 30, 60)]), 0.5, 0, 100).collect()
    assert [r["size"] for r in one] == [651]
    three = white(spark, 90, 90, [(10, 20, 10, 20), (40, 50, 40, 50), (70, 80, 70, 80)])
    found = C.find_components(three, 0.5, 0, 50).collect()
    assert sorted((r["r_min"], r["c_max"]) for r in found) == [(10, 20), (40, 50), (70, 80)]


def test_minimum_area(spark):
    px = white(spark, 60, 60, [(5, 25, 5, 25), (40, 45, 40, 45)])
    labelled = C.label_components(px.where("r > 0.5").select("image_id", "row", "col"))
    assert C.component_stats(labelled, 100).count() == 1
    assert C.component_stats(labelled, 30).count() == 2


def brute_labels(cells, reach):
    """Flood fill in column-major scan order."""
    h, w = cells.shape
    out = np.zeros((h, w), dtype=int)
    n = 0
    for c in range(w):
        for r in range(h):
            if not cells[r, c] or out[r, c]:
                continue
            n += 1
            stack = [(r, c)]
            out[r, c] = n
            while stack:
                y, x = stack.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        if (dy, dx) == (0, 0) or (reach == 4 and dy and dx):
                            continue
                        a, b = y + dy, x + dx
                        if 0 <= a < h and 0 <= b < w and cells[a, b] and not out[a, b]:
                            out[a, b] = n
                            stack.append((a, b))
    return out


@pytest.mark.parametrize("reach", [4, 8])
def test_labels_match_flood_fill(spark, reach):
    rng = np.random.default_rng(reach)
    cells = rng.random((14, 17)) < (0.58 if reach == 4 else 0.42)
    snake = np.zeros((12, 13), dtype=bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    px = pixel_frame(spark, {"m": cells}, 1).select("image_id", "row", "col", "m").unionByName(
        pixel_frame(spark, {"m": snake}, 2).select("image_id", "row", "col", "m")
    )
    rows = C.label_components(px.where("m").repartition(5), reach).collect()
    for image, grid in ((1, cells), (2, snake)):
        want = brute_labels(grid, reach)
        got = np.zeros_like(want)
        for r in rows:
            if r["image_id"] == image:
                got[r["row"] - 1, r["col"] - 1] = r["label"]
        assert (got == want).all()


@pytest.mark.parametrize("reach", [4, 8])
def test_labels_across_tiles(spark, reach):
    rng = np.random.default_rng(reach + 20)
    frames, want = [], {}
    for image, (h, w, share) in enumerate(((23, 31, 0.55), (9, 40, 0.7), (4, 4, 1.0), (30, 1, 0.8))):
        cells = rng.random((h, w)) < share
        frames.append(pixel_frame(spark, {"m": cells, "v": rng.random((h, w))}, image).where("m"))
        want[image] = brute_labels(cells, reach)
    px = frames[0]
    for f in frames[1:]:
        px = px.unionByName(f)
    spiral = np.zeros((21, 21), dtype=bool)
    for k in range(0, 10, 2):
        spiral[k, k : 21 - k] = spiral[20 - k, k : 21 - k] = spiral[k : 21 - k, 20 - k] = spiral[k + 2 : 21 - k, k] = True
        spiral[k + 2, k : k + 3] = True
    px = px.unionByName(pixel_frame(spark, {"m": spiral, "v": spiral * 1.0}, 9).where("m"))
    want[9] = brute_labels(spiral, reach)
    rows = C.label_components(px.withColumn("label", F.lit("old")), reach, tile=5).collect()
    got = {i: np.zeros_like(x) for i, x in want.items()}
    for r in rows:
        got[r["image_id"]][r["row"] - 1, r["col"] - 1] = r["label"]
    assert all((got[i] == want[i]).all() for i in want) and "v" in rows[0]
    assert C.label_components(px.limit(0), reach).count() == 0


def test_stencils_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(M, "TILE", 6)
    rng = np.random.default_rng(12)
    cells, values = rng.random((19, 26)) < 0.6, rng.random((19, 26))

    def square(a, k, change, outside):
        wide = np.pad(a, k, constant_values=outside)
        views = [wide[i : i + a.shape[0], j : j + a.shape[1]] for i in range(2 * k + 1) for j in range(2 * k + 1)]
        return change(views, axis=0)

    dilated = lambda a, k: square(a, k, np.any, False)
    eroded = lambda a, k: square(a, k, np.all, False)
    cases = [
        (M.dilate, 3, dilated(cells, 3)),
        (M.erode, 1, eroded(cells, 1)),
        (M.close, 2, eroded(dilated(cells, 2), 2)),
        (M.open_, 1, dilated(eroded(cells, 1), 1)),
        (M.close_open, 1, dilated(eroded(eroded(dilated(cells, 1), 1), 1), 1)),
    ]
    px = pixel_frame(spark, {"m": cells, "v": values}, 1).unionByName(pixel_frame(spark, {"m": cells.T, "v": values.T}, 2))
    for make, radius, want in cases:
        rows = make(px.repartition(4), "m", radius).collect()
        assert len(rows) == 2 * cells.size
        assert all(r["m"] == (want if r["image_id"] == 1 else want.T)[r["row"] - 1, r["col"] - 1] for r in rows)
    ones = square(np.ones(cells.shape), 4, np.sum, 0)
    mean = square(values, 4, np.sum, 0) / ones
    rows = M.local_mean(px, "v", 9).where("image_id = 1").collect()
    assert max(abs(r["local_mean"] - mean[r["row"] - 1, r["col"] - 1]) for r in rows) < 1e-12
    wide = np.pad(cells, 1)
    edge = cells & ~(wide[:-2, 1:-1] & wide[2:, 1:-1] & wide[1:-1, :-2] & wide[1:-1, 2:])
    assert on(M.contour(px.where("image_id = 1"), "m"), "contour") == {(r + 1, c + 1) for r, c in zip(*np.nonzero(edge))}
    assert M.dilate(px.limit(0), "m", 1).count() == 0


def test_oriented_box_of_a_bar(spark):
    px = white(spark, 20, 40, [(5, 9, 10, 34)]).where("r > 0.5").select("image_id", "row", "col")
    box = C.oriented_boxes(C.label_components(px)).first()
    assert (box["width"], box["height"]) == (24, 4)
    assert box["angle"] == 0 and box["aspect_ratio"] == 6
    assert (box["centroid_row"], box["centroid_col"]) == (7, 22)


def test_white_region_states(spark):
    px = white(spark, 20, 20, [(3, 6, 3, 18)], 1).unionByName(
        white(spark, 20, 20, [], 2)
    ).unionByName(white(spark, 20, 20, [(2, 3, 2, 3)], 3))
    out = {r["image_id"]: r for r in C.white_region(px, 0.7, min_area=10, radius=0).collect()}
    assert [out[i]["status"] for i in (1, 2, 3)] == ["found", "no_component", "too_small"]
    assert out[1]["size"] == 64 and out[1]["white_pct"] == 16


def test_markers_filters_are_optional(spark):
    px = white(spark, 60, 60, [(5, 14, 5, 14), (30, 33, 5, 54)])
    assert C.detect_markers(px, 0.5, 0, 20).count() == 2
    assert C.detect_markers(px, 0.5, 0, 20, aspect_range=(3.0, 99.0)).count() == 1


SQUARE = [(10, 10), (50, 10), (50, 50), (10, 50)]
PENTAGON = [(30, 10), (50, 25), (40, 50), (20, 50), (10, 25)]


@pytest.mark.parametrize(
    "ring, point, inside",
    [
        (SQUARE, (30, 30), True), (SQUARE, (5, 5), False), (SQUARE, (10, 30), True),
        (SQUARE, (50, 30), False), (SQUARE, (30, 10), True), (SQUARE, (30, 50), False),
        (PENTAGON, (30, 30), True), (PENTAGON, (5, 5), False),
        ([(10, 10), (50, 10), (30, 40)], (30, 20), True),
        ([(10, 10), (50, 10)], (30, 10), False), ([], (1, 1), False),
    ],
)
def test_point_in_polygon(spark, ring, point, inside):
    ring = [[float(x), float(y)] for x, y in ring]
    df = spark.createDataFrame([(ring,)], "v array<array<double>>")
    x, y = (F.lit(float(p)) for p in point)
    assert df.select(G.point_in_polygon(x, y, F.col("v")).alias("i")).first()["i"] is inside


def test_polygon_bounds(spark):
    ring = [[float(x), float(y)] for x, y in SQUARE]
    df = spark.createDataFrame([(ring,), ([],)], "v array<array<double>>")
    rows = df.select(*G.polygon_bounds(F.col("v"))).collect()
    assert tuple(rows[0]) == (10, 50, 10, 50) and tuple(rows[1]) == (0, 0, 0, 0)


def test_polygon_pixels_cross_bands(spark):
    px = white(spark, 60, 60, []).select("image_id", "row", "col")
    ring = [[float(x), float(y)] for x, y in SQUARE]
    polys = spark.createDataFrame([(1, 7, ring)], "image_id int, polygon_id int, "
                                  "vertices array<array<double>>")
    assert PG.pixels_in_polygons(px, polys, band=8).count() == 1600


def test_mask_names_keep_underscores(spark):
    df = spark.createDataFrame([(7, "In_Narbe", 12), (1234, "Umgebung", 3)], "i int, c string, p int")
    name = PG.mask_filename(F.col("i"), F.col("c"), F.col("p"), "pic")
    parsed = PG.parse_mask_filename(name, "pic")
    rows = df.select("i", "c", "p", name.alias("n"), parsed.alias("x")).collect()
    assert rows[0]["n"] == "pic_007_polygon_In_Narbe_12.png"
    for r in rows:
        assert tuple(r["x"]) == (r["i"], r["c"], r["p"])
