"""Geometry as column expressions; coordinates are 1-based (row, col)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def rotate90(row: Column, col: Column, height: Column, width: Column, direction: str):
    """Quarter turn of a pixel position; returns (row, col) in the turned image."""
    if direction == "cw":
        return col, height - row + 1
    if direction == "ccw":
        return width - col + 1, row
    raise ValueError("direction is 'cw' or 'ccw'")


def axis_to_pixel(x: Column, y: Column, height: Column):
    """Position on a display turned clockwise to (row, col) of the image."""
    return height - F.rint(y) + 1, F.rint(x)


def scale_vertices(vertices: Column, fx, fy) -> Column:
    """Image coordinates to another resolution."""
    return F.transform(vertices, lambda v: F.array(v[0] * _c(fx), v[1] * _c(fy)))


def display_vertices_to_image(vertices: Column, fx, fy, width) -> Column:
    """Display vertices (axes swapped, x mirrored) to image coordinates at full resolution."""
    return F.transform(vertices, lambda v: F.array(_c(width) - v[1] * _c(fx), v[0] * _c(fy)))


def point_in_polygon(x: Column, y: Column, vertices: Column) -> Column:
    """Even-odd ray test, half-open edges; fewer than three vertices is false."""
    n = F.size(vertices)
    edges = F.transform(
        vertices,
        lambda v, i: F.struct(
            v[0].alias("x1"),
            v[1].alias("y1"),
            F.element_at(vertices, F.when(i == 0, n).otherwise(i))[0].alias("x2"),
            F.element_at(vertices, F.when(i == 0, n).otherwise(i))[1].alias("y2"),
        ),
    )

    def crosses(inside: Column, e: Column) -> Column:
        straddles = (e["y1"] > y) != (e["y2"] > y)
        # A level edge has no cut; it never straddles either.
        cut = F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
        return F.when(straddles & (x < cut), ~inside).otherwise(inside)

    return F.when(n < 3, F.lit(False)).otherwise(F.aggregate(edges, F.lit(False), crosses))


def polygon_bounds(vertices: Column) -> list[Column]:
    """x_min, x_max, y_min, y_max; an empty polygon gives zeros."""
    xs = F.transform(vertices, lambda v: v[0])
    ys = F.transform(vertices, lambda v: v[1])
    return [
        F.coalesce(f(a), F.lit(0.0))
        for a in (xs, ys)
        for f in (F.array_min, F.array_max)
    ]


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Closed five-point ring."""
    lx, hx, ly, hy = F.least(x1, x2), F.greatest(x1, x2), F.least(y1, y2), F.greatest(y1, y2)
    ring = [(lx, ly), (hx, ly), (hx, hy), (lx, hy), (lx, ly)]
    return F.array(*[F.array(x, y) for x, y in ring])


def _centre(x1, y1, x2, y2):
    return (x1 + x2) / 2.0, (y1 + y2) / 2.0


def rotated_rectangle(x1: Column, y1: Column, x2: Column, y2: Column, degrees: Column) -> Column:
    """The ring of ``rectangle`` turned about its centre."""
    cx, cy = _centre(x1, y1, x2, y2)
    cos, sin = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.transform(
        rectangle(x1, y1, x2, y2),
        lambda p: F.array(
            (p[0] - cx) * cos - (p[1] - cy) * sin + cx,
            (p[0] - cx) * sin + (p[1] - cy) * cos + cy,
        ),
    )


def rotated_bounds(x1: Column, y1: Column, x2: Column, y2: Column, degrees: Column) -> list[Column]:
    return polygon_bounds(rotated_rectangle(x1, y1, x2, y2, degrees))


def in_rotated_rectangle(x, y, x1, y1, x2, y2, degrees: Column) -> Column:
    """Turn the point back and test the upright box, edges included."""
    cx, cy = _centre(x1, y1, x2, y2)
    cos, sin = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    rx = (x - cx) * cos + (y - cy) * sin
    ry = (y - cy) * cos - (x - cx) * sin
    half_w, half_h = F.abs(x2 - x1) / 2.0, F.abs(y2 - y1) / 2.0
    return rx.between(-half_w, half_w) & ry.between(-half_h, half_h)


def major_axis_angle(var_row: Column, cov: Column, var_col: Column) -> Column:
    """Direction of the larger eigenvector of a symmetric 2x2 matrix, from the column
    axis, in (-pi/2, pi/2]; the column component of the axis is never negative."""
    return 0.5 * F.atan2(2.0 * cov, var_col - var_row)


def eigenvalues2x2(var_row: Column, cov: Column, var_col: Column) -> list[Column]:
    """Ascending."""
    mean = (var_row + var_col) / 2.0
    root = F.sqrt(F.pow((var_row - var_col) / 2.0, 2) + cov * cov)
    return [mean - root, mean + root]


def tps_kernel(r: Column) -> Column:
    return F.when(r < 1e-10, F.lit(0.0)).otherwise(r * r * F.ln(r))
