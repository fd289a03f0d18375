"""Tiny images as DataFrames."""

from __future__ import annotations

import numpy as np
import pandas as pd


def pixel_frame(spark, planes: dict, image_id: int = 1):
    """One row per pixel from equally sized 2-D arrays."""
    first = np.asarray(next(iter(planes.values())))
    h, w = first.shape
    rows, cols = np.mgrid[1 : h + 1, 1 : w + 1]
    data = {"image_id": image_id, "row": rows.ravel(), "col": cols.ravel(), "height": h, "width": w}
    for name, plane in planes.items():
        data[name] = np.asarray(plane).ravel()
    return spark.createDataFrame(pd.DataFrame(data))


def white(spark, height, width, boxes, image_id: int = 1):
    """Black image with white boxes (r0, r1, c0, c1), ends included."""
    plane = np.zeros((height, width))
    for r0, r1, c0, c1 in boxes:
        plane[r0 - 1 : r1, c0 - 1 : c1] = 1.0
    return pixel_frame(spark, {c: plane for c in "rgb"}, image_id)


def image_frame(spark, planes: dict, image_id: int = 1):
    first = np.asarray(next(iter(planes.values())))
    h, w = first.shape
    names = list(planes)
    row = (image_id, h, w, *[np.asarray(planes[n], dtype=float).ravel().tolist() for n in names])
    schema = "image_id int, height int, width int, " + ", ".join(f"{n} array<double>" for n in names)
    return spark.createDataFrame([row], schema)


def plane_of(df, name: str) -> np.ndarray:
    r = df.collect()[0]
    return np.asarray(r[name]).reshape(r["height"], r["width"])
