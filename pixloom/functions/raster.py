"""Small numpy helpers for whole-image resampling inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


CELLS = 1 << 20  # target cells whose positions are held at a time
SMALL = 1 << 16  # cells of all planes that are read together; calls, not cells, are the cost of a small picture


def remap(planes: Sequence[np.ndarray], height: int, width: int, positions, method: str, fill: float) -> np.ndarray:
    """New planes (C, height, width): each cell read at ``positions(rows, cols)``, 1-based and fractional.

    Goes through strips of target rows and plane by plane (small pictures: all planes at once), so besides
    source and target only a strip is held; planes keep their type. Positions outside the source give ``fill``.
    """
    h, w = planes[0].shape
    out = np.empty((len(planes), height, width), planes[0].dtype)
    step = max(1, CELLS // max(1, width))
    for first in range(0, height, step):
        last = min(first + step, height)
        rows, cols = np.mgrid[first + 1 : last + 1, 1 : width + 1]
        rows, cols = positions(rows.astype(float), cols.astype(float))
        inside = (rows >= 1) & (rows <= h) & (cols >= 1) & (cols <= w)
        r, c = np.clip(rows, 1, h) - 1.0, np.clip(cols, 1, w) - 1.0
        if method == "nearest":
            # halves go to the even position counted from 1
            at = np.rint(r + 1.0).astype(int) - 1, np.rint(c + 1.0).astype(int) - 1
            for k, p in enumerate(planes):
                out[k, first:last] = np.where(inside, p[at], fill)
            continue
        r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
        r1, c1 = np.minimum(r0 + 1, h - 1), np.minimum(c0 + 1, w - 1)
        fr, fc = r - r0, c - c0
        if len(planes) * (h * w + rows.size) <= SMALL and len({p.dtype for p in planes}) == 1:
            p = np.array(planes)
            value = (
                p[:, r0, c0] * (1 - fr) * (1 - fc)
                + p[:, r0, c1] * (1 - fr) * fc
                + p[:, r1, c0] * fr * (1 - fc)
                + p[:, r1, c1] * fr * fc
            )
            out[:, first:last] = np.where(inside, value, fill)
            continue
        for k, p in enumerate(planes):
            value = (
                p[r0, c0] * (1 - fr) * (1 - fc)
                + p[r0, c1] * (1 - fr) * fc
                + p[r1, c0] * fr * (1 - fc)
                + p[r1, c1] * fr * fc
            )
            out[k, first:last] = np.where(inside, value, fill)
    return out


def gaussian_taps(size: int, sigma: float) -> np.ndarray:
    offsets = np.arange(size) - size // 2
    taps = np.exp(-(offsets**2) / (2.0 * sigma**2))
    return taps / taps.sum()


def smooth(planes: np.ndarray, size: int, sigma: float) -> np.ndarray:
    """Separable Gaussian, edge pixels repeated."""
    taps = gaussian_taps(size, sigma)
    half = size // 2
    padded = np.pad(planes, ((0, 0), (half, half), (half, half)), mode="edge")
    h, w = planes.shape[1:]
    vertical = sum(t * padded[:, i : i + h, :] for i, t in enumerate(taps))
    return sum(t * vertical[:, :, i : i + w] for i, t in enumerate(taps))


def shear(x: float = 0.0, y: float = 0.0) -> np.ndarray:
    """2x2 map on (x, y) by angles in degrees along x, then along y."""
    along_x = np.array([[1.0, np.tan(np.radians(x))], [0.0, 1.0]])
    return np.array([[1.0, 0.0], [np.tan(np.radians(y)), 1.0]]) @ along_x


def turn(degrees: float) -> np.ndarray:
    a = np.radians(degrees)
    return np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])


def mirror(kind: str) -> np.ndarray:
    return np.diag({"flipx": (-1.0, 1.0), "flipy": (1.0, -1.0)}.get(kind, (1.0, 1.0)))


def displacement(height, width, grid_h, grid_w, scale, sigma, iterations, seed) -> np.ndarray:
    """Smooth random field (2, H, W) in pixels from a coarse grid with a fixed border."""
    rng = np.random.default_rng(seed)
    coarse = rng.uniform(-1.0, 1.0, size=(2, grid_h, grid_w)) * scale
    coarse[:, [0, -1], :] = 0.0
    coarse[:, :, [0, -1]] = 0.0
    size = 2 * int(np.ceil(2 * sigma)) + 1
    for _ in range(iterations):
        coarse = smooth(coarse, size, sigma)
    dr, dc = (grid_h - 1) / max(height - 1, 1), (grid_w - 1) / max(width - 1, 1)
    field = remap(coarse, height, width, lambda rows, cols: (1 + (rows - 1) * dr, 1 + (cols - 1) * dc), "bilinear", 0.0)
    return field * np.array([height, width], dtype=float)[:, None, None]
