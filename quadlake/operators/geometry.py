"""Line and ring simplification in 32-bit floats: a radial pass, then Douglas-Peucker without recursion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _radial(points: np.ndarray, limit: np.float32) -> np.ndarray:
    kept = [0]
    for i in range(1, len(points)):
        d = points[i] - points[kept[-1]]
        if d[0] * d[0] + d[1] * d[1] > limit:
            kept.append(i)
    if (points[kept[-1]] != points[-1]).any():
        kept.append(len(points) - 1)
    return points[kept]


def _distances(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances to a segment."""
    along = b - a
    size = along[0] * along[0] + along[1] * along[1]
    t = ((points[:, 0] - a[0]) * along[0] + (points[:, 1] - a[1]) * along[1]) / size if size else np.zeros(len(points), np.float32)
    near = np.where((t > 1)[:, None], b, np.where((t > 0)[:, None], a + along * t[:, None], a))
    d = points - near
    return d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]


def simplify_line(points: np.ndarray, tolerance: float) -> np.ndarray:
    if tolerance <= 0 or len(points) <= 2:
        return points
    limit = np.float32(tolerance) * np.float32(tolerance)
    points = _radial(points.astype(np.float32), limit)
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = _distances(points[a + 1 : b], points[a], points[b])
        i = int(d.argmax())
        if d[i] > limit:
            keep.add(a + 1 + i)
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return points[sorted(keep)]


def simplify_ring(points: np.ndarray, tolerance: float) -> np.ndarray:
    """A ring of at most 4 points, or one that would have less than 3, stays as it is."""
    if tolerance <= 0 or len(points) <= 4:
        return points
    closed = bool((points[0] == points[-1]).all())
    out = simplify_line(points[:-1] if closed else points, tolerance)
    if len(out) < 3:
        return points
    return np.concatenate([out, out[:1]]) if closed else out


_PARTS = "array<array<struct<x: float, y: float>>>"


def _each(value, change, tolerance: float) -> list:
    lines = [np.array([(p["x"], p["y"]) for p in line], np.float32).reshape(-1, 2) for line in value]
    return [[{"x": float(x), "y": float(y)} for x, y in (change(line, tolerance) if len(line) else line)] for line in lines]


def simplified(parts: Column, rings: bool, tolerance: float) -> Column:
    """array<array<struct<x: float, y: float>>> with each line (or ring) simplified."""
    own = simplify_ring if rings else simplify_line

    @F.pandas_udf(_PARTS)
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([_each(value, own, tolerance) for value in column])

    return run(parts)


def simplified_by_kind(parts: Column, kind: Column, tolerance: float) -> Column:
    """The same for lines and polygons by their class; other geometry stays."""
    of = {"LineString": simplify_line, "Polygon": simplify_ring}

    @F.pandas_udf(_PARTS)
    def run(column: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([_each(value, of.get(k, lambda points, _: points), tolerance) for value, k in zip(column, kinds, strict=True)])

    return run(parts, kind)
