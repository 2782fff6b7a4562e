"""Convex hull volume and area of captures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.geometry import clouds


def convex_hull(points: np.ndarray) -> tuple[float, float] | None:
    """(volume, area) of the hull by adding the farthest point outside, until none is; None if flat."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 4 or not np.isfinite(p).all():
        return None
    scale = float(np.ptp(p, axis=0).max())
    eps = 1e-10 * max(scale, 1e-300)
    a = int(np.argmin(p[:, 0]))
    b = int(np.argmax(np.linalg.norm(p - p[a], axis=1)))
    c = int(np.argmax(np.linalg.norm(np.cross(p - p[a], p[b] - p[a]), axis=1)))
    n = np.cross(p[b] - p[a], p[c] - p[a])
    if np.linalg.norm(n) <= eps * scale:
        return None
    height = (p - p[a]) @ (n / np.linalg.norm(n))
    d = int(np.argmax(np.abs(height)))
    if abs(height[d]) <= eps:
        return None
    middle = p[[a, b, c, d]].mean(axis=0)

    def planes(tri: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Faces that turn outwards, with their unit normals and offsets."""
        n = np.cross(p[tri[:, 1]] - p[tri[:, 0]], p[tri[:, 2]] - p[tri[:, 0]])
        n /= np.maximum(np.linalg.norm(n, axis=1), 1e-300)[:, None]
        inward = ((p[tri[:, 0]] - middle) * n).sum(1) < 0
        tri, n = np.where(inward[:, None], tri[:, [0, 2, 1]], tri), np.where(inward[:, None], -n, n)
        return tri, n, (n * p[tri[:, 0]]).sum(1)

    tri, n, offset = planes(np.array([(a, b, c), (a, b, d), (a, c, d), (b, c, d)]))
    rest = np.setdiff1d(np.arange(len(p)), [a, b, c, d])
    gap = p[rest] @ n.T - offset  # how far each point lies outside each face
    while True:
        outside = (gap > eps).any(axis=1)  # a point inside the hull stays inside
        rest, gap = rest[outside], gap[outside]
        if not len(rest):
            break
        at = int(np.argmax(gap.max(axis=1)))
        seen = gap[at] > eps
        edges = tri[seen][:, [0, 1, 1, 2, 2, 0]].reshape(-1, 2)
        horizon = edges[~np.isin(edges @ [len(p), 1], edges @ [1, len(p)])]  # seen from one side only
        new, normals, offsets = planes(np.c_[horizon, np.full(len(horizon), rest[at])])
        rest, gap = np.delete(rest, at), np.delete(gap, at, axis=0)
        tri = np.r_[tri[~seen], new]
        gap = np.c_[gap[:, ~seen], p[rest] @ normals.T - offsets]
    q = p[tri] - middle
    area = 0.5 * float(np.linalg.norm(np.cross(q[:, 1] - q[:, 0], q[:, 2] - q[:, 0]), axis=1).sum())
    return float(np.abs(np.linalg.det(q)).sum()) / 6.0, area


def convex_hulls(captures: DataFrame) -> DataFrame:
    """capture_key, hull_volume, hull_area; both NULL, with a reason, for flat or broken point sets."""
    key = captures.schema["capture_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [convex_hull(p) for p in clouds(batch.column("points"))]
            values = [pa.array([f and f[i] for f in found], pa.float64()) for i in (0, 1)]
            reasons = pa.array([None if f else "points are flat, too few or not finite" for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("capture_key"), *values, reasons], ["capture_key", "hull_volume", "hull_area", "reason"])

    return captures.select("capture_key", "points").mapInArrow(run, f"capture_key {key}, hull_volume double, hull_area double, reason string")
