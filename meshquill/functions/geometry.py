"""Geometry columns as NumPy arrays: views of Arrow buffers, not Python objects point by point."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def _tables(column: pa.ListArray, fields: str, kind: type) -> list[np.ndarray]:
    offsets = column.offsets.to_numpy()
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])  # of a slice, its own
    offsets = offsets - offsets[0]
    table = np.stack([values.field(f).to_numpy(zero_copy_only=False) for f in fields], axis=1).astype(kind, copy=False)
    return [table[low:high] for low, high in zip(offsets[:-1], offsets[1:], strict=True)]


def clouds(column: pa.ListArray) -> list[np.ndarray]:
    """(n, 3) arrays of a column of points; NULL is an empty one, and a missing coordinate NaN."""
    return _tables(column, "xyz", np.float64)


def meshes(column: pa.ListArray) -> list[np.ndarray]:
    """(n, 3) arrays of vertex numbers of a column of triangles."""
    return _tables(column, "ijk", np.int64)


def nested(points: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A column of points, of the given Arrow type, from (n, 3) arrays."""
    flat = np.concatenate([*points, np.empty((0, 3))])
    structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=list("xyz"))
    offsets = np.cumsum([0, *(len(p) for p in points)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), structs).cast(kind)
