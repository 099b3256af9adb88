"""Vectors of record batches as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, matrix)`` for each length; vectors that are null or hold null or non-finite components are left out."""
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends[1:]] == bad[ends[:-1]])
    lengths = np.diff(ends)
    for length in np.unique(lengths[good]).tolist():
        rows = np.flatnonzero(good & (lengths == length))
        yield rows, values[ends[rows][:, None] + np.arange(length)]


def packed(matrix: np.ndarray) -> pa.Array:
    """Each row of a matrix as binary."""
    width = matrix.dtype.itemsize * matrix.shape[1]
    data = pa.py_buffer(np.ascontiguousarray(matrix).tobytes())
    offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int64) * width, pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, offsets.buffers()[1], data])


def unpacked(column: pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    """The matrix of ``width`` columns that ``packed`` made."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)
