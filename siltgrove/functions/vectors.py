"""Vectors as rows: usable ones brought to unit length, once, in a compact form that numeric operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT_SCHEMA = "node_id long, v binary"


def list_matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that have exactly width non-null values, as a matrix, and their positions."""
    offsets = column.offsets.to_numpy()
    lengths = np.diff(offsets)
    valid = column.is_valid().to_numpy(zero_copy_only=False) & (lengths == width)
    at = np.flatnonzero(valid)
    values = column.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # nulls become NaN
    rows = flat[offsets[:-1][at][:, None] + np.arange(width)] if len(at) else np.zeros((0, width))
    return rows, at


def unit_vectors(rows: DataFrame, key: str, vector: str, width: int = 64) -> DataFrame:
    """node_id and v of every row whose vector is usable: exactly width finite numbers, not all 0. v holds width
    little-endian 32-bit floats of unit length. Null keys and unusable vectors give no row; repeated rows stay."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            x, at = list_matrix(b.column(1), width)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            x, at = x[good], at[good]
            x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
            x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype("<f4")
            flat = pa.py_buffer(np.ascontiguousarray(x).tobytes())
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * (4 * width))
            v = pa.Array.from_buffers(pa.binary(), len(x), [None, offsets.buffers()[1], flat])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), v], names=["node_id", "v"])

    return rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("node_id"), F.col(vector).alias("e")).mapInArrow(run, UNIT_SCHEMA)


def matrix(column: pa.Array, width: int = 64) -> np.ndarray:
    """The float32 matrix of a column of unit vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return np.zeros((0, width), np.float32)
    offsets = column.offsets if hasattr(column, "offsets") else None
    start = offsets[0].as_py() if offsets is not None else np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + len(column) * 4 * width].view("<f4").reshape(len(column), width)


def binary(x: np.ndarray) -> pa.Array:
    """A matrix as a column of its rows' bytes."""
    x = np.ascontiguousarray(x)
    size = x.shape[1] * x.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])


def hash_sample(rows: DataFrame, size: int, total: int, key: str = "node_id") -> DataFrame:
    """About size of the total rows, chosen by a hash of the key: the same rows on every run."""
    if total <= size:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) < int(size / total * (1 << 30)))
