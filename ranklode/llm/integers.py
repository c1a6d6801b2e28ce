"""Vectors as integers: floor(scale * x) of each component, the factor exact in a double.

A row with a null vector, or with a null or non-finite component, has none. Shorter vectors are
continued by zeros up to ``dims`` components, which an empty vector has only. Components beyond
``limit(dims)`` (23,000 times the usual length of 1 at 64 components) count as that limit, so
that every product of two vectors is exact in a double.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from ranklode.llm import kernels as K

SCALE = 256


def limit(dims: int) -> int:
    return math.isqrt((1 << 51) // max(dims, 1))


def matrix(column: pa.Array, dims: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector, and the integers of those, a row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    bounds = np.r_[0, np.cumsum(np.maximum(size, 0))].astype(np.int64)
    x = column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    keep = (size >= 0) & (K.sums(~np.isfinite(x), bounds) == 0)
    most = limit(dims)
    with np.errstate(all="ignore"):
        q = np.nan_to_num(np.clip(np.floor(x * scale), -most, most)).astype(np.int32)
    size = size[keep].astype(np.int64)
    out = np.zeros((len(size), dims), np.int32)
    at = K.ranges(bounds[:-1][keep], size)
    out.reshape(-1)[K.ranges(np.arange(len(size), dtype=np.int64) * dims, size)] = q[at]
    return keep, out
