"""Vector columns as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType


def usable(vector: Column) -> Column:
    """Not null, every component finite, at least one not zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrices(column: pa.Array):
    """The rows of a list column as float64 matrices, one for each vector length: (rows, matrix)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield rows, flat[begin[rows][:, None] + np.arange(dim)]


def as_given(vector: Column, kind: DataType) -> Column:
    """A vector column in its own precision: floats stay floats, other numbers become doubles."""
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    return vector.cast("array<float>" if single else "array<double>")


def held(matrix: np.ndarray) -> np.ndarray:
    """The rows themselves, but those whose squares a double would not hold brought near 1."""
    most = np.abs(matrix).max(axis=1, initial=0.0)
    far = np.flatnonzero((most > 1e150) | (most < 1e-150))
    if len(far):
        matrix = matrix.copy()
        matrix[far] /= most[far, None]
    return matrix


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1."""
    matrix = held(matrix)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def integers(column: pa.Array):
    """The rows of a list column of whole numbers, one matrix for each vector length: (rows, matrix)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        if dim:
            yield rows, flat[begin[rows][:, None] + np.arange(dim)]
