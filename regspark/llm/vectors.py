"""Vectors of a table as arrays and matrices: which rows count, and batches as numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of a matrix that is handled as one piece.
BLOCK_ENTRIES = 1 << 18


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor holds null, NaN or infinite components."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def scaled(vector: Column, by: int) -> Column:
    """The components times `by`, rounded down, as long; beyond its range the nearest long."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(by)) * c.cast("double")))


def commonest_size(rows: DataFrame, vector: str) -> int:
    """The number of components that most rows have (ties: the larger); 0 without rows."""
    found = rows.groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "size")).alias("s")).first()["s"]
    return found["size"] if found else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Arrow lists of numbers as a matrix of `width` columns; shorter lists end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) == 0 or (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out
