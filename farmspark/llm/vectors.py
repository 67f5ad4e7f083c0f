"""Columns of vectors: which rows count, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether a vector is there and has no null or non-finite entry."""
    # a null entry alone would make the test unknown
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def matrix(lists, dim: int) -> np.ndarray:
    """Rows of an Arrow array of long lists; shorter ones are filled with zeros."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(size) * dim == len(flat) and (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim) < size[:, None]] = flat
    return out
