"""Embedding columns as numpy matrices, and the rows that count as vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(column: str) -> Column:
    """Whether a vector is there, has entries, and none of them is null, NaN or infinite."""
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(column).isNotNull() & (F.size(column) > 0) & good


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A batch's vectors, all of dim entries, as rows of doubles."""
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)


def by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of vector in a batch, the places of its rows and their entries as doubles; a null entry is NaN, null vectors are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    out = []
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        out.append((at, flat[(ends[at] - dim)[:, None] + np.arange(dim)]))
    return out
