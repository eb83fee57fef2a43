"""Vector columns: which take part, and Arrow list columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """True for vectors that aren't null, empty or zero and hold only finite components."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def by_width(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """A list column as (row numbers, matrix of doubles), one for each width that occurs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.concatenate([[0], np.cumsum(width)]).astype(np.int64)
    out = []
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        out.append((rows, flat[at[rows][:, None] + np.arange(w)]))
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; cosines stay exactly as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
