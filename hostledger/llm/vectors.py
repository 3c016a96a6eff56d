"""Which vectors can be compared, and vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def usable(vector: Column) -> Column:
    """True for a vector with components, none of them null or not finite, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(finite & some, F.lit(False))


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list array of ``dim`` components each, in double precision."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim) if dim else np.zeros((len(lists), 0))
