"""What the two vector operators share: which vectors take part, and their exchange as bytes.

A vector takes part if it is not null, has a component, none null, NaN or infinite, and one that is not
zero, and has the table's dimension: the most frequent length among such vectors (the smaller on ties).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def dimension(vectors: DataFrame) -> int:
    """The most frequent length of v among rows that are ok; 0 if there is none."""
    top = vectors.filter("ok").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return int(top["n"]) if top else 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """(n, dim) float64 of a column of lists of dim doubles without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64, copy=False)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by their largest component, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
