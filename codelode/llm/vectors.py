"""Vectors as blocks of numbers: what the two searches share."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: Column) -> Column:
    """True for vectors that are not null and hold finite numbers only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def of_common_length(vectors: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The vectors of the most frequent length (the longer one on a tie), and that length; 0 if there are none."""
    top = vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = top.d if top else 0
    return vectors.filter(F.size(column) == d), d


def matrix(column: Iterable[bytes], kind: str, d: int) -> np.ndarray:
    """Rows of a binary column as a matrix."""
    return np.frombuffer(b"".join(column), dtype=kind).reshape(-1, d)


def first_k(group: np.ndarray, order: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Positions of the first k rows of each group; `order`: keys, the most important first."""
    at = np.lexsort((*order[::-1], group))
    sorted_ = group[at]
    start = np.r_[True, sorted_[1:] != sorted_[:-1]] if len(at) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
    return at[np.arange(len(at)) - begin < k]
