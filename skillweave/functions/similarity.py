"""Similarity of strings and vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _longest_common_subsequence(a: str, b: str) -> int:
    """Bit-parallel: one machine-sized integer operation per character of ``b``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio_of(a: str | None, b: str | None) -> float | None:
    """100 * 2 * LCS / (len(a) + len(b)); two empty strings are equal."""
    if a is None or b is None:
        return None
    total = len(a) + len(b)
    return 200.0 * _longest_common_subsequence(a, b) / total if total else 100.0


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio_of(x, y) for x, y in zip(a, b, strict=True)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)
