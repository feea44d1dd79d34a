"""Text similarity: Jaro-Winkler as a vectorised function, label normalising, set overlap."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PREFIX_MOST, PREFIX_GAIN = 4, 0.1


def jaro(a: str, b: str) -> float:
    """Jaro similarity; half the number of characters out of order counts as transpositions, without rounding."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    where: dict[str, list[int]] = {}
    for k, c in enumerate(b):
        where.setdefault(c, []).append(k)
    left, taken = [], []
    for k, c in enumerate(a):
        spots = where.get(c)
        if spots:
            for n, spot in enumerate(spots):
                if spot > k + reach:
                    break
                if spot >= k - reach:
                    left.append(c)
                    taken.append(spot)
                    del spots[n]
                    break
    m = len(left)
    if not m:
        return 0.0
    moved = sum(c != b[k] for c, k in zip(left, sorted(taken), strict=True)) / 2.0
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3.0


def jaro_winkler(a: str, b: str) -> float:
    """Jaro with a bonus for a common prefix, at any score; equal strings 1, an empty one 0."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    score, prefix = jaro(a, b), 0
    for x, y in zip(a[:PREFIX_MOST], b[:PREFIX_MOST], strict=False):
        if x != y:
            break
        prefix += 1
    return score + prefix * PREFIX_GAIN * (1 - score)


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def register(spark: SparkSession) -> None:
    """Make jaro_winkler(a, b) known to SQL."""
    spark.udf.register("jaro_winkler", jaro_winkler_udf)


def normal_label(c: Column) -> Column:
    """Separators to spaces, camel case split, lower case, single spaces."""
    c = F.regexp_replace(c, "[_-]", " ")
    c = F.regexp_replace(c, r"(?<=[^\p{Lu}\s])(?=\p{Lu})", " ")
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets (arrays); two empty sets have 0."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))
