"""Set operations (SET-01..04)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*frames: DataFrame) -> DataFrame:
    """SET-01: concatenate frames by column name (missing columns -> null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_ordered(df: DataFrame, value: str, order_cols: list[str]) -> DataFrame:
    """SET-02: first-seen distinct values.

    The first position of each value is a grouped ``min`` over a struct of
    the order columns (map-side combined); the result is ordered by it.
    """
    pos = F.struct(*[F.col(c) for c in order_cols])
    first = df.groupBy(value).agg(F.min(pos).alias("_first"))
    return first.select(value, *[F.col(f"_first.{c}").alias(f"primera_{c}") for c in order_cols]) \
        .orderBy(*[f"primera_{c}" for c in order_cols])


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET-03: distinct rows of ``a`` not in ``b`` (SQL EXCEPT)."""
    return a.subtract(b)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """SET-04: unique values of one column."""
    return df.select(col).distinct()
