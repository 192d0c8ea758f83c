"""Sorting, limits and top-k (SRT-01..04).

Top-k is always ``orderBy(...).limit(k)`` with a unique tie-break so it
plans as ``TakeOrderedAndProject``: each task keeps its own k best rows and
only k x tasks rows reach the final merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAL = "sueldo_bruto"


def top_salaries(df: DataFrame, n: int = 20, value: str = SAL, tie: str = "id") -> DataFrame:
    """SRT-01: the ``n`` highest salaries (nulls last), ties by ``tie``."""
    return df.where(F.col(value).isNotNull()).orderBy(F.desc(value), F.asc(tie)).limit(n)


def top_groups(df: DataFrame, key: str, n: int = 20, value: str = SAL) -> DataFrame:
    """SRT-02: the ``n`` groups with the highest mean, returned in ascending order."""
    m = df.groupBy(key).agg(F.avg(value).alias("promedio"), F.count(value).alias("n"))
    top = m.orderBy(F.desc("promedio"), F.asc(key)).limit(n)
    return top.orderBy(F.asc("promedio"), F.desc(key))


def sort_by(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """SRT-03: user-chosen column and direction; nulls last either way."""
    c = F.col(column)
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last())


def preview(df: DataFrame, n: int = 100, key: str = "id") -> DataFrame:
    """SRT-04: first ``n`` rows in key order."""
    return df.orderBy(key).limit(n)
