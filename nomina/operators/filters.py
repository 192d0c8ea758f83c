"""Row filters and predicates (FLT-01..12).

All are plain ``filter`` expressions over columns, so Catalyst pushes the
comparisons on stored columns into the Parquet scan (``PushedFilters``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomina.operators.ranks import exact_quantiles
from nomina.operators.scalars import attach_row

SAL = "sueldo_bruto"


def valid_salary(df: DataFrame, value: str = SAL) -> DataFrame:
    """FLT-01: not null and > 0."""
    return df.where(F.col(value).isNotNull() & (F.col(value) > 0))


def quantile_trim(df: DataFrame, value: str = SAL, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """FLT-02: keep rows between the exact lo and hi quantiles, inclusive.

    The bounds are one single-row aggregate (computed distributively by the
    rank table), attached as a scalar subquery and used in a plain filter.
    """
    b = exact_quantiles(df, value, {"_qlo": lo, "_qhi": hi})
    return (attach_row(df, b).where(F.col(value).between(F.col("_qlo"), F.col("_qhi")))
            .drop("_qlo", "_qhi"))


def floor_filter(df: DataFrame, value: str = SAL, floor: float = 100_000) -> DataFrame:
    """FLT-03: value > floor."""
    return df.where(F.col(value) > floor)


def open_range(df: DataFrame, value: str = SAL, lo: float = 0, hi: float = 10_000_000) -> DataFrame:
    """FLT-04: lo < value < hi."""
    return df.where((F.col(value) > lo) & (F.col(value) < hi))


def closed_range(df: DataFrame, value: str = SAL, lo: float = 100_000, hi: float = 10_000_000) -> DataFrame:
    """FLT-05: lo <= value <= hi."""
    return df.where(F.col(value).between(lo, hi))


def split_floor(df: DataFrame, value: str = SAL, floor: float = 200_000):
    """FLT-06: (kept, problem) frames split at ``floor``; nulls go to neither."""
    return df.where(F.col(value) >= floor), df.where(F.col(value) < floor)


def problem_report(df: DataFrame, key: str, value: str = SAL, floor: float = 200_000) -> DataFrame:
    """FLT-06 report: problem rows by ``key`` with their share of all rows (%)."""
    p = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col(value) < floor).alias("problemas"))
    total = p.agg(F.sum("_rows").alias("_total"))
    return (attach_row(p.where(F.col("problemas") > 0), total)
            .select(key, "problemas", F.round(F.col("problemas") * 100.0 / F.col("_total"), 4).alias("pct")))


def in_lists(df: DataFrame, **allowed) -> DataFrame:
    """FLT-07: multi-select per column; an empty/None list means no filter."""
    for col, values in allowed.items():
        if values:
            df = df.where(F.col(col).isin(list(values)))
    return df


def slider_range(df: DataFrame, lo=None, hi=None, value: str = SAL) -> DataFrame:
    """FLT-08: inclusive [lo, hi]; default bounds are floor(min) / ceil(max) (A-9 fixed)."""
    cond = F.col(value).isNotNull()
    if lo is not None:
        cond = cond & (F.col(value) >= lo)
    if hi is not None:
        cond = cond & (F.col(value) <= hi)
    return df.where(cond)


ALL = ("Todas", "Todos")


def cascade(df: DataFrame, filters: list[tuple[str, object]], value: str = SAL,
            lo=None, hi=None) -> DataFrame:
    """FLT-09: equality filters in order; the sentinel 'Todas'/'Todos' disables one."""
    for col, v in filters:
        if v is not None and v not in ALL:
            df = df.where(F.col(col) == F.lit(v))
    return slider_range(df, lo, hi, value) if (lo is not None or hi is not None) else df


def option_list(df: DataFrame, col: str) -> DataFrame:
    """FLT-10: sorted distinct non-null values."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def default_top_options(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """FLT-11: the first ``n`` sorted distinct values (preselection)."""
    return option_list(df, col).limit(n)


def preselected(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """FLT-11 applied: the rows whose ``col`` is among the preselected options."""
    return df.join(default_top_options(df, col, n), col, "left_semi")


def min_group_size(agg: DataFrame, count_col: str = "n", minimum: int = 5) -> DataFrame:
    """FLT-12: HAVING count >= minimum."""
    return agg.where(F.col(count_col) >= minimum)
