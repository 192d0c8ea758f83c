"""Equity and inequality metrics (STA-01..08, AGG-15).

Gini and the Lorenz curve come from the distributed rank table
(``ranks.value_ranks``); every other metric is a single grouped aggregate
or an aggregate of an aggregate (group means are tiny).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomina.operators.ranks import cumulative_shares, exact_quantiles, gini, value_ranks

SAL = "sueldo_bruto"

__all__ = ["gini", "gini_by_group", "equity_ratio", "equity_within", "max_min_ratio",
           "percentile_ratio", "cv", "lorenz", "inequality_table"]


def gini_by_group(df: DataFrame, key: str, value: str = SAL) -> DataFrame:
    """STA-02: Gini per group, highest first."""
    return gini(df, value, (key,)).orderBy(F.desc("gini"), F.asc(key))


def equity_ratio(df: DataFrame, key: str = "estamento", value: str = SAL) -> DataFrame:
    """STA-03: max group mean / min group mean and their difference.

    With a single group the ratio is 1.0 and the difference 0.0.
    """
    means = df.groupBy(key).agg(F.avg(value).alias("_m")).where(F.col("_m").isNotNull())
    agg = means.agg(F.max("_m").alias("_hi"), F.min("_m").alias("_lo"),
                    F.count(F.lit(1)).alias("grupos"))
    many = F.col("grupos") > 1
    return agg.select(
        F.when(many, F.try_divide(F.col("_hi"), F.col("_lo"))).otherwise(F.lit(1.0)).alias("ratio_max_min"),
        F.when(many, F.col("_hi") - F.col("_lo")).otherwise(F.lit(0.0)).alias("diferencia_max_min"),
        "grupos")


def equity_within(df: DataFrame, outer: str, inner: str, value: str = SAL) -> DataFrame:
    """STA-04: within each ``outer`` group, max/min of the ``inner`` group means."""
    means = df.groupBy(outer, inner).agg(F.avg(value).alias("_m")).where(F.col("_m").isNotNull())
    agg = means.groupBy(outer).agg(F.max("_m").alias("_hi"), F.min("_m").alias("_lo"),
                                   F.count(F.lit(1)).alias("grupos"))
    many = F.col("grupos") > 1
    return agg.select(
        outer,
        F.when(many, F.try_divide(F.col("_hi"), F.col("_lo"))).otherwise(F.lit(1.0)).alias("ratio_max_min"),
        F.when(many, F.col("_hi") - F.col("_lo")).otherwise(F.lit(0.0)).alias("diferencia_max_min"),
        "grupos")


def max_min_ratio(df: DataFrame, value: str = SAL) -> DataFrame:
    """STA-05: raw max / min (0 when min <= 0) and max - min."""
    agg = df.agg(F.max(value).alias("maximo"), F.min(value).alias("minimo"))
    return agg.select("maximo", "minimo",
                      F.when(F.col("minimo") > 0, F.col("maximo") / F.col("minimo"))
                      .otherwise(F.lit(0.0)).alias("ratio"),
                      (F.col("maximo") - F.col("minimo")).alias("diferencia"))


def percentile_ratio(df: DataFrame, value: str = SAL, by=()) -> DataFrame:
    """STA-06: P90/P10 and P75/P25 (null when the denominator is 0)."""
    q = exact_quantiles(df, value, {"p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9}, by)
    return q.select(*by, "p10", "p25", "p75", "p90",
                    F.try_divide(F.col("p90"), F.col("p10")).alias("p90_p10"),
                    F.try_divide(F.col("p75"), F.col("p25")).alias("p75_p25"))


def cv(df: DataFrame, value: str = SAL, by=()) -> DataFrame:
    """STA-07: sample std / mean."""
    return df.groupBy(*by).agg(
        F.try_divide(F.stddev_samp(value), F.avg(value)).alias("cv"))


def lorenz(df: DataFrame, value: str = SAL) -> DataFrame:
    """STA-08: Lorenz curve at every distinct value: (pop_share, value_share)."""
    return cumulative_shares(df, value).select(value, "cnt", "pop_share", "value_share")


def lorenz_points(df: DataFrame, value: str = SAL, k: int = 100, by=()) -> DataFrame:
    """STA-08 downsampled: the Lorenz curve at population shares j/k, j = 1..k.

    Point j sits at rank t_j = ceil(j*n/k).  Each distinct-value row of the
    rank table emits exactly the j whose rank falls in its span
    [below+1, below+cnt], so the output has k rows per group and no row is
    sorted or gathered: cum. value at rank t = below_sum + x * (t - below).
    """
    by = list(by)
    r = value_ranks(df, value, by)
    kk = F.lit(k).cast("long")
    j_lo = F.floor(F.col("below") * kk / F.col("n")).cast("long") + 1
    j_hi = F.floor((F.col("below") + F.col("cnt")) * kk / F.col("n")).cast("long")
    pts = r.where(j_hi >= j_lo).select(*by, value, "below", "below_sum", "n", "total",
                                       F.explode(F.sequence(j_lo, j_hi)).alias("j"))
    t = F.ceil(F.col("j") * F.col("n") / kk)
    return pts.select(*by, F.col("j").cast("int").alias("punto"), (t / F.col("n")).alias("pop_share"),
                      F.when(F.col("total") > 0, (F.col("below_sum") + F.col(value) * (t - F.col("below")))
                             / F.col("total")).alias("value_share"))


def inequality_table(df: DataFrame, key: str = "categoria_organismo", value: str = SAL) -> DataFrame:
    """AGG-15: per group n, mean, std, min, max, Gini (3 dp), CV (2 dp), by Gini."""
    v = F.col(value)
    agg = df.groupBy(key).agg(F.count(v).alias("n"), F.avg(v).alias("promedio"),
                              F.stddev_samp(v).alias("desv_std"), F.min(v).alias("minimo"),
                              F.max(v).alias("maximo"))
    g = gini(df, value, (key,)).select(key, "gini")
    return (agg.join(g, key, "left")
            .select(key, "n", F.round("promedio", 2).alias("promedio"),
                    F.round("desv_std", 2).alias("desv_std"), "minimo", "maximo",
                    F.round("gini", 3).alias("gini"),
                    F.round(F.try_divide(F.col("desv_std"), F.col("promedio")), 2).alias("cv"))
            .orderBy(F.desc("gini"), F.asc(key)))

