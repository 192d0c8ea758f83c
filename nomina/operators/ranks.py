"""Distributed ordered statistics without a single-task window.

A global ``Window.orderBy(x)`` moves every row to one task.  Everything that
needs an order over salaries (Gini, Lorenz curve, average-rank percentile,
exact quantiles, running shares) is derived instead from a *rank table*:

    (by..., x, cnt, below, n)

one row per distinct value per group, where ``cnt`` is the number of rows
holding ``x`` and ``below`` the number of rows of the group with a smaller
value.  It is built in three distributed steps:

1. collapse rows to distinct ``(by, x)`` with a partially-aggregated
   ``groupBy`` -- a hot value or hot group collapses map-side;
2. deal these out by ranges of ``(by, x)`` (Spark's range exchange, whose split points come
   from a bounded sample of each partition), so that a large group is split whatever range
   its values span;
3. per-(group, range) totals -> exclusive prefix offsets (at most groups + ranges rows) ->
   a window *inside* each (group, range) adds the local running count.

Rank ties are handled exactly: with ``k`` rows at value ``x`` and ``below``
rows smaller, the 1-based positions are ``below+1 .. below+k``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomina.operators.selection import quantiles
from nomina.session import ensure_checkpoint_dir

_BUCKET = "_bucket"


def value_ranks(df: DataFrame, value: str, by=(), n_buckets: int | None = None) -> DataFrame:
    """Rank table ``(by..., value, cnt, below, below_sum, n, total)`` over non-null values.

    ``below_sum`` is the sum of the values of the rows ranked below ``value``.
    """
    by = list(by)
    vals = (df.select(*by, F.col(value).cast("double").alias(value))
            .where(F.col(value).isNotNull() & ~F.isnan(value))
            .groupBy(*by, value).agg(F.count(F.lit(1)).alias("cnt")))
    # The ranges are written once to the shared checkpoint dir: totals and ranks then see
    # the same ranges, the raw input is scanned only once, and a lost executor recomputes
    # from here, not from the source.
    ensure_checkpoint_dir(df.sparkSession)
    ranged = vals.repartitionByRange(n_buckets, *by, value) if n_buckets else vals.repartitionByRange(*by, value)
    bucketed = ranged.withColumn(_BUCKET, F.spark_partition_id()).checkpoint(eager=True)
    wsum = F.col(value) * F.col("cnt")
    totals = bucketed.groupBy(*by, _BUCKET).agg(
        F.sum("cnt").alias("_bcnt"), F.sum(F.col(value) * F.col("cnt")).alias("_bsum"))
    gw = Window.partitionBy(*by) if by else Window.partitionBy()
    ow = gw.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    # at most groups + ranges rows; the window runs per group
    offsets = totals.select(
        *by, _BUCKET,
        F.coalesce(F.sum("_bcnt").over(ow), F.lit(0)).alias("_off"),
        F.coalesce(F.sum("_bsum").over(ow), F.lit(0.0)).alias("_soff"),
        F.sum("_bcnt").over(gw).alias("n"),
        F.sum("_bsum").over(gw).alias("total"))
    lw = (Window.partitionBy(*by, _BUCKET).orderBy(value)
          .rowsBetween(Window.unboundedPreceding, -1))
    return (bucketed.join(offsets, [*by, _BUCKET])
            .select(*by, value, "cnt",
                    (F.col("_off") + F.coalesce(F.sum("cnt").over(lw), F.lit(0))).alias("below"),
                    (F.col("_soff") + F.coalesce(F.sum(wsum).over(lw), F.lit(0.0))).alias("below_sum"),
                    "n", "total"))


def _pos_sum(ranked: DataFrame, value: str) -> Column:
    """Sum over rows of (1-based position * value) for one distinct value."""
    c, b = F.col("cnt"), F.col("below")
    return F.col(value) * (c * b + c * (c + 1) / 2.0)


def gini(df: DataFrame, value: str, by=(), n_buckets: int | None = None,
         name: str = "gini") -> DataFrame:
    """STA-01/02: Gini = 2*sum(i*x_(i)) / (n*sum x) - (n+1)/n; 0.0 when n<=1 or sum<=0."""
    return gini_from_ranks(value_ranks(df, value, by, n_buckets), value, by, name)


def gini_from_ranks(r: DataFrame, value: str, by=(), name: str = "gini") -> DataFrame:
    """Gini per group from an existing rank table (see ``gini``)."""
    by = list(by)
    agg = r.groupBy(*by).agg(
        F.sum(_pos_sum(r, value)).alias("_s"),
        F.first("n").alias("n"), F.first("total").alias("_t"))
    g = F.when((F.col("n") <= 1) | (F.col("_t") <= 0), F.lit(0.0)).otherwise(
        2.0 * F.col("_s") / (F.col("n") * F.col("_t")) - (F.col("n") + 1) / F.col("n"))
    return agg.select(*by, g.alias(name), F.col("n").alias("n"))


def avg_rank_percentile(df: DataFrame, value: str, out: str = "percentil",
                        n_buckets: int | None = None) -> DataFrame:
    """WIN-01: pandas ``rank(pct=True)*100`` (average rank / n * 100), per row.

    Rows are joined back to their distinct value's rank on ``value``; a hot
    value is a skewed join key, which AQE's skew-join split handles (the rank
    side holds a single row per value).
    """
    rk = percentiles_from_ranks(value_ranks(df, value, (), n_buckets), value, out)
    return (df.join(rk, df[value].cast("double") == rk["_v"], "left").drop("_v"))


def percentiles_from_ranks(r: DataFrame, value: str, out: str = "percentil", by=()) -> DataFrame:
    """Average-rank percentile per distinct value of a rank table: ``(by..., _v, out)``."""
    pct = ((F.col("below") + (F.col("cnt") + 1) / 2.0) / F.col("n") * 100.0).alias(out)
    return r.select(*by, F.col(value).alias("_v"), pct)


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by=(),
                    n_buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles (pandas/``percentile`` semantics) per group.

    For position p = q*(n-1): the value at rank floor(p) plus frac * gap to
    the next rank, found by narrowing (``selection``): no table of distinct values.
    """
    return quantiles(df, value, probs, by, **({"buckets": n_buckets} if n_buckets else {}))


def quantiles_from_ranks(r: DataFrame, value: str, probs: dict[str, float], by=()) -> DataFrame:
    """Exact quantiles per group from an existing rank table (see ``exact_quantiles``)."""
    by = list(by)
    aggs, outs = [], []
    x, lo_b, hi_b = F.col(value), F.col("below"), F.col("below") + F.col("cnt")
    for name, q in probs.items():
        pos = F.lit(float(q)) * (F.col("n") - 1)
        lo = F.floor(pos)
        hi = F.least(lo + 1, F.col("n") - 1)
        aggs.append(F.max(F.when((lo_b <= lo) & (lo < hi_b), x)).alias(f"_lo_{name}"))
        aggs.append(F.max(F.when((lo_b <= hi) & (hi < hi_b), x)).alias(f"_hi_{name}"))
        aggs.append(F.first(pos - lo).alias(f"_fr_{name}"))
        v_lo, v_hi, fr = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_fr_{name}")
        outs.append((v_lo + (v_hi - v_lo) * fr).alias(name))
    return r.groupBy(*by).agg(*aggs).select(*by, *outs)


def approx_quantiles(df: DataFrame, value: str, probs: dict[str, float], by=(),
                     accuracy: int = 10_000) -> DataFrame:
    """Opt-in approximate quantiles: one partially-aggregated pass (``percentile_approx``,
    relative rank error ~1/accuracy).  For reports where exactness is not required and
    the distinct-value table would be as large as the input (e.g. salaries with cents)."""
    qs = list(probs.items())
    arr = F.percentile_approx(F.col(value).cast("double"), [q for _, q in qs], accuracy)
    out = df.groupBy(*by).agg(arr.alias("_q"))
    return out.select(*by, *[F.col("_q")[i].alias(name) for i, (name, _) in enumerate(qs)])


def cumulative_shares(df: DataFrame, value: str, by=(), n_buckets: int | None = None) -> DataFrame:
    """Per distinct value: cumulative population share and cumulative value share.

    ``pop_share`` = rows with value <= x / n ; ``value_share`` = sum of values
    <= x / total.  This is the Lorenz curve evaluated at each distinct value
    (STA-08) and the running share of WIN-02.
    """
    by = list(by)
    r = value_ranks(df, value, by, n_buckets)
    return r.select(
        *by, value, "cnt", "below", "n", "total",
        ((F.col("below") + F.col("cnt")) / F.col("n")).alias("pop_share"),
        F.when(F.col("total") > 0,
               (F.col("below_sum") + F.col(value) * F.col("cnt")) / F.col("total")).alias("value_share"))
