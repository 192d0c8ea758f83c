"""Exact order statistics by narrowing intervals (no sort, no table of distinct values).

Every wanted rank of every group has an interval that is known to hold its value, at first
the group's smallest and largest value.  A round scans the rows, counts those of each open
interval in ``buckets`` equal parts (partially aggregated) and keeps the part that holds the
rank, with that part's own smallest and largest value as the new interval.  Rows outside all
intervals drop out of the scan's aggregate, and a group is done when its intervals are
single values.  A part never holds both ends of its interval, so the rounds end; once every open
interval holds at most ``SLICE`` rows, these are ranked as they are.

State between rounds: a row per group and rank, checkpointed; the driver sees three counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomina.session import ensure_checkpoint_dir

BUCKETS = 512
#: Rows of an interval that are ranked without further narrowing.
SLICE = 4096
#: Intervals (a group's key and two numbers each) that may be broadcast to the scan.
BROADCAST_INTERVALS = 200_000


def _same(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def _part(buckets: int) -> Column:
    """The part of [lo, hi] that ``v`` is in; the ends are in the first and the last."""
    share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    inner = F.when(F.isnan(share) | share.isNull(), F.lit(buckets // 2)).otherwise(F.floor(share * buckets).cast("int"))
    return (F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), buckets - 1)
            .otherwise(F.least(F.greatest(inner, F.lit(0)), F.lit(buckets - 1))))


def select_ranks(rows: DataFrame, keys: list[str], ranks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``ranks`` (keys, r, lo, hi: an interval known to hold the r-th smallest, from 0) with
    ``value``.  ``rows``: keys and ``v`` (double, no nulls)."""
    ensure_checkpoint_dir(rows.sparkSession)
    state = ranks.withColumns({"below": F.lit(0).cast("long"), "size": F.lit(1 << 62)})
    cols = [*keys, "r", "lo", "hi", "below", "size"]
    while True:
        n_open, n, most = state.agg(F.count_if(F.col("lo") < F.col("hi")), F.count(F.lit(1)), F.max(F.when(F.col("lo") < F.col("hi"), F.col("size")))).first()
        if not n_open:
            break
        live = state.where("lo < hi")
        spans = live.select(*keys, "lo", "hi").distinct()
        spans = F.broadcast(spans) if n <= BROADCAST_INTERVALS else spans
        held = rows.alias("x").join(spans.alias("s"), _same("x", "s", keys) & F.col("v").between(F.col("lo"), F.col("hi")))
        own = [F.col(f"x.{k}").alias(k) for k in keys]
        if most <= SLICE:
            place = F.row_number().over(Window.partitionBy(*keys, "lo").orderBy("v")) - 1
            parts = held.select(*own, "lo", "v").select(*keys, "lo", F.col("v").alias("low"), F.col("v").alias("high"), place.cast("long").alias("start"), F.lit(1).cast("long").alias("c"))
        else:
            parts = held.groupBy(*own, "lo", _part(buckets).alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
            before = Window.partitionBy(*keys, "lo").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
            parts = parts.withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0)))
        rank = F.col("s.r") - F.col("s.below")
        found = live.alias("s").join(parts.alias("p"), _same("s", "p", keys) & (F.col("s.lo") == F.col("p.lo")) & (F.col("start") <= rank) & (rank < F.col("start") + F.col("c")))
        found = found.select(*[F.col(f"s.{k}").alias(k) for k in keys], "s.r", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("s.below") + F.col("start")).alias("below"), F.col("c").alias("size"))
        state = state.where("lo >= hi").select(*cols).unionByName(found.select(*cols)).checkpoint()
        if most <= SLICE:
            break
    return state.select(*keys, "r", F.col("lo").alias("value"))


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by=(), buckets: int = BUCKETS) -> DataFrame:
    """Exact linear-interpolated quantiles per group: (by..., one column per entry of ``probs``).

    Position q * (n - 1) between the values at the ranks around it; nulls and NaN do not
    count; a group without values, or no group at all, gives no row (without ``by`` one row of
    nulls)."""
    by = list(by)
    keys = [f"_k{i}" for i in range(len(by))] or ["_k0"]
    own = [F.col(c).alias(k) for c, k in zip(by, keys, strict=False)] or [F.lit(1).alias("_k0")]
    rows = df.select(*own, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ensure_checkpoint_dir(df.sparkSession)
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).checkpoint()
    at = {name: F.lit(float(q)) * (F.col("n") - 1) for name, q in probs.items()}
    low = {name: F.floor(p).cast("long") for name, p in at.items()}
    high = {name: F.least(r + 1, F.col("n") - 1) for name, r in low.items()}
    ranks = groups.select(*keys, "lo", "hi", F.explode(F.array_distinct(F.array(*low.values(), *high.values()))).alias("r"))
    found = select_ranks(rows, keys, ranks, buckets)
    table = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("r", "value"))).alias("_at"))  # two ranks a quantile
    out = groups.alias("g").join(table.alias("t"), _same("g", "t", keys)).select(
        *[F.col(f"g.{k}").alias(k) for k in keys], "n", "_at")
    cols = []
    for name in probs:
        a, b = F.element_at("_at", low[name]), F.element_at("_at", high[name])
        cols.append((a + (b - a) * (at[name] - low[name])).alias(name))
    out = out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=False)], *cols)
    return out if by else out.agg(*[F.first(name).alias(name) for name in probs])
