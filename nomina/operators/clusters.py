"""K-means over one number and categories of any number of levels (STA-18).

The points are the standardised number and the standardised one-hot columns of each category,
but no such column is ever built.  With p a level's share of all rows, q its share of a
cluster's rows and s^2 = p (1 - p), a point of level l is at squared distance

    (z - mean z)^2 + sum over categories [ sum_j q_j^2 / s_j^2 + (1 - 2 q_l) / s_l^2 ]

from the cluster's centre.  So a round joins each row with its levels' k weights q / s^2 and
takes the least sum; the clusters' means are counts by (cluster, level), summed in one pass.
Only k sums a category reach the driver; levels stay in tables.  The number and the levels of
each row, nothing else, are written once for all rounds; the clusters of the whole rows follow
from the last centres."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomina.session import ensure_checkpoint_dir


#: Levels of a category that may be broadcast to the rows.
BROADCAST_LEVELS = 100_000

@dataclass
class Centres:
    """``z`` and ``const`` (the sums of q^2 / s^2) a cluster; ``weights``: for each category a
    table (_l, _w: q / s^2 by cluster), and its ``rows``."""

    z: list[float]
    const: list[float]
    weights: list[DataFrame]
    rows: list[int]


def _level(c: str) -> Column:
    """A category's value as text; null is a level of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))


def _near(table: DataFrame, rows: int) -> DataFrame:
    """A table of levels, broadcast if it is small."""
    return F.broadcast(table) if rows <= BROADCAST_LEVELS else table


def _distances(points: DataFrame, levels: list[str], centres: Centres) -> DataFrame:
    """``points`` with ``_d``, the squared distance from every centre."""
    out = points
    for i, (c, w, n) in enumerate(zip(levels, centres.weights, centres.rows, strict=True)):
        out = out.join(_near(w.select(F.col("_l").alias(c), F.col("_w").alias(f"_w{i}"), F.col("_i").alias(f"_i{i}")), n), c)
    total = []
    for j, (z, const) in enumerate(zip(centres.z, centres.const, strict=True)):
        d = (F.col("_z") - F.lit(z)) ** 2 + F.lit(const)
        for i in range(len(levels)):
            d = d + F.col(f"_i{i}") - 2 * F.col(f"_w{i}")[j]
        total.append(F.greatest(d, F.lit(0.0)))
    return out.withColumn("_d", F.array(*total)).drop(*[f"_{x}{i}" for i in range(len(levels)) for x in "wi"])


def _nearest() -> Column:
    """The number of the nearest centre."""
    return (F.array_position("_d", F.array_min("_d")) - 1).cast("int")


def _sums(points: DataFrame, levels: list[str], centres: Centres) -> DataFrame:
    """Rows (_n), sum of z and of squared distances (_least) by cluster (_k), category (_c) and
    level (_l), in one pass; without categories one level counts."""
    near = _distances(points, levels, centres).select("_z", *levels, F.array_min("_d").alias("_least"), _nearest().alias("_k"))
    items = [F.struct(F.lit(i).alias("_c"), F.col(c).alias("_l")) for i, c in enumerate(levels)] or [F.struct(F.lit(0).alias("_c"), F.lit("").alias("_l"))]
    each = near.select("_k", "_z", "_least", F.explode(F.array(*items)).alias("_x")).select("_k", "_z", "_least", "_x.*")
    return each.groupBy("_k", "_c", "_l").agg(F.count(F.lit(1)).alias("_n"), F.sum("_z").alias("_z"), F.sum("_least").alias("_least")).checkpoint()


def _centres(sums: DataFrame, scales: list[DataFrame], means: dict, k: int, old: Centres) -> Centres:
    """The means of the clusters; an empty cluster keeps its number's old place as far as z goes."""
    z = [means[j]["_z"] / means[j]["_n"] if j in means else old.z[j] for j in range(k)]
    const, weights = [0.0] * k, []
    for i, (scale, n) in enumerate(zip(scales, old.rows, strict=True)):
        counts = sums.where(F.col("_c") == i).groupBy("_l").agg(*[F.sum(F.when(F.col("_k") == j, F.col("_n"))).alias(f"_n{j}") for j in range(k)])
        shares = F.array(*[(F.col(f"_n{j}") / F.lit(float(means[j]["_n"]))) if j in means else F.lit(0.0) for j in range(k)])
        table = scale.join(_near(counts, n), "_l", "left").select("_l", "_i", F.transform(F.coalesce(shares, F.array_repeat(F.lit(0.0), k)), lambda q: F.coalesce(q, F.lit(0.0))).alias("_q"))
        table = table.select("_l", "_i", "_q", F.transform("_q", lambda q: q * F.col("_i")).alias("_w")).checkpoint()
        sq = table.agg(*[F.sum(F.col("_q")[j] * F.col("_w")[j]).alias(f"_{j}") for j in range(k)]).first()
        const = [a + (b or 0.0) for a, b in zip(const, sq, strict=True)]
        weights.append(table.drop("_q"))
    return Centres(z, const, weights, old.rows)


def sparse_kmeans(df: DataFrame, value: str, cats: tuple[str, ...], k: int = 5, seed: int = 42, rounds: int = 20, tolerance: float = 1e-4) -> tuple[DataFrame, float]:
    """(``df``'s rows with a value and their ``cluster``, the sum of squared distances).

    Starting points are drawn one after another, each with a chance in proportion to its
    squared distance from those before (by a seeded hash of the row, so reruns agree)."""
    ensure_checkpoint_dir(df.sparkSession)
    levels = [f"_c{i}" for i in range(len(cats))]
    rows = df.where(F.col(value).isNotNull())
    n, mean, sd = rows.agg(F.count(F.lit(1)), F.avg(value), F.stddev_pop(value)).first()
    z = F.coalesce(F.try_divide(F.col(value) - F.lit(mean), F.lit(sd)), F.lit(0.0))
    whole = rows.withColumns({"_z": z, **{a: _level(b) for a, b in zip(levels, cats, strict=True)}})
    points = whole.select("_z", *levels, F.xxhash64(F.lit(seed), *df.columns).alias("_row")).checkpoint()
    scales = []
    for c in levels:
        p = F.col("_n") / F.lit(float(n))
        inverse = F.when(p < 1, 1 / (p * (1 - p))).otherwise(0.0)
        scales.append(points.groupBy(F.col(c).alias("_l")).agg(F.count(F.lit(1)).alias("_n")).select("_l", inverse.alias("_i")).checkpoint())
    counts = [scale.count() for scale in scales]
    # starting points: the first by hash, each next by distance
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "_row"), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
    starts = [points.agg(F.min_by(F.struct("_z", *levels), F.struct(uniform, "_row"))).first()[0]]
    while len(starts) < k:
        known = _starting(starts, levels, scales, counts)
        nearest = F.array_min("_d")
        pick = _distances(points, levels, known).where(nearest > 1e-12).agg(F.min_by(F.struct("_z", *levels), F.struct(-F.log(uniform) / nearest, "_row"))).first()[0]
        if pick is None:  # fewer different points than clusters
            break
        starts.append(pick)
    k = len(starts)
    centres, cost = _starting(starts, levels, scales, counts), float("inf")
    for i in range(rounds):
        sums = _sums(points, levels, centres)
        means = {r["_k"]: r for r in sums.where("_c = 0").groupBy("_k").agg(*[F.sum(c).alias(c) for c in ("_n", "_z", "_least")]).collect()}  # k rows
        now = sum(r["_least"] for r in means.values())
        done, cost = cost - now <= tolerance * now, now
        if done or i + 1 == rounds:
            break
        centres = _centres(sums, scales, means, k, centres)
    return _distances(whole, levels, centres).select(*df.columns, _nearest().alias("cluster")), cost


def _starting(starts: list, levels: list[str], scales: list[DataFrame], counts: list[int]) -> Centres:
    """Centres at single points."""
    const, weights = [0.0] * len(starts), []
    for c, scale in zip(levels, scales, strict=True):
        own = [s[c] for s in starts]
        table = scale.select("_l", "_i", F.array(*[F.when(F.col("_l") == v, F.col("_i")).otherwise(0.0) for v in own]).alias("_w"))
        found = {r["_l"]: r["_i"] for r in scale.where(F.col("_l").isin(own)).collect()}  # a row a start
        const = [a + found[v] for a, v in zip(const, own, strict=True)]
        weights.append(table)
    return Centres([s["_z"] for s in starts], const, weights, counts)
