"""Distribution statistics (STA-09..19, AGG-16).

Global constants (mean, std, quartiles, min/max) are single-row aggregates;
attaching one to every row is a broadcast of exactly one row.  Group
constants (per-group quartiles) are joined on the group key and left to the
planner (AQE broadcasts when the group table is small, splits skew if not).
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomina.operators.clusters import sparse_kmeans
from nomina.operators.ranks import exact_quantiles, value_ranks
from nomina.operators.scalars import attach_row

SAL = "sueldo_bruto"
#: Rows whose mean shifts the sums of the correlations.
SHIFT_ROWS = 1000


def iqr_bounds(df: DataFrame, value: str = SAL, k: float = 1.5) -> DataFrame:
    q = exact_quantiles(df, value, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.select("q1", "q3", iqr.alias("iqr"), (F.col("q1") - k * iqr).alias("limite_inferior"),
                    (F.col("q3") + k * iqr).alias("limite_superior"))


def outliers_iqr(df: DataFrame, value: str = SAL, k: float = 1.5) -> DataFrame:
    """STA-09: rows outside [Q1 - k*IQR, Q3 + k*IQR]."""
    b = iqr_bounds(df, value, k)
    j = attach_row(df.where(F.col(value).isNotNull()), b)
    return j.where((F.col(value) < F.col("limite_inferior")) | (F.col(value) > F.col("limite_superior")))


def outlier_summary_iqr(df: DataFrame, value: str = SAL, k: float = 1.5) -> DataFrame:
    """STA-09 summary: bounds, outlier count and % of non-null rows (one row)."""
    b = iqr_bounds(df, value, k)
    j = attach_row(df.where(F.col(value).isNotNull()), b)
    out = (F.col(value) < F.col("limite_inferior")) | (F.col(value) > F.col("limite_superior"))
    agg = j.groupBy("q1", "q3", "iqr", "limite_inferior", "limite_superior").agg(
        F.count_if(out).alias("outliers"), F.count(F.lit(1)).alias("n"))
    return agg.withColumn("pct", F.try_divide(F.col("outliers") * 100.0, F.col("n")))


def zscore_stats(df: DataFrame, value: str = SAL) -> DataFrame:
    return df.agg(F.avg(value).alias("media"), F.stddev_pop(value).alias("sigma"))


def outliers_z(df: DataFrame, value: str = SAL, z: float = 3.0) -> DataFrame:
    """STA-10: rows with |x - mean| / population std > z."""
    j = attach_row(df.where(F.col(value).isNotNull()), zscore_stats(df, value))
    zc = F.try_divide(F.abs(F.col(value) - F.col("media")), F.col("sigma"))
    return j.withColumn("z", zc).where(F.col("z") > z)


def outlier_summary_z(df: DataFrame, value: str = SAL, z: float = 3.0) -> DataFrame:
    j = attach_row(df.where(F.col(value).isNotNull()), zscore_stats(df, value))
    zc = F.try_divide(F.abs(F.col(value) - F.col("media")), F.col("sigma"))
    agg = j.groupBy("media", "sigma").agg(F.count_if(zc > z).alias("outliers"),
                                          F.count(F.lit(1)).alias("n"))
    return agg.withColumn("pct", F.try_divide(F.col("outliers") * 100.0, F.col("n")))


def top_rows(df: DataFrame, value: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(value), F.asc(tie)).limit(n)


def comoments(df: DataFrame, cols: list[str]) -> list[tuple[str, str, int, float | None]]:
    """(a, b, n, r) for every pair of columns, pairwise complete, from one scan.

    Each row becomes the vector of its masks m (1 where a column is not null), shifted values
    x and squares xx; every sum that a pair needs (n, x, y, xx, yy, xy over the rows where both
    are there) is an entry of the one Gram matrix of these vectors, which Spark adds up by
    partition.  The shift, a mean over at most ``SHIFT_ROWS`` rows, keeps the sums from
    cancelling.  The matrix has (3 x columns)^2 entries."""
    x = [F.col(c).cast("double") for c in cols]
    shift = df.limit(SHIFT_ROWS).agg(*[F.coalesce(F.avg(F.when(~F.isnan(v), v)), F.lit(0.0)).alias(f"s{i}") for i, v in enumerate(x)]).first()
    moved = [F.coalesce(v - F.lit(shift[i]), F.lit(0.0)) for i, v in enumerate(x)]
    entries = [F.when(v.isNull(), 0.0).otherwise(1.0) for v in x] + moved + [m * m for m in moved]
    vectors = MLUtils.convertVectorColumnsFromML(df.select(array_to_vector(F.array(*entries)).alias("v")), "v")
    g = RowMatrix(vectors).computeGramianMatrix().toArray() if not df.isEmpty() else None
    k, out = len(cols), []
    for i, j in combinations(range(k), 2):
        n = int(g[i, j]) if g is not None else 0
        if not n:
            out.append((cols[i], cols[j], 0, None))
            continue
        sx, sy = g[k + i, j], g[i, k + j]
        vx, vy = g[2 * k + i, j] - sx * sx / n, g[i, 2 * k + j] - sy * sy / n
        r = (g[k + i, k + j] - sx * sy / n) / math.sqrt(vx * vy) if vx > 0 and vy > 0 else math.nan if math.isnan(vx + vy) else None
        out.append((cols[i], cols[j], n, None if r is None else float(max(-1.0, min(1.0, r))) if r == r else r))
    return out


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """STA-11: Pearson r for every ordered pair of numeric columns, one pass over the rows
    however many columns there are.  Pairwise complete; null where a column does not vary."""
    pairs = comoments(df, cols)
    rows = [(c, c, 1.0) for c in cols] + [(a, b, r) for a, b, _, r in pairs] + [(b, a, r) for a, b, _, r in pairs]
    return df.sparkSession.createDataFrame(rows, "var_a string, var_b string, r double")


def corr_top(df: DataFrame, cols: list[str], n: int = 10) -> DataFrame:
    """STA-12: upper-triangle pairs by |r| descending, first n."""
    m = corr_matrix(df, cols)
    order = {c: i for i, c in enumerate(cols)}
    pos = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    return (m.where(pos[F.col("var_a")] < pos[F.col("var_b")])
            .orderBy(F.desc(F.abs("r")), "var_a", "var_b").limit(n))


def moments(df: DataFrame, value: str = SAL) -> DataFrame:
    """Skewness, excess kurtosis (population moments) and the Jarque-Bera statistic."""
    agg = df.agg(F.count(value).alias("n"), F.skewness(value).alias("asimetria"),
                 F.kurtosis(value).alias("curtosis"))
    jb = F.col("n") / 6.0 * (F.col("asimetria") ** 2 + F.col("curtosis") ** 2 / 4.0)
    return agg.withColumn("jarque_bera", jb)


# Coefficients of the normal distribution function's rational form (Hart 1968,
# in the double precision form given by West 2005), highest power first.
_PHI_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_PHI_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(x) -> Column:
    """The standard normal distribution function, to 15 digits, as one expression."""
    v = F.col(x) if isinstance(x, str) else x
    a = F.abs(v)
    density = F.exp(-a * a / 2)

    def poly(cs):
        out = F.lit(cs[0])
        for c in cs[1:]:
            out = out * a + F.lit(c)
        return out

    tail = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + F.lit(k) / tail
    upper = F.when(a > 37, 0.0).when(a < 7.07106781186547, density * poly(_PHI_ABOVE) / poly(_PHI_BELOW)).otherwise(density / tail / F.lit(math.sqrt(2 * math.pi)))
    return F.when(v > 0, 1 - upper).otherwise(upper)


def kolmogorov_p(d: Column, n: Column, terms: int = 100) -> Column:
    """P(D > d) of the Kolmogorov distribution: 2 sum (-1)^(k-1) exp(-2 k^2 d^2 n)."""
    lam = d * d * n
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * lam))
    # below 0.04 the series converges too slowly and the probability is 1 to nine digits
    return F.when(lam < 0.04, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def ks_normal(df: DataFrame, value: str = SAL, standardize: bool = False) -> DataFrame:
    """STA-13: Kolmogorov-Smirnov statistic and p-value against N(0, 1).

    ``standardize=False`` reproduces the raw-salary test (always 'not normal');
    ``standardize=True`` tests the z-scores instead.  The statistic is the greatest distance
    between the two distribution functions at a distinct value, before and after its step,
    from the rank table; p is asymptotic.
    """
    r = value_ranks(df, value)
    if standardize:
        one = df.agg(F.avg(F.col(value).cast("double")).alias("_m"), F.stddev_samp(F.col(value).cast("double")).alias("_s"))
        r = attach_row(r, one).withColumn("_z", (F.col(value) - F.col("_m")) / F.col("_s"))
    else:
        r = r.withColumn("_z", F.col(value))
    phi = normal_cdf("_z")
    gap = F.greatest((F.col("below") + F.col("cnt")) / F.col("n") - phi, phi - F.col("below") / F.col("n"))
    res = r.agg(F.max(gap).alias("estadistico"), F.max("n").alias("_n"))
    res = res.withColumn("p_valor", kolmogorov_p(F.col("estadistico"), F.col("_n")))
    return res.select("estadistico", "p_valor", F.when(F.col("p_valor") < 0.05, F.lit("no normal")).otherwise(F.lit("normal")).alias("veredicto"))


def histogram(df: DataFrame, value: str = SAL, bins: int = 30, by=()) -> DataFrame:
    """STA-14/15: equal-width bins over [min, max] (last bin closed), empty bins kept.

    Bin edges come from one global min/max row; counting is a grouped
    aggregate; every key gets the bounded bin domain ``0..bins-1`` by ``explode``.
    """
    by = list(by)
    x = df.where(F.col(value).isNotNull())
    mm = x.agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    w = (F.col("_mx") - F.col("_mn")) / F.lit(float(bins))
    idx = F.when(w == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("_mn")) / w), F.lit(bins - 1))).cast("int")
    counts = attach_row(x, mm).groupBy(*by, idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    keys = x.select(*by).distinct() if by else mm.select()
    grid = keys.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edges = attach_row(grid, mm).select(
        *by, "bin", (F.col("_mn") + F.col("bin") * w).alias("desde"),
        (F.col("_mn") + (F.col("bin") + 1) * w).alias("hasta"))
    return (edges.join(counts, [*by, "bin"], "left")
            .select(*by, "bin", "desde", "hasta", F.coalesce("n", F.lit(0)).alias("n")))


def box_stats(df: DataFrame, key: str, value: str = SAL, k: float = 1.5) -> DataFrame:
    """STA-16: per group q1, median, q3, whiskers and outlier count."""
    q = exact_quantiles(df, value, {"q1": 0.25, "mediana": 0.5, "q3": 0.75}, (key,))
    iqr = F.col("q3") - F.col("q1")
    q = q.select(key, "q1", "mediana", "q3", (F.col("q1") - k * iqr).alias("_lo"),
                 (F.col("q3") + k * iqr).alias("_hi"))
    j = df.select(key, value).where(F.col(value).isNotNull()).join(q, key)
    v = F.col(value)
    inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))
    return j.groupBy(key, "q1", "mediana", "q3").agg(
        F.min(F.when(inside, v)).alias("bigote_inferior"),
        F.max(F.when(inside, v)).alias("bigote_superior"),
        F.count_if(~inside).alias("outliers"))


def normal_overlay(df: DataFrame, value: str = SAL, points: int = 100, bins: int = 50) -> DataFrame:
    """STA-17: ``points`` samples of pdf(mean, std) scaled to histogram counts."""
    st = df.agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"),
                F.min(value).alias("_mn"), F.max(value).alias("_mx"), F.count(value).alias("_n"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("i"))
    j = attach_row(grid, st)
    x = F.col("_mn") + (F.col("_mx") - F.col("_mn")) * F.col("i") / F.lit(float(points - 1))
    z = F.try_divide(x - F.col("_mu"), F.col("_sd"))          # null (no curve) when std is 0
    pdf = F.try_divide(F.exp(-0.5 * z ** 2), F.col("_sd") * math.sqrt(2 * math.pi))
    y = pdf * F.col("_n") * (F.col("_mx") - F.col("_mn")) / F.lit(float(bins))
    return j.select("i", x.alias("x"), y.alias("y"))


def kmeans_clusters(df: DataFrame, value: str = SAL, cats=("organismo", "estamento", "grado"),
                    k: int = 5, seed: int = 42, min_rows: int = 100) -> DataFrame:
    """STA-18: one-hot categoricals + salary, standardised, k-means (``clusters.sparse_kmeans``).

    Returns the input rows with a ``cluster`` column; fewer than ``min_rows``
    rows yields no clustering (an empty frame with the same schema).
    """
    data = df.where(F.col(value).isNotNull())
    if data.limit(min_rows + 1).count() <= min_rows:
        return data.withColumn("cluster", F.lit(None).cast("int")).limit(0)
    return sparse_kmeans(data, value, cats, k, seed)[0]


def cluster_stats(clustered: DataFrame, value: str = SAL) -> DataFrame:
    """AGG-16: per cluster n, mean, median, std, distinct bodies and classes."""
    agg = clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("promedio"),
        F.stddev_samp(value).alias("desv_std"),
        F.countDistinct("organismo").alias("organismos"), F.countDistinct("estamento").alias("estamentos"))
    q = exact_quantiles(clustered, value, {"mediana": 0.5}, ("cluster",))
    return agg.join(q, "cluster", "left")


def band_distribution(df: DataFrame, value: str = SAL) -> DataFrame:
    """STA-19: rows per dashboard salary band."""
    from nomina.functions.categorize import band_dashboard, band_dashboard_ordinal

    return (df.where(F.col(value).isNotNull())
            .groupBy(band_dashboard_ordinal(value).alias("orden"), band_dashboard(value).alias("banda"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy("orden"))
