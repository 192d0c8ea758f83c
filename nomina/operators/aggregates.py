"""Aggregations (AGG-01..20).

Conventions:
  * every metric of one report is computed in a single ``agg`` (one pass);
  * medians / quartiles are *exact* and come from the distributed rank table
    (``ranks.exact_quantiles``), joined to the other metrics on the group key;
  * money sums use ``DECIMAL(18,2)``-free double arithmetic and are rounded
    at the edge (``bround`` = pandas' half-to-even ``round``);
  * every top-N has a unique tie-break so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomina.operators.ranks import exact_quantiles, quantiles_from_ranks
from nomina.operators.scalars import attach_row

SAL = "sueldo_bruto"


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Attach a single-row aggregate ``b`` to ``a`` (scalar subquery, no join)."""
    return attach_row(a, b)


def with_quantiles(agg: DataFrame, df: DataFrame, value: str, probs: dict, by=(),
                   ranks: DataFrame | None = None) -> DataFrame:
    """Join exact quantiles of ``value`` per group onto an aggregate keyed by ``by``.

    ``ranks`` lets a caller that already built the rank table for ``by`` reuse it.
    """
    q = quantiles_from_ranks(ranks, value, probs, by) if ranks is not None else exact_quantiles(df, value, probs, by)
    if not by:
        return _one_row_join(agg, q)
    return agg.join(q, list(by), "left")


def summary_stats(df: DataFrame, value: str = SAL,
                  distinct=("organismo", "estamento", "grado", "fuente")) -> DataFrame:
    """AGG-01: rows, distinct counts, mean, median, min, max, sample std (one row)."""
    v = F.col(value)
    agg = df.agg(
        F.count(F.lit(1)).alias("total_registros"),
        *[F.countDistinct(c).alias(f"{c}_unicos") for c in distinct],
        F.avg(v).alias("promedio_sueldo"), F.min(v).alias("min_sueldo"),
        F.max(v).alias("max_sueldo"), F.stddev_samp(v).alias("desv_std"))
    return with_quantiles(agg, df, value, {"mediana_sueldo": 0.5})


def dashboard_metrics(df: DataFrame, value: str = SAL, ranks: DataFrame | None = None) -> DataFrame:
    """AGG-02: AGG-01 subset + coefficient of variation (0 when mean <= 0)."""
    v = F.col(value)
    agg = df.agg(
        F.count(F.lit(1)).alias("total_registros"),
        F.countDistinct("organismo").alias("organismos_unicos"),
        F.countDistinct("estamento").alias("estamentos_unicos"),
        F.avg(v).alias("promedio_sueldo"), F.min(v).alias("min_sueldo"),
        F.max(v).alias("max_sueldo"), F.stddev_samp(v).alias("desv_std"))
    agg = agg.withColumn("coef_variacion", F.when(F.col("promedio_sueldo") > 0,
                                                  F.col("desv_std") / F.col("promedio_sueldo"))
                         .otherwise(F.lit(0.0)))
    return with_quantiles(agg, df, value, {"mediana_sueldo": 0.5}, ranks=ranks)


def value_counts(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """AGG-04: count per non-null key, descending (key ascending breaks ties)."""
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.desc(name), F.asc(key)))


def top_counts(df: DataFrame, key: str, n: int = 10, name: str = "n") -> DataFrame:
    """AGG-05: first ``n`` of value_counts (TakeOrderedAndProject)."""
    return value_counts(df, key, name).limit(n)


def count_by(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """AGG-06: SQL ``GROUP BY`` count; a null key is its own group."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(F.asc_nulls_first(key))


def top_avg(df: DataFrame, keys=("organismo",), value: str = SAL, n: int = 10) -> DataFrame:
    """AGG-07: per key count and average, top ``n`` by count."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("registros"),
                                  F.round(F.avg(value), 2).alias("promedio"))
            .orderBy(F.desc("registros"), *[F.asc(k) for k in keys]).limit(n))


def sql_scalars(df: DataFrame, value: str = SAL, key: str = "organismo",
                cond: Column | None = None) -> DataFrame:
    """AGG-08: COUNT, COUNT DISTINCT, AVG (null -> 0), MAX, conditional COUNT."""
    cond = cond if cond is not None else (F.col(value) > 0)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct(key).alias("distintos"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("promedio"),
        F.max(value).alias("maximo"),
        F.count_if(cond).alias("condicionados"))


def group_mean(df: DataFrame, key: str, value: str = SAL) -> DataFrame:
    """AGG-09: mean per key, sorted descending."""
    return (df.groupBy(key).agg(F.avg(value).alias("promedio"))
            .orderBy(F.desc("promedio"), F.asc(key)))


def group_compare(df: DataFrame, key: str, value: str = SAL, min_rows: int = 1) -> DataFrame:
    """AGG-10: mean, median, count (bround 0) per key, sorted by mean; HAVING n >= min_rows."""
    agg = df.groupBy(key).agg(F.avg(value).alias("_mean"), F.count(value).alias("n"))
    full = with_quantiles(agg, df, value, {"_median": 0.5}, (key,))
    return (full.where(F.col("n") >= min_rows)
            .select(key, F.bround("_mean", 0).alias("promedio"),
                    F.bround("_median", 0).alias("mediana"), "n")
            .orderBy(F.desc("promedio"), F.asc(key)))


def category_stats(df: DataFrame, key: str = "categoria_organismo", value: str = SAL,
                   body: str = "organismo", ranks: DataFrame | None = None) -> DataFrame:
    """AGG-11: count, mean, median, std, distinct bodies per category."""
    agg = df.groupBy(key).agg(
        F.count(value).alias("n"), F.avg(value).alias("promedio"),
        F.stddev_samp(value).alias("desv_std"), F.countDistinct(body).alias("organismos"))
    return with_quantiles(agg, df, value, {"mediana": 0.5}, (key,), ranks=ranks)


def two_key_mean(df: DataFrame, a: str, b: str, value: str = SAL) -> DataFrame:
    """AGG-12: mean per (a, b)."""
    return df.groupBy(a, b).agg(F.avg(value).alias("promedio"), F.count(value).alias("n"))


def entity_profile(df: DataFrame, key: str, value: str = SAL,
                   distinct=("organismo", "estamento")) -> DataFrame:
    """AGG-13: per entity n, distincts, mean, median, min, max, std, p25, p75, IQR, CV.

    Computed for *all* entities at once (the reference profiles one at a time).
    """
    v = F.col(value)
    agg = df.groupBy(key).agg(
        F.count(v).alias("n"),
        *[F.countDistinct(c).alias(f"{c}_unicos") for c in distinct if c != key],
        F.avg(v).alias("promedio"), F.min(v).alias("minimo"), F.max(v).alias("maximo"),
        F.stddev_samp(v).alias("desv_std"))
    full = with_quantiles(agg, df, value, {"mediana": 0.5, "p25": 0.25, "p75": 0.75}, (key,))
    return full.withColumn("iqr", F.col("p75") - F.col("p25")).withColumn(
        "cv", F.try_divide(F.col("desv_std"), F.col("promedio")))


def describe(df: DataFrame, value: str = SAL) -> DataFrame:
    """AGG-14: count, mean, std, min, 25/50/75%, max as (stat, value) rows, bround 0."""
    v = F.col(value)
    agg = df.agg(F.count(v).cast("double").alias("count"), F.avg(v).alias("mean"),
                 F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    full = with_quantiles(agg, df, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    stats = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    labels = {"p25": "25%", "p50": "50%", "p75": "75%"}
    stack = ", ".join(f"'{labels.get(s, s)}', `{s}`" for s in stats)
    return full.selectExpr(f"stack({len(stats)}, {stack}) as (stat, value)") \
        .select("stat", F.bround("value", 0).alias("value"))


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """AGG-17: count per key and percent of all rows (total attached as a one-row broadcast)."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("_total"))
    return _one_row_join(g, total).select(key, "n", (F.col("n") * 100.0 / F.col("_total")).alias("pct"))


def filtered_delta(df: DataFrame, cond: Column, value: str = SAL) -> DataFrame:
    """AGG-18: filtered mean vs global mean, difference and % difference in one pass."""
    agg = df.agg(F.avg(F.when(cond, F.col(value))).alias("promedio_filtrado"),
                 F.avg(value).alias("promedio_global"),
                 F.count_if(cond).alias("n_filtrado"), F.count(F.lit(1)).alias("n_global"))
    d = F.col("promedio_filtrado") - F.col("promedio_global")
    return agg.select("*", d.alias("diferencia"),
                      F.try_divide(d * 100.0, F.col("promedio_global")).alias("diferencia_pct"))


def size_by_period(df: DataFrame, key: str) -> DataFrame:
    """AGG-19: rows per key, sorted by key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(key)


def before_after(before: DataFrame, after: DataFrame, value: str = SAL,
                 body: str = "organismo", klass: str = "estamento") -> DataFrame:
    """AGG-20: metrics of two snapshots side by side plus differences.

    Both snapshots are tagged and unioned so the metrics are one grouped
    aggregate (one scan of each side), then pivoted on the two tags.
    """
    u = (before.select(body, klass, value).withColumn("_snap", F.lit("antes"))
         .unionByName(after.select(body, klass, value).withColumn("_snap", F.lit("despues"))))
    m = u.groupBy("_snap").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(body).alias("organismos"),
        F.countDistinct(klass).alias("estamentos"), F.min(value).alias("minimo"),
        F.max(value).alias("maximo"), F.avg(value).alias("promedio"))
    metrics = ["n", "organismos", "estamentos", "minimo", "maximo", "promedio"]
    stack = ", ".join(f"'{c}', cast(`{c}` as double)" for c in metrics)
    long = m.selectExpr("_snap", f"stack({len(metrics)}, {stack}) as (metrica, valor)")
    wide = long.groupBy("metrica").pivot("_snap", ["antes", "despues"]).agg(F.first("valor"))
    return wide.withColumn("diferencia", F.col("despues") - F.col("antes"))


def statistics_rows(df: DataFrame, value: str = SAL, body: str = "organismo",
                    klass: str = "estamento", category: str = "categoria_organismo",
                    top: int = 10) -> DataFrame:
    """AGG-03 as long rows ``(seccion, clave, valor)``: scalars, top bodies, top classes,
    category distribution.  Each section is its own small aggregate; top-N use
    TakeOrdered with a key tie-break."""
    v = F.col(value)
    sc = df.agg(
        F.count(F.lit(1)).cast("double").alias("total_registros"),
        F.countDistinct(body).cast("double").alias("organismos_unicos"),
        F.countDistinct(klass).cast("double").alias("estamentos_unicos"),
        F.countDistinct(category).cast("double").alias("categorias_organismos"),
        F.round(F.avg(v), 2).alias("sueldo_promedio"), F.round(F.min(v), 2).alias("sueldo_minimo"),
        F.round(F.max(v), 2).alias("sueldo_maximo"), F.round(F.stddev_samp(v), 2).alias("sueldo_desviacion"))
    sc = with_quantiles(sc, df, value, {"sueldo_mediana": 0.5}).withColumn(
        "sueldo_mediana", F.round("sueldo_mediana", 2))
    names = sc.columns
    stack = ", ".join(f"'{c}', `{c}`" for c in names)
    scal = sc.selectExpr(f"stack({len(names)}, {stack}) as (clave, valor)").select(
        F.lit("escalares").alias("seccion"), "clave", "valor")

    def section(name, key, limit):
        vc = value_counts(df, key)
        if limit:
            vc = vc.limit(limit)
        return vc.select(F.lit(name).alias("seccion"), F.col(key).alias("clave"),
                         F.col("n").cast("double").alias("valor"))

    return (scal.unionByName(section("top_organismos", body, top))
            .unionByName(section("top_estamentos", klass, top))
            .unionByName(section("distribucion_categorias", category, None)))


def statistics_doc(df: DataFrame, value: str = SAL, top: int = 10) -> DataFrame:
    """AGG-03 as one nested row (scalars + maps), for the JSON statistics sink."""
    rows = statistics_rows(df, value, top=top)
    ent = F.struct(F.col("clave"), F.col("valor"))
    return rows.groupBy().agg(*[
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("seccion") == s, ent))))
        .alias(s) for s in ("escalares", "top_organismos", "top_estamentos", "distribucion_categorias")])
