"""Joins and lookups (JOI-01..09).

Group statistics are attached with ``groupBy`` + equi-join, never with a
window partitioned by the group (a hot body would land in one task).  The
statistics side has one row per key; the planner broadcasts it when AQE
sees it is small, and AQE's skew join splits a hot key otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomina.operators.ranks import exact_quantiles

SAL = "sueldo_bruto"


def group_enrich(df: DataFrame, key: str, names: tuple[str, str, str], value: str = SAL) -> DataFrame:
    """JOI-01/02: left-join per-key count / mean / median (bround 0) onto every row."""
    n, mean, median = names
    agg = df.groupBy(key).agg(F.count(value).alias(n), F.bround(F.avg(value), 0).alias(mean))
    med = exact_quantiles(df, value, {median: 0.5}, (key,)).select(
        key, F.bround(F.col(median), 0).alias(median))
    stats = agg.join(med, key, "left")
    return df.join(stats, key, "left")


def enrich_body(df: DataFrame, value: str = SAL) -> DataFrame:
    """JOI-01."""
    return group_enrich(df, "organismo", ("total_funcionarios", "promedio_sueldo", "mediana_sueldo"), value)


def enrich_class(df: DataFrame, value: str = SAL) -> DataFrame:
    """JOI-02."""
    return group_enrich(df, "estamento", ("total_estamento", "promedio_estamento", "mediana_estamento"), value)


def resume_anti(catalogue: DataFrame, progress: DataFrame, key: str) -> DataFrame:
    """JOI-03: catalogue entries whose key never reached ``success``."""
    done = progress.where(F.col("status") == "success").select(key)
    return catalogue.join(done, key, "left_anti")


def retry_semi(catalogue: DataFrame, progress: DataFrame, key: str) -> DataFrame:
    """JOI-04: catalogue entries whose current status is ``error``, most errors first."""
    err = progress.where(F.col("status") == "error").select(key, "error_count")
    return catalogue.join(err, key, "inner").orderBy(F.desc("error_count"), F.asc(key))


def url_lookup(results: DataFrame, links: DataFrame, url: str = "url") -> DataFrame:
    """JOI-05: attach the body of the link list to each result url (first match)."""
    first = links.groupBy(url).agg(F.min(F.struct("orden", "organismo")).alias("_m")) \
        .select(url, F.col("_m.organismo").alias("organismo"))
    return results.join(first, url, "inner")


def lost_keys(before: DataFrame, after: DataFrame, key) -> DataFrame:
    """JOI-06: keys present before and absent after, with the rows they had."""
    keys = [key] if isinstance(key, str) else list(key)
    gone = before.select(*keys).distinct().join(after.select(*keys).distinct(), keys, "left_anti")
    counts = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("registros_perdidos"))
    return gone.join(counts, keys, "inner")


def lost_rows(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """JOI-07: rows present before and absent after (anti join on the row key)."""
    return before.join(after.select(key), key, "left_anti")


def catalogue_flatten(catalogue: DataFrame, map_col: str, prefix: str = "Municipalidad de ") -> DataFrame:
    """JOI-08: ``map<region, array<name>>`` -> one row per (region, body)."""
    kv = catalogue.select(F.explode(map_col).alias("region", "_names"))
    return kv.select("region", F.explode("_names").alias("comuna")).withColumn(
        "organismo", F.concat(F.lit(prefix), F.col("comuna")))


def scalar_compare(grouped: DataFrame, df: DataFrame, measure: str, value: str = SAL) -> DataFrame:
    """JOI-09: attach the global mean to every group row (scalar subquery) and diff."""
    from nomina.operators.scalars import attach_row

    g = df.agg(F.avg(value).alias("promedio_global"))
    j = attach_row(grouped, g)
    return j.withColumn("diferencia", F.col(measure) - F.col("promedio_global")).withColumn(
        "diferencia_pct", F.try_divide(F.col("diferencia") * 100.0, F.col("promedio_global")))
