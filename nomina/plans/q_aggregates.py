"""Registered aggregation queries (AGG-*), each with a DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from nomina.operators import aggregates as A
from nomina.operators import filters as FL
from nomina.plans import sqltext as S
from nomina.plans.common import SAL, categorised, payroll, rounded
from nomina.plans.registry import query

CAT11 = S.categorize_11("organismo")


@query("agg11_category_stats", f"""
SELECT categoria_organismo, count(sueldo_bruto) AS n, round(avg(sueldo_bruto), 2) AS promedio,
       round(stddev_samp(sueldo_bruto), 2) AS desv_std, count(DISTINCT organismo) AS organismos,
       round(quantile_cont(sueldo_bruto, 0.5), 2) AS mediana
FROM (SELECT *, {CAT11} AS categoria_organismo FROM payroll
      WHERE sueldo_bruto BETWEEN 100000 AND 10000000) t
GROUP BY categoria_organismo""")
def agg11_category_stats(spark, sf_dir):
    """Flagship: FLT-05 -> SCL-12 -> AGG-11."""
    df = FL.closed_range(categorised(spark, sf_dir))
    out = A.category_stats(df)
    return rounded(out, {"promedio": 2, "desv_std": 2, "mediana": 2})


@query("agg01_summary_stats", """
SELECT count(*) AS total_registros, count(DISTINCT organismo) AS organismo_unicos,
  count(DISTINCT estamento) AS estamento_unicos, count(DISTINCT grado) AS grado_unicos,
  count(DISTINCT fuente) AS fuente_unicos, round(avg(sueldo_bruto), 2) AS promedio_sueldo,
  round(min(sueldo_bruto), 2) AS min_sueldo, round(max(sueldo_bruto), 2) AS max_sueldo,
  round(stddev_samp(sueldo_bruto), 2) AS desv_std, round(quantile_cont(sueldo_bruto, 0.5), 2) AS mediana_sueldo
FROM payroll""")
def agg01_summary_stats(spark, sf_dir):
    out = A.summary_stats(payroll(spark, sf_dir))
    return rounded(out, {c: 2 for c in ["promedio_sueldo", "min_sueldo", "max_sueldo", "desv_std",
                                        "mediana_sueldo"]})


@query("agg02_dashboard_metrics", """
SELECT count(*) AS total_registros, count(DISTINCT organismo) AS organismos_unicos,
  count(DISTINCT estamento) AS estamentos_unicos, round(avg(sueldo_bruto), 2) AS promedio_sueldo,
  round(min(sueldo_bruto), 2) AS min_sueldo, round(max(sueldo_bruto), 2) AS max_sueldo,
  round(stddev_samp(sueldo_bruto), 2) AS desv_std,
  round(CASE WHEN avg(sueldo_bruto) > 0 THEN stddev_samp(sueldo_bruto) / avg(sueldo_bruto) ELSE 0 END, 6) AS coef_variacion,
  round(quantile_cont(sueldo_bruto, 0.5), 2) AS mediana_sueldo
FROM payroll WHERE sueldo_bruto IS NOT NULL""")
def agg02_dashboard_metrics(spark, sf_dir):
    out = A.dashboard_metrics(payroll(spark, sf_dir).where(F.col(SAL).isNotNull()))
    return rounded(out, {"promedio_sueldo": 2, "min_sueldo": 2, "max_sueldo": 2, "desv_std": 2,
                         "coef_variacion": 6, "mediana_sueldo": 2})


@query("agg03_statistics_doc", f"""
WITH base AS (SELECT *, {CAT11} AS categoria_organismo FROM payroll WHERE sueldo_bruto > 100000),
sc AS (
  SELECT count(*)::DOUBLE AS total_registros, count(DISTINCT organismo)::DOUBLE AS organismos_unicos,
    count(DISTINCT estamento)::DOUBLE AS estamentos_unicos,
    count(DISTINCT categoria_organismo)::DOUBLE AS categorias_organismos,
    round(avg(sueldo_bruto), 2) AS sueldo_promedio, round(quantile_cont(sueldo_bruto, 0.5), 2) AS sueldo_mediana,
    round(min(sueldo_bruto), 2) AS sueldo_minimo, round(max(sueldo_bruto), 2) AS sueldo_maximo,
    round(stddev_samp(sueldo_bruto), 2) AS sueldo_desviacion FROM base)
SELECT 'escalares' AS seccion, clave, valor FROM (UNPIVOT sc ON COLUMNS(*) INTO NAME clave VALUE valor)
UNION ALL
SELECT 'top_organismos', organismo, n::DOUBLE FROM (SELECT organismo, count(*) AS n FROM base
  WHERE organismo IS NOT NULL GROUP BY 1 ORDER BY n DESC, organismo LIMIT 10)
UNION ALL
SELECT 'top_estamentos', estamento, n::DOUBLE FROM (SELECT estamento, count(*) AS n FROM base
  WHERE estamento IS NOT NULL GROUP BY 1 ORDER BY n DESC, estamento LIMIT 10)
UNION ALL
SELECT 'distribucion_categorias', categoria_organismo, count(*)::DOUBLE FROM base GROUP BY 2""")
def agg03_statistics_doc(spark, sf_dir):
    df = FL.floor_filter(categorised(spark, sf_dir))
    return A.statistics_rows(df)


@query("agg04_value_counts", """
SELECT organismo, count(*) AS n FROM payroll WHERE organismo IS NOT NULL GROUP BY organismo""")
def agg04_value_counts(spark, sf_dir):
    return A.value_counts(payroll(spark, sf_dir), "organismo")


@query("agg05_top_counts", """
SELECT organismo, count(*) AS n FROM payroll WHERE organismo IS NOT NULL
GROUP BY organismo ORDER BY n DESC, organismo LIMIT 10""")
def agg05_top_counts(spark, sf_dir):
    return A.top_counts(payroll(spark, sf_dir), "organismo", 10)


@query("agg06_count_by", f"""
SELECT {S.band_enrich('sueldo_bruto')} AS sueldo_categoria, count(*) AS n FROM payroll GROUP BY 1""")
def agg06_count_by(spark, sf_dir):
    from nomina.functions.categorize import band_enrich
    df = payroll(spark, sf_dir).withColumn("sueldo_categoria", band_enrich(SAL))
    return A.count_by(df, "sueldo_categoria")


@query("agg07_top_avg", """
SELECT organismo, count(*) AS registros, round(avg(sueldo_bruto), 2) AS promedio FROM payroll
GROUP BY organismo ORDER BY registros DESC, organismo LIMIT 10""")
def agg07_top_avg(spark, sf_dir):
    return A.top_avg(payroll(spark, sf_dir), ("organismo",), SAL, 10)


@query("agg07_top_avg_by_region_status", """
SELECT region, fuente, count(*) AS registros, round(avg(sueldo_bruto), 2) AS promedio FROM payroll
GROUP BY region, fuente ORDER BY registros DESC, region, fuente LIMIT 10""")
def agg07_top_avg_by_region_status(spark, sf_dir):
    return A.top_avg(payroll(spark, sf_dir), ("region", "fuente"), SAL, 10)


@query("agg08_sql_scalars", """
SELECT count(*) AS total, count(DISTINCT organismo) AS distintos,
  round(coalesce(avg(sueldo_bruto), 0), 2) AS promedio, round(max(sueldo_bruto), 2) AS maximo,
  count_if(sueldo_bruto > 1000000) AS condicionados FROM payroll""")
def agg08_sql_scalars(spark, sf_dir):
    out = A.sql_scalars(payroll(spark, sf_dir), cond=F.col(SAL) > 1_000_000)
    return rounded(out, {"promedio": 2, "maximo": 2})


@query("agg09_group_mean", """
SELECT estamento, round(avg(sueldo_bruto), 2) AS promedio FROM payroll GROUP BY estamento""")
def agg09_group_mean(spark, sf_dir):
    return rounded(A.group_mean(payroll(spark, sf_dir), "estamento"), {"promedio": 2})


@query("agg10_group_compare", """
SELECT organismo, round_even(avg(sueldo_bruto), 0) AS promedio,
  round_even(quantile_cont(sueldo_bruto, 0.5), 0) AS mediana, count(sueldo_bruto) AS n
FROM payroll GROUP BY organismo HAVING count(sueldo_bruto) >= 5""")
def agg10_group_compare(spark, sf_dir):
    return A.group_compare(payroll(spark, sf_dir), "organismo", min_rows=5)


@query("agg12_two_key_mean", f"""
SELECT {CAT11} AS categoria_organismo, organismo, round(avg(sueldo_bruto), 2) AS promedio,
  count(sueldo_bruto) AS n FROM payroll GROUP BY 1, 2""")
def agg12_two_key_mean(spark, sf_dir):
    out = A.two_key_mean(categorised(spark, sf_dir), "categoria_organismo", "organismo")
    return rounded(out, {"promedio": 2})


@query("agg13_entity_profile", """
SELECT grado, count(sueldo_bruto) AS n, count(DISTINCT organismo) AS organismo_unicos,
  count(DISTINCT estamento) AS estamento_unicos, round(avg(sueldo_bruto), 2) AS promedio,
  round(min(sueldo_bruto), 2) AS minimo, round(max(sueldo_bruto), 2) AS maximo,
  round(stddev_samp(sueldo_bruto), 2) AS desv_std, round(quantile_cont(sueldo_bruto, 0.5), 2) AS mediana,
  round(quantile_cont(sueldo_bruto, 0.25), 2) AS p25, round(quantile_cont(sueldo_bruto, 0.75), 2) AS p75,
  round(quantile_cont(sueldo_bruto, 0.75) - quantile_cont(sueldo_bruto, 0.25), 2) AS iqr,
  round(stddev_samp(sueldo_bruto) / avg(sueldo_bruto), 6) AS cv
FROM payroll GROUP BY grado""")
def agg13_entity_profile(spark, sf_dir):
    out = A.entity_profile(payroll(spark, sf_dir), "grado")
    return rounded(out, {"promedio": 2, "minimo": 2, "maximo": 2, "desv_std": 2, "mediana": 2,
                         "p25": 2, "p75": 2, "iqr": 2, "cv": 6})


@query("agg14_describe", """
WITH s AS (SELECT count(sueldo_bruto)::DOUBLE AS c, avg(sueldo_bruto) AS m, stddev_samp(sueldo_bruto) AS sd,
  min(sueldo_bruto) AS mn, quantile_cont(sueldo_bruto, 0.25) AS p25, quantile_cont(sueldo_bruto, 0.5) AS p50,
  quantile_cont(sueldo_bruto, 0.75) AS p75, max(sueldo_bruto) AS mx FROM payroll)
SELECT stat, round_even(value, 0) AS value FROM (
  SELECT 'count' AS stat, c AS value FROM s UNION ALL SELECT 'mean', m FROM s UNION ALL
  SELECT 'std', sd FROM s UNION ALL SELECT 'min', mn FROM s UNION ALL SELECT '25%', p25 FROM s UNION ALL
  SELECT '50%', p50 FROM s UNION ALL SELECT '75%', p75 FROM s UNION ALL SELECT 'max', mx FROM s)""")
def agg14_describe(spark, sf_dir):
    return A.describe(payroll(spark, sf_dir))


@query("agg17_share_of_total", """
SELECT estamento, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct
FROM payroll GROUP BY estamento""")
def agg17_share_of_total(spark, sf_dir):
    return rounded(A.share_of_total(payroll(spark, sf_dir), "estamento"), {"pct": 4})


@query("agg18_filtered_delta", f"""
SELECT round(avg(CASE WHEN {CAT11} = 'Ministerio' THEN sueldo_bruto END), 2) AS promedio_filtrado,
  round(avg(sueldo_bruto), 2) AS promedio_global,
  count_if({CAT11} = 'Ministerio') AS n_filtrado, count(*) AS n_global,
  round(avg(CASE WHEN {CAT11} = 'Ministerio' THEN sueldo_bruto END) - avg(sueldo_bruto), 2) AS diferencia,
  round((avg(CASE WHEN {CAT11} = 'Ministerio' THEN sueldo_bruto END) - avg(sueldo_bruto)) * 100.0
        / avg(sueldo_bruto), 4) AS diferencia_pct
FROM payroll""")
def agg18_filtered_delta(spark, sf_dir):
    df = categorised(spark, sf_dir)
    out = A.filtered_delta(df, F.col("categoria_organismo") == "Ministerio")
    return rounded(out, {"promedio_filtrado": 2, "promedio_global": 2, "diferencia": 2,
                         "diferencia_pct": 4})


@query("agg19_size_by_period", """
SELECT substr(periodo, 1, 4) AS anio, count(*) AS n FROM payroll GROUP BY 1""")
def agg19_size_by_period(spark, sf_dir):
    df = payroll(spark, sf_dir).withColumn("anio", F.substring("periodo", 1, 4))
    return A.size_by_period(df, "anio")


@query("agg20_before_after", """
WITH u AS (
  SELECT 'antes' AS snap, organismo, estamento, sueldo_bruto FROM payroll
  UNION ALL
  SELECT 'despues', organismo, estamento, sueldo_bruto FROM payroll
  WHERE sueldo_bruto > 0 AND sueldo_bruto < 10000000),
m AS (SELECT snap, count(*)::DOUBLE AS n, count(DISTINCT organismo)::DOUBLE AS organismos,
  count(DISTINCT estamento)::DOUBLE AS estamentos, min(sueldo_bruto) AS minimo, max(sueldo_bruto) AS maximo,
  avg(sueldo_bruto) AS promedio FROM u GROUP BY snap),
l AS (UNPIVOT m ON n, organismos, estamentos, minimo, maximo, promedio INTO NAME metrica VALUE valor)
SELECT metrica, round(max(valor) FILTER (WHERE snap = 'antes'), 2) AS antes,
  round(max(valor) FILTER (WHERE snap = 'despues'), 2) AS despues,
  round(max(valor) FILTER (WHERE snap = 'despues') - max(valor) FILTER (WHERE snap = 'antes'), 2) AS diferencia
FROM l GROUP BY metrica""")
def agg20_before_after(spark, sf_dir):
    before = payroll(spark, sf_dir)
    after = FL.open_range(before)
    return rounded(A.before_after(before, after), {"antes": 2, "despues": 2, "diferencia": 2})
