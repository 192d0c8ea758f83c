"""Registered composite pipelines (PIP-01..10)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from nomina.operators import aggregates as A
from nomina.plans import pipelines as P
from nomina.plans import sqltext as S
from nomina.plans.common import SAL, categorised, payroll, rounded
from nomina.plans.q_quality import raw_staff
from nomina.plans.registry import query
from nomina.session import scratch_path

CAT11 = S.categorize_11("organismo")
STATS_ROUND = {"promedio_sueldo": 2, "min_sueldo": 2, "max_sueldo": 2, "desv_std": 2, "mediana_sueldo": 2}


def _land_raw(spark, sf_dir):
    """raw/<source>/<YYYY-MM>/*.csv landing derived from the tables."""
    root = scratch_path(spark, f"raw-{uuid.uuid4().hex[:12]}")
    raw = raw_staff(spark, sf_dir).join(payroll(spark, sf_dir).select("id", "fuente", "periodo"), "id")
    (raw.withColumnRenamed("fuente", "fuente_dir").withColumnRenamed("periodo", "periodo_dir")
     .hint("rebalance", "fuente_dir", "periodo_dir").write.partitionBy("fuente_dir", "periodo_dir").option("header", True).csv(root))
    return root


SUMMARY_SQL = """
SELECT count(*) AS total_registros, count(DISTINCT organismo) AS organismo_unicos,
  count(DISTINCT estamento) AS estamento_unicos, count(DISTINCT grado) AS grado_unicos,
  count(DISTINCT fuente) AS fuente_unicos, round(avg(sueldo_bruto), 2) AS promedio_sueldo,
  round(min(sueldo_bruto), 2) AS min_sueldo, round(max(sueldo_bruto), 2) AS max_sueldo,
  round(stddev_samp(sueldo_bruto), 2) AS desv_std, round(quantile_cont(sueldo_bruto, 0.5), 2) AS mediana_sueldo"""


@query("pip01_monthly_etl", f"""
WITH canon AS (SELECT {S.clean_text('organismo')} AS organismo, {S.clean_text('nombre')} AS nombre,
  {S.clean_text('cargo')} AS cargo, {S.clean_text('grado')} AS grado, {S.clean_text('estamento')} AS estamento,
  {S.money_auto("CASE WHEN fuente <> 'P' THEN sueldo_texto END")} AS sueldo_bruto, fuente FROM payroll),
v AS (SELECT * FROM canon WHERE sueldo_bruto IS NOT NULL AND sueldo_bruto > 0),
q AS (SELECT quantile_cont(sueldo_bruto, 0.01) AS lo, quantile_cont(sueldo_bruto, 0.99) AS hi FROM v),
clean AS (SELECT v.* FROM v, q WHERE sueldo_bruto BETWEEN lo AND hi)
{SUMMARY_SQL} FROM clean""")
def pip01_monthly_etl(spark, sf_dir):
    root = _land_raw(spark, sf_dir)
    out = scratch_path(spark, f"etl-{uuid.uuid4().hex[:12]}")
    res = P.monthly_etl(spark, root, None, "2025-09-30 00:00:00", out_dir=out)
    return rounded(res.stats, STATS_ROUND)


@query("pip02_clean_consolidated", f"""
WITH d AS (SELECT CASE WHEN {CAT11} = 'Otros' THEN NULL ELSE organismo END AS organismo, fuente, sueldo_bruto
  FROM payroll),
c AS (SELECT CASE WHEN fuente = 'P' AND organismo IS NULL THEN 'Municipalidad'
  ELSE coalesce(organismo, 'Sin especificar') END AS organismo, sueldo_bruto FROM d
  WHERE sueldo_bruto > 0 AND sueldo_bruto < 10000000)
SELECT organismo, count(*) AS n FROM c GROUP BY organismo""")
def pip02_clean_consolidated(spark, sf_dir):
    d = categorised(spark, sf_dir).withColumn(
        "organismo", F.when(F.col("categoria_organismo") == "Otros", F.lit(None)).otherwise(F.col("organismo")))
    clean = P.clean_consolidated(d, api_source="P")
    return A.value_counts(clean, "organismo")


@query("pip03_final_consolidation", f"""
WITH s AS (SELECT 'sii' AS fuente, coalesce({S.money_auto("CASE WHEN fuente <> 'P' THEN sueldo_texto END")},
  {S.money_auto("CASE WHEN fuente = 'P' THEN sueldo_texto END")}) AS sueldo_bruto FROM payroll),
u AS (SELECT fuente, sueldo_bruto FROM s UNION ALL SELECT fuente, sueldo_bruto FROM payroll)
SELECT fuente, count(*) AS n, round(avg(sueldo_bruto), 2) AS promedio FROM u
WHERE sueldo_bruto > 0 AND sueldo_bruto < 10000000 GROUP BY fuente""")
def pip03_final_consolidation(spark, sf_dir):
    cons = P.final_consolidation(raw_staff(spark, sf_dir), payroll(spark, sf_dir), "sii")
    return rounded(cons.groupBy("fuente").agg(F.count(F.lit(1)).alias("n"), F.avg(SAL).alias("promedio")),
                   {"promedio": 2})


@query("pip04_enrich", f"""
WITH d AS (SELECT id, organismo, upper(estamento) AS estamento, sueldo_bruto FROM payroll WHERE sueldo_bruto > 100000),
r AS (SELECT id, (rank() OVER (ORDER BY sueldo_bruto) + (count(*) OVER (PARTITION BY sueldo_bruto) - 1) / 2.0)
  / count(*) OVER () * 100 AS pct FROM d),
b AS (SELECT organismo, count(*) AS total_funcionarios, round_even(avg(sueldo_bruto), 0) AS promedio_sueldo,
  round_even(quantile_cont(sueldo_bruto, 0.5), 0) AS mediana_sueldo FROM d GROUP BY 1),
e AS (SELECT estamento, count(*) AS total_estamento, round_even(avg(sueldo_bruto), 0) AS promedio_estamento,
  round_even(quantile_cont(sueldo_bruto, 0.5), 0) AS mediana_estamento FROM d GROUP BY 1)
SELECT d.id, {S.categorize_11('d.organismo')} AS categoria_organismo, {S.band_enrich('d.sueldo_bruto')} AS sueldo_categoria,
  round(r.pct, 6) AS sueldo_percentil, total_funcionarios, promedio_sueldo, mediana_sueldo, total_estamento,
  promedio_estamento, mediana_estamento
FROM d JOIN r ON d.id = r.id JOIN b ON d.organismo = b.organismo JOIN e ON d.estamento = e.estamento""")
def pip04_enrich(spark, sf_dir):
    e = P.enrich(payroll(spark, sf_dir))
    return rounded(e.select("id", "categoria_organismo", "sueldo_categoria", "sueldo_percentil", "total_funcionarios",
                            "promedio_sueldo", "mediana_sueldo", "total_estamento", "promedio_estamento",
                            "mediana_estamento"), {"sueldo_percentil": 6})


@query("pip05_categorise_filter_sample", f"""
WITH k AS (SELECT *, {S.categorize_5('organismo')} AS categoria_organismo FROM payroll WHERE sueldo_bruto >= 200000),
s AS (SELECT count(*) AS n, count(DISTINCT organismo) AS b FROM k),
c AS (SELECT k.*, CASE WHEN contains(lower(organismo), 'ministerio') OR contains(lower(organismo), 'servicio')
        THEN greatest(3, 5000 // b) * 3 ELSE greatest(3, 5000 // b) END AS cap FROM k, s),
r AS (SELECT *, row_number() OVER (PARTITION BY organismo ORDER BY md5('42' || CAST(id AS VARCHAR)), id) AS rk FROM c)
SELECT categoria_organismo, count(*) AS n FROM r WHERE rk <= cap GROUP BY 1""")
def pip05_categorise_filter_sample(spark, sf_dir):
    _kept, _problems, sample = P.categorise_filter_sample(payroll(spark, sf_dir))
    return sample.groupBy("categoria_organismo").agg(F.count(F.lit(1)).alias("n"))


@query("pip06_geo_repair", f"""
WITH geo AS (SELECT organismo, CASE WHEN coalesce(contains(lower(organismo), 'municipalidad'), false)
  THEN {S.city_from_text('cargo')} END AS sug FROM payroll)
SELECT count(*) AS total_registros, count_if(contains(lower(organismo), 'municipalidad')) AS registros_municipales,
  count_if(sug IS NOT NULL AND lower(sug) <> lower(organismo)) AS registros_invalidos,
  round(CASE WHEN count_if(contains(lower(organismo), 'municipalidad')) > 0 THEN
    (count_if(contains(lower(organismo), 'municipalidad')) - count_if(sug IS NOT NULL AND lower(sug) <> lower(organismo)))
    * 100.0 / count_if(contains(lower(organismo), 'municipalidad')) ELSE 0 END, 4) AS tasa_validez FROM geo""")
def pip06_geo_repair(spark, sf_dir):
    report, _fixed = P.geo_repair(payroll(spark, sf_dir))
    return rounded(report, {"tasa_validez": 4})


@query("pip07_load_and_monitor")
def pip07_load_and_monitor(spark, sf_dir):
    """Rows-only: load gate, table replace, load-log append and health report."""
    base = scratch_path(spark, f"load-{uuid.uuid4().hex[:12]}")
    return P.load_and_monitor(spark, payroll(spark, sf_dir), f"{base}/sueldos", f"{base}/metadata",
                              "2025-09-30 00:00:00", max_hours=48)


@query("pip08_dashboard_query", """
WITH f AS (SELECT * FROM payroll WHERE estamento = 'BUILDING' AND sueldo_bruto BETWEEN 100000 AND 10000000),
m AS (SELECT count(*) AS total_registros, round(avg(sueldo_bruto), 2) AS promedio_sueldo,
  round(quantile_cont(sueldo_bruto, 0.5), 2) AS mediana_sueldo FROM f),
q AS (SELECT max(m) / min(m) AS r, count(*) AS g FROM (SELECT estamento, avg(sueldo_bruto) AS m FROM f GROUP BY 1)),
v AS (SELECT sueldo_bruto AS x, row_number() OVER (ORDER BY sueldo_bruto) AS i FROM f),
gi AS (SELECT count(*) AS n, sum(x) AS t, sum(i * x) AS s FROM v)
SELECT total_registros, promedio_sueldo, mediana_sueldo, CASE WHEN g > 1 THEN round(r, 6) ELSE 1.0 END AS ratio_max_min,
  round(CASE WHEN n <= 1 OR t <= 0 THEN 0 ELSE 2 * s / (n * t) - (n + 1) / n END, 6) AS gini FROM m, q, gi""")
def pip08_dashboard_query(spark, sf_dir):
    r = P.dashboard_query(payroll(spark, sf_dir), [("estamento", "BUILDING"), ("fuente", "Todas")],
                          lo=100_000, hi=10_000_000)
    m = r["metricas"].select("total_registros", "promedio_sueldo", "mediana_sueldo")
    from nomina.operators.scalars import attach_row

    one = attach_row(attach_row(m, r["equidad"].select("ratio_max_min")), r["gini"].select("gini"))
    return rounded(one, {"promedio_sueldo": 2, "mediana_sueldo": 2, "ratio_max_min": 6, "gini": 6})


@query("pip09_inequality_report", f"""
WITH d AS (SELECT sueldo_bruto AS x FROM payroll WHERE sueldo_bruto BETWEEN 100000 AND 10000000),
v AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM d),
g AS (SELECT CASE WHEN count(*) <= 1 OR sum(x) <= 0 THEN 0 ELSE 2 * sum(i * x) / (count(*) * sum(x))
  - (count(*) + 1) / count(*) END AS gini FROM v),
o AS (SELECT CASE WHEN min(x) > 0 THEN max(x) / min(x) ELSE 0 END AS ratio_max_min,
  quantile_cont(x, 0.9) / quantile_cont(x, 0.1) AS p90_p10, quantile_cont(x, 0.75) / quantile_cont(x, 0.25) AS p75_p25,
  stddev_samp(x) / avg(x) AS cv FROM d)
SELECT round(gini, 6) AS gini, round(ratio_max_min, 6) AS ratio_max_min, round(p90_p10, 6) AS p90_p10,
  round(p75_p25, 6) AS p75_p25, round(cv, 6) AS cv, {S.inequality_label('gini')} AS desigualdad FROM g, o""")
def pip09_inequality_report(spark, sf_dir):
    return rounded(P.inequality_report(payroll(spark, sf_dir)),
                   {"gini": 6, "ratio_max_min": 6, "p90_p10": 6, "p75_p25": 6, "cv": 6})


@query("pip10_consolidate_month", f"""
WITH d AS (SELECT fuente, organismo, {S.money_auto("CASE WHEN fuente <> 'P' THEN sueldo_texto END")} AS s FROM payroll)
SELECT fuente, count(*) AS n, round(avg(s), 2) AS promedio, count(DISTINCT organismo) AS organismos,
  round(quantile_cont(s, 0.5), 2) AS mediana FROM d GROUP BY fuente""")
def pip10_consolidate_month(spark, sf_dir):
    root = _land_raw(spark, sf_dir)
    out = P.consolidate_month(spark, root, None, "2025-09-30 00:00:00")
    return rounded(out, {"promedio": 2, "mediana": 2})
