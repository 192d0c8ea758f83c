"""Registered window / sort / set / join queries (WIN, SRT, SET, JOI)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nomina.operators import filters as FL
from nomina.operators import joins as J
from nomina.operators import setops as SE
from nomina.operators import topk as TK
from nomina.operators import windows as W
from nomina.plans import sqltext as S
from nomina.plans.common import SAL, categorised, payroll, rounded, table
from nomina.plans.registry import query
from nomina.streaming.progress import attempts_from_events, progress

CAT11 = S.categorize_11("organismo")

PROGRESS_SQL = """
att AS (SELECT user_id AS organismo_id, event_id AS intento_id, ts,
  CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'error' ELSE 'no_data' END AS status,
  CASE WHEN event_type = 'error' THEN 'error ' || props END AS error,
  CASE WHEN event_type = 'purchase' THEN CAST(round(value, 0) AS BIGINT) ELSE 0 END AS data_count,
  value AS processing_time FROM events),
prog AS (SELECT organismo_id, arg_max(status, (ts, intento_id)) AS status, max(ts) AS last_attempt,
  count_if(status = 'success') AS success_count, count_if(status = 'error') AS error_count,
  arg_max({'e': error}, (ts, intento_id)).e AS last_error, CAST(sum(data_count) AS BIGINT) AS data_total,
  arg_max(data_count, (ts, intento_id)) AS data_count, arg_max(processing_time, (ts, intento_id)) AS processing_time
  FROM att GROUP BY organismo_id)"""


@query("win01_pct_rank_avg", """
WITH v AS (SELECT id, sueldo_bruto FROM payroll WHERE sueldo_bruto IS NOT NULL),
r AS (SELECT id, (rank() OVER (ORDER BY sueldo_bruto) + (count(*) OVER (PARTITION BY sueldo_bruto) - 1) / 2.0)
  / count(*) OVER () * 100 AS percentil FROM v)
SELECT p.id, p.sueldo_bruto, round(r.percentil, 6) AS percentil FROM payroll p LEFT JOIN r ON p.id = r.id""")
def win01_pct_rank_avg(spark, sf_dir):
    df = payroll(spark, sf_dir).select("id", SAL)
    return rounded(W.avg_rank_percentile(df, SAL), {"percentil": 6})


@query("win02_running_share", """
WITH g AS (SELECT periodo, round(sum(sueldo_bruto), 2) AS masa FROM payroll GROUP BY periodo)
SELECT periodo, masa, round(sum(masa) OVER (ORDER BY periodo ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS acumulado,
  round(sum(masa) OVER (ORDER BY periodo ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(masa) OVER (), 8)
  AS participacion_acumulada FROM g""")
def win02_running_share(spark, sf_dir):
    g = payroll(spark, sf_dir).groupBy("periodo").agg(F.round(F.sum(SAL), 2).alias("masa"))
    return rounded(W.running_share(g, "periodo", "masa"), {"acumulado": 2, "participacion_acumulada": 8})


@query("win03_top_n_per_group", f"""
WITH c AS (SELECT {CAT11} AS categoria_organismo, organismo, count(*) AS n FROM payroll GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY categoria_organismo ORDER BY n DESC, organismo) AS rango
  FROM c) WHERE rango <= 5""")
def win03_top_n_per_group(spark, sf_dir):
    return W.top_n_per_group(categorised(spark, sf_dir), "categoria_organismo", "organismo", 5)


@query("win03_top_n_summary", """
WITH c AS (SELECT region, grado, count(*) AS n FROM payroll GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY grado) AS rango,
  count(*) OVER (PARTITION BY region) AS k FROM c)
SELECT region, grado, n, rango, greatest(k - 10, 0) AS restantes FROM r WHERE rango <= 10""")
def win03_top_n_summary(spark, sf_dir):
    return W.top_n_summary(payroll(spark, sf_dir), "region", "grado", 10)


@query("win05_batch_no", """
WITH k AS (SELECT DISTINCT c_name FROM customer ORDER BY c_name LIMIT 60)
SELECT c_name, row_number() OVER (ORDER BY c_name) AS posicion,
  CAST(floor((row_number() OVER (ORDER BY c_name) - 1) / 20) AS INTEGER) AS lote FROM k""", payroll=False)
def win05_batch_no(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select("c_name").distinct()
    return W.batch_numbers(keys, "c_name", 20, 3)


@query("srt01_top_salaries", """
SELECT id, organismo, estamento, sueldo_bruto FROM payroll WHERE sueldo_bruto IS NOT NULL
ORDER BY sueldo_bruto DESC, id LIMIT 20""")
def srt01_top_salaries(spark, sf_dir):
    return TK.top_salaries(payroll(spark, sf_dir), 20).select("id", "organismo", "estamento", SAL)


@query("srt01_top_salaries_in_selection", """
SELECT id, organismo, sueldo_bruto FROM payroll WHERE estamento = 'MACHINERY' AND sueldo_bruto IS NOT NULL
ORDER BY sueldo_bruto DESC, id LIMIT 10""")
def srt01_top_salaries_in_selection(spark, sf_dir):
    df = FL.cascade(payroll(spark, sf_dir), [("estamento", "MACHINERY")])
    return TK.top_salaries(df, 10).select("id", "organismo", SAL)


@query("srt02_top_groups", """
SELECT grado, round(avg(sueldo_bruto), 2) AS promedio, count(sueldo_bruto) AS n FROM payroll
GROUP BY grado ORDER BY avg(sueldo_bruto) DESC, grado LIMIT 5""")
def srt02_top_groups(spark, sf_dir):
    return rounded(TK.top_groups(payroll(spark, sf_dir), "grado", 5), {"promedio": 2})


@query("srt03_sort_by", """
SELECT id, sueldo_bruto FROM payroll ORDER BY sueldo_bruto DESC NULLS LAST""")
def srt03_sort_by(spark, sf_dir):
    return TK.sort_by(payroll(spark, sf_dir).select("id", SAL), SAL, ascending=False)


@query("srt04_preview", """SELECT id, organismo, sueldo_texto FROM payroll ORDER BY id LIMIT 100""")
def srt04_preview(spark, sf_dir):
    return TK.preview(payroll(spark, sf_dir).select("id", "organismo", "sueldo_texto"), 100)


@query("set01_union_all", """
SELECT id, fuente, sueldo_bruto FROM payroll UNION ALL SELECT id, fuente, sueldo_bruto FROM payroll WHERE fuente = 'O'""")
def set01_union_all(spark, sf_dir):
    p = payroll(spark, sf_dir).select("id", "fuente", SAL)
    return SE.union_all(p, p.where(F.col("fuente") == "O"))


@query("set03_difference", """
SELECT organismo, periodo FROM payroll EXCEPT SELECT organismo, periodo FROM payroll WHERE sueldo_bruto > 5000000""")
def set03_difference(spark, sf_dir):
    p = payroll(spark, sf_dir)
    return SE.difference(p.select("organismo", "periodo"),
                         p.where(F.col(SAL) > 5_000_000).select("organismo", "periodo"))


@query("set04_distinct_values", """SELECT DISTINCT cargo FROM payroll""")
def set04_distinct_values(spark, sf_dir):
    return SE.distinct_values(payroll(spark, sf_dir), "cargo")


@query("joi01_enrich_body", """
WITH s AS (SELECT organismo, count(sueldo_bruto) AS total_funcionarios, round_even(avg(sueldo_bruto), 0) AS promedio_sueldo,
  round_even(quantile_cont(sueldo_bruto, 0.5), 0) AS mediana_sueldo FROM payroll GROUP BY organismo)
SELECT p.id, p.organismo, p.sueldo_bruto, s.total_funcionarios, s.promedio_sueldo, s.mediana_sueldo
FROM payroll p LEFT JOIN s ON p.organismo = s.organismo""")
def joi01_enrich_body(spark, sf_dir):
    df = payroll(spark, sf_dir).select("id", "organismo", SAL)
    return J.enrich_body(df)


@query("joi02_enrich_class", """
WITH s AS (SELECT estamento, count(sueldo_bruto) AS total_estamento, round_even(avg(sueldo_bruto), 0) AS promedio_estamento,
  round_even(quantile_cont(sueldo_bruto, 0.5), 0) AS mediana_estamento FROM payroll GROUP BY estamento)
SELECT p.id, p.estamento, p.sueldo_bruto, s.total_estamento, s.promedio_estamento, s.mediana_estamento
FROM payroll p LEFT JOIN s ON p.estamento = s.estamento""")
def joi02_enrich_class(spark, sf_dir):
    df = payroll(spark, sf_dir).select("id", "estamento", SAL)
    return J.enrich_class(df)


@query("joi03_resume_anti", f"""
WITH {PROGRESS_SQL}
SELECT c_custkey AS organismo_id, c_name FROM customer
WHERE c_custkey NOT IN (SELECT organismo_id FROM prog WHERE status = 'success')""", payroll=False)
def joi03_resume_anti(spark, sf_dir):
    cat = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("organismo_id"), "c_name")
    prog = progress(attempts_from_events(table(spark, sf_dir, "events")))
    return J.resume_anti(cat, prog, "organismo_id")


@query("joi04_retry_semi", f"""
WITH {PROGRESS_SQL}
SELECT c.c_custkey AS organismo_id, c.c_name, p.error_count FROM customer c
JOIN prog p ON c.c_custkey = p.organismo_id WHERE p.status = 'error'""", payroll=False)
def joi04_retry_semi(spark, sf_dir):
    cat = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("organismo_id"), "c_name")
    prog = progress(attempts_from_events(table(spark, sf_dir, "events")))
    return J.retry_semi(cat, prog, "organismo_id")


@query("joi06_lost_keys", """
WITH gone AS (SELECT DISTINCT organismo, grado FROM payroll
  EXCEPT SELECT DISTINCT organismo, grado FROM payroll WHERE sueldo_bruto > 10000000)
SELECT g.organismo, g.grado, count(*) AS registros_perdidos FROM gone g
JOIN payroll p ON p.organismo = g.organismo AND p.grado = g.grado GROUP BY 1, 2""")
def joi06_lost_keys(spark, sf_dir):
    p = payroll(spark, sf_dir)
    return J.lost_keys(p, p.where(F.col(SAL) > 10_000_000), ["organismo", "grado"])


@query("joi07_lost_rows", """
SELECT id, organismo, sueldo_bruto FROM payroll
WHERE id NOT IN (SELECT id FROM payroll WHERE sueldo_bruto > 0 AND sueldo_bruto < 10000000)""")
def joi07_lost_rows(spark, sf_dir):
    p = payroll(spark, sf_dir).select("id", "organismo", SAL)
    return J.lost_rows(p, FL.open_range(p))


@query("joi08_catalogue_flatten", """
SELECT r.r_name AS region, n.n_name AS comuna, 'Municipalidad de ' || n.n_name AS organismo
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""", payroll=False)
def joi08_catalogue_flatten(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    # region -> [comunas] catalogue built from the tables (one map row)
    per_region = n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(
        F.collect_list("n_name").alias("comunas"))
    cat = per_region.agg(F.map_from_entries(F.collect_list(F.struct("r_name", "comunas"))).alias("catalogo"))
    return J.catalogue_flatten(cat, "catalogo")


@query("joi09_scalar_compare", """
WITH g AS (SELECT estamento, avg(sueldo_bruto) AS promedio FROM payroll GROUP BY 1),
t AS (SELECT avg(sueldo_bruto) AS promedio_global FROM payroll)
SELECT estamento, round(promedio, 2) AS promedio, round(promedio_global, 2) AS promedio_global,
  round(promedio - promedio_global, 2) AS diferencia,
  round((promedio - promedio_global) * 100.0 / promedio_global, 4) AS diferencia_pct FROM g, t""")
def joi09_scalar_compare(spark, sf_dir):
    p = payroll(spark, sf_dir)
    g = p.groupBy("estamento").agg(F.avg(SAL).alias("promedio"))
    return rounded(J.scalar_compare(g, p, "promedio"),
                   {"promedio": 2, "promedio_global": 2, "diferencia": 2, "diferencia_pct": 4})


@query("win04_top_issues", """
WITH v AS (SELECT id, CASE WHEN sueldo_bruto IS NULL THEN 'Sueldo' WHEN sueldo_bruto < 100000 THEN 'Sueldo bajo'
  WHEN sueldo_bruto > 10000000 THEN 'Sueldo alto' END AS tipo FROM payroll),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tipo ORDER BY id) AS r FROM v WHERE tipo IS NOT NULL)
  WHERE r <= 10)
SELECT id, tipo FROM f ORDER BY tipo, id LIMIT 20""")
def win04_top_issues(spark, sf_dir):
    """First 10 issues per type, then the first 20 overall."""
    s = F.col(SAL)
    issue = F.when(s.isNull(), "Sueldo").when(s < 100_000, "Sueldo bajo").when(s > 10_000_000, "Sueldo alto")
    issues = payroll(spark, sf_dir).select("id", issue.alias("tipo")).where(F.col("tipo").isNotNull())
    return W.top_issues(issues, "tipo", "id", 10, 20)


@query("joi05_url_lookup", """
WITH l AS (SELECT page_id AS orden, regexp_replace(url, '[?#].*$', '') AS url,
  regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) AS organismo FROM pages),
f AS (SELECT url, arg_min(organismo, orden) AS organismo FROM l GROUP BY url)
SELECT p.page_id, f.url, f.organismo FROM pages p JOIN f ON regexp_replace(p.url, '[?#].*$', '') = f.url""",
       payroll=False)
def joi05_url_lookup(spark, sf_dir):
    """Result urls (query/fragment stripped) -> body of the first matching link-list entry."""
    from nomina.sources.html import host
    pages = table(spark, sf_dir, "pages")
    base = F.regexp_replace("url", r"[?#].*$", "")
    links = pages.select(F.col("page_id").alias("orden"), base.alias("url"), host("url").alias("organismo"))
    return J.url_lookup(pages.select("page_id", base.alias("url")), links)
