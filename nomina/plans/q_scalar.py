"""Registered scalar-function queries (SCL-01..30 not covered with the sources)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nomina.functions import categorize as C
from nomina.functions import money as M
from nomina.functions import text as T
from nomina.functions import urls as U
from nomina.functions.geo import city_from_text
from nomina.operators import inequality as I
from nomina.plans import sqltext as S
from nomina.plans.common import SAL, categorised, payroll, rounded, table
from nomina.plans.registry import query

MONEY = [("scl02_money_auto", "auto", S.money_auto), ("scl03_money_cl", "cl", S.money_cl),
         ("scl04_money_validator", "validator", S.money_validator),
         ("scl05_money_extractor", "extractor", S.money_extractor),
         ("scl06_money_multidot", "multidot", S.money_multidot)]


def _money_query(dialect):
    def run(spark, sf_dir):
        p = payroll(spark, sf_dir)
        return p.select("id", "sueldo_texto", M.parse_money("sueldo_texto", dialect).alias("sueldo"))
    run.__doc__ = f"Money parser '{dialect}' over every rendered salary text."
    return run


for _key, _dialect, _sql in MONEY:
    query(_key, f"SELECT id, sueldo_texto, {_sql('sueldo_texto')} AS sueldo FROM payroll")(_money_query(_dialect))


@query("scl07_to_number", """SELECT id, TRY_CAST(sueldo_texto AS DOUBLE) AS sueldo FROM payroll""")
def scl07_to_number(spark, sf_dir):
    return payroll(spark, sf_dir).select("id", M.to_number("sueldo_texto").alias("sueldo"))


@query("scl01_clean_text", f"""
SELECT doc_id, md5({S.clean_text('text')}) AS huella, length({S.clean_text('text')}) AS largo FROM documents""",
       payroll=False)
def scl01_clean_text(spark, sf_dir):
    """clean_text over whole document texts; the cleaned text is fingerprinted."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.clean_text("text").alias("t"))
    return d.select("doc_id", F.md5("t").alias("huella"), F.length("t").alias("largo"))


@query("scl08_09_fill_upper", f"""
SELECT id, {S.fill_trim(S.band_enrich('sueldo_bruto'))} AS sueldo_categoria,
  upper({S.fill_trim('estamento')}) AS estamento FROM payroll""")
def scl08_09_fill_upper(spark, sf_dir):
    p = payroll(spark, sf_dir)
    return p.select("id", T.fill_trim(C.band_enrich(SAL)).alias("sueldo_categoria"),
                    T.upper_class("estamento").alias("estamento"))


@query("scl10_11_capitalize_canon", f"""
SELECT id, {S.capitalize_words('organismo')} AS organismo, {S.capitalize_words('nombre')} AS nombre,
  {S.canon_class('estamento')} AS estamento FROM payroll""")
def scl10_11_capitalize_canon(spark, sf_dir):
    p = payroll(spark, sf_dir)
    return p.select("id", T.capitalize_words("organismo").alias("organismo"),
                    T.capitalize_words("nombre").alias("nombre"), T.canon_class("estamento").alias("estamento"))


@query("scl12_categorize_11", f"""
SELECT {S.categorize_11('organismo')} AS categoria_organismo, count(*) AS n FROM payroll GROUP BY 1""")
def scl12_categorize_11(spark, sf_dir):
    return categorised(spark, sf_dir).groupBy("categoria_organismo").agg(F.count(F.lit(1)).alias("n"))


@query("scl13_categorize_5", f"""
SELECT organismo, {S.categorize_5('organismo')} AS categoria FROM (SELECT DISTINCT organismo FROM payroll)""")
def scl13_categorize_5(spark, sf_dir):
    p = payroll(spark, sf_dir).select("organismo").distinct()
    return p.select("organismo", C.categorize_5("organismo").alias("categoria"))


@query("scl14_infer_class", f"""
SELECT {S.infer_class('text')} AS estamento, count(*) AS n FROM documents GROUP BY 1""", payroll=False)
def scl14_infer_class(spark, sf_dir):
    """Class keywords searched over whole document texts."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy(C.infer_class("text").alias("estamento")).agg(F.count(F.lit(1)).alias("n"))


@query("scl15_infer_body", f"""
SELECT id, CASE WHEN fuente = 'F' AND ({S.categorize_11('organismo')} = 'Otros')
  THEN 'Municipalidad' ELSE organismo END AS organismo FROM payroll""")
def scl15_infer_body(spark, sf_dir):
    """Bodies of unknown type are missing; those of source 'F' are inferred municipal."""
    p = categorised(spark, sf_dir)
    body = F.when(F.col("categoria_organismo") == "Otros", F.lit(None).cast("string")).otherwise(F.col("organismo"))
    return p.select("id", F.coalesce(C.infer_body(body, "fuente", "F"), F.col("organismo")).alias("organismo"))


@query("scl16_17_bands", f"""
SELECT id, {S.band_dashboard('sueldo_bruto')} AS banda_dashboard, {S.band_enrich('sueldo_bruto')} AS banda_enriquecida
FROM payroll""")
def scl16_17_bands(spark, sf_dir):
    p = payroll(spark, sf_dir)
    return p.select("id", C.band_dashboard(SAL).alias("banda_dashboard"),
                    C.band_enrich(SAL).alias("banda_enriquecida"))


@query("scl23_city_from_text", f"""
SELECT doc_id, {S.city_from_text('text')} AS municipio_sugerido FROM documents""", payroll=False)
def scl23_city_from_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", city_from_text("text").alias("municipio_sugerido"))


@query("scl26_contains_ci", """
SELECT lang, count_if(coalesce(contains(lower(text), 'license'), false)) AS con_licencia, count(*) AS n
FROM documents GROUP BY lang""", payroll=False)
def scl26_contains_ci(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count_if(T.contains_ci("text", "LICENSE")).alias("con_licencia"),
                                 F.count(F.lit(1)).alias("n"))


@query("scl27_inequality_label", """
WITH v AS (SELECT estamento, sueldo_bruto AS x, row_number() OVER (PARTITION BY estamento ORDER BY sueldo_bruto) AS i
  FROM payroll WHERE sueldo_bruto IS NOT NULL),
g AS (SELECT estamento, count(*) AS n, sum(x) AS t, sum(i * x) AS s FROM v GROUP BY 1),
h AS (SELECT estamento, CASE WHEN n <= 1 OR t <= 0 THEN 0 ELSE 2 * s / (n * t) - (n + 1) / n END AS gini FROM g)
SELECT estamento, round(gini, 6) AS gini, """ + S.inequality_label("gini") + """ AS desigualdad FROM h""")
def scl27_inequality_label(spark, sf_dir):
    g = I.gini(payroll(spark, sf_dir), SAL, ("estamento",))
    return rounded(g.select("estamento", "gini", C.inequality_label("gini").alias("desigualdad")), {"gini": 6})


@query("scl28_money_format", """
WITH g AS (SELECT organismo, avg(sueldo_bruto) AS m, count(*) AS n FROM payroll GROUP BY organismo),
t AS (SELECT avg(sueldo_bruto) AS mg, count(*) AS nt FROM payroll),
d AS (SELECT organismo, m, round_even(m - mg, 0) AS dv, round(n * 100.0 / nt, 4) AS share FROM g, t)
SELECT organismo, '$' || format('{:,}', CAST(round_even(m, 0) AS BIGINT)) AS promedio_texto,
  CASE WHEN dv >= 0 THEN '+' ELSE '-' END || format('{:,}', CAST(abs(dv) AS BIGINT)) AS diferencia_texto,
  format('{:,.1f}', share) || '%' AS participacion_texto FROM d""")
def scl28_money_format(spark, sf_dir):
    """'$1,234,567' means, '+1,234' / '-1,234' differences to the global mean, '12.3%' shares."""
    from nomina.operators.scalars import attach_row

    p = payroll(spark, sf_dir)
    g = p.groupBy("organismo").agg(F.avg(SAL).alias("_m"), F.count(F.lit(1)).alias("_n"))
    g = attach_row(g, p.agg(F.avg(SAL).alias("_mg"), F.count(F.lit(1)).alias("_nt")))
    share = F.round(F.col("_n") * 100.0 / F.col("_nt"), 4)
    return g.select("organismo", U.money_format("_m").alias("promedio_texto"),
                    U.signed_format(F.col("_m") - F.col("_mg")).alias("diferencia_texto"),
                    U.pct_format(share, 1).alias("participacion_texto"))


@query("scl29_ts_format_hours", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_texto,
  round((epoch(TIMESTAMP '2024-12-31 00:00:00') - floor(epoch(ts))) / 3600.0, 4) AS horas FROM events""", payroll=False)
def scl29_ts_format_hours(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    as_of = F.lit("2024-12-31 00:00:00").cast("timestamp_ntz")
    return rounded(ev.select("event_id", U.ts_format("ts").alias("ts_texto"),
                             U.hours_since("ts", as_of).alias("horas")), {"horas": 4})
