"""Registered filter / validation / sampling / mapping queries (FLT, VAL, GEN, MAP)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from nomina.functions import categorize as C
from nomina.operators import filters as FL
from nomina.operators import mapping as MP
from nomina.operators import quality as Q
from nomina.operators import sampling as G
from nomina.plans import sqltext as S
from nomina.plans.common import SAL, categorised, payroll, rounded, table
from nomina.plans.registry import query
from nomina.session import scratch_path

CAT11 = S.categorize_11("organismo")

# --- a raw, Spanish-headed staff table derived from the payroll view ---------------------------
RAW_COLS = {
    "id": "id", "Institución": "organismo", "Nombres": "nombre", "Apellido Paterno": "region",
    "Apellido Materno": "estamento", "Cargo o función": "cargo", "Grado EUS": "grado", "Estamento": "estamento",
}


def raw_staff(spark, sf_dir):
    p = payroll(spark, sf_dir)
    staff = F.col("fuente") != "P"
    return p.select(*[F.col(v).alias(k) for k, v in RAW_COLS.items()],
                    F.when(staff, F.col("sueldo_texto")).alias("Remuneración bruta mensualizada"),
                    F.when(~staff, F.col("sueldo_texto")).alias("Honorario bruto mensual"),
                    F.substring("periodo", 1, 4).alias("anio"), F.substring("periodo", 6, 2).alias("mes"))


RAW_SQL = "raw_staff AS (SELECT " + ", ".join(f'{v} AS "{k}"' for k, v in RAW_COLS.items()) + """,
  CASE WHEN fuente <> 'P' THEN sueldo_texto END AS "Remuneración bruta mensualizada",
  CASE WHEN fuente = 'P' THEN sueldo_texto END AS "Honorario bruto mensual",
  substr(periodo, 1, 4) AS anio, substr(periodo, 6, 2) AS mes FROM payroll)"""

REM, HON = '"Remuneración bruta mensualizada"', '"Honorario bruto mensual"'


def _raw(sql):
    return "WITH " + RAW_SQL + ",\n" + sql


# --- FLT ------------------------------------------------------------------------------------
@query("flt01_valid_salary", """SELECT id, sueldo_bruto FROM payroll WHERE sueldo_bruto IS NOT NULL AND sueldo_bruto > 0""")
def flt01_valid_salary(spark, sf_dir):
    return FL.valid_salary(payroll(spark, sf_dir)).select("id", SAL)


@query("flt02_quantile_trim", """
WITH v AS (SELECT * FROM payroll WHERE sueldo_bruto IS NOT NULL AND sueldo_bruto > 0),
q AS (SELECT quantile_cont(sueldo_bruto, 0.01) AS lo, quantile_cont(sueldo_bruto, 0.99) AS hi FROM v)
SELECT id, sueldo_bruto FROM v, q WHERE sueldo_bruto BETWEEN lo AND hi""")
def flt02_quantile_trim(spark, sf_dir):
    return FL.quantile_trim(FL.valid_salary(payroll(spark, sf_dir))).select("id", SAL)


@query("flt03_floor", """SELECT estamento, count(*) AS n FROM payroll WHERE sueldo_bruto > 100000 GROUP BY 1""")
def flt03_floor(spark, sf_dir):
    return FL.floor_filter(payroll(spark, sf_dir)).groupBy("estamento").agg(F.count(F.lit(1)).alias("n"))


@query("flt04_open_range", """SELECT estamento, count(*) AS n FROM payroll
WHERE sueldo_bruto > 0 AND sueldo_bruto < 10000000 GROUP BY 1""")
def flt04_open_range(spark, sf_dir):
    return FL.open_range(payroll(spark, sf_dir)).groupBy("estamento").agg(F.count(F.lit(1)).alias("n"))


@query("flt05_closed_range", """SELECT estamento, count(*) AS n FROM payroll
WHERE sueldo_bruto BETWEEN 100000 AND 10000000 GROUP BY 1""")
def flt05_closed_range(spark, sf_dir):
    return FL.closed_range(payroll(spark, sf_dir)).groupBy("estamento").agg(F.count(F.lit(1)).alias("n"))


@query("flt06_split_floor", """
SELECT organismo, count(*) AS problemas, round(count(*) * 100.0 / (SELECT count(*) FROM payroll), 4) AS pct
FROM payroll WHERE sueldo_bruto < 200000 GROUP BY organismo""")
def flt06_split_floor(spark, sf_dir):
    return FL.problem_report(payroll(spark, sf_dir), "organismo")


@query("flt06_problems_by_source", """
SELECT fuente, count(*) AS problemas, round(count(*) * 100.0 / (SELECT count(*) FROM payroll), 4) AS pct
FROM payroll WHERE sueldo_bruto < 200000 GROUP BY fuente""")
def flt06_problems_by_source(spark, sf_dir):
    return FL.problem_report(payroll(spark, sf_dir), "fuente")


@query("flt06_kept", """SELECT id, sueldo_bruto FROM payroll WHERE sueldo_bruto >= 200000""")
def flt06_kept(spark, sf_dir):
    return FL.split_floor(payroll(spark, sf_dir))[0].select("id", SAL)


@query("flt07_in_lists", """
SELECT id FROM payroll WHERE organismo IN ('Ministerio de NATION_1', 'Servicio de NATION_2', 'Servicio NATION_2')
AND estamento IN ('BUILDING', 'MACHINERY')""")
def flt07_in_lists(spark, sf_dir):
    df = FL.in_lists(payroll(spark, sf_dir),
                     organismo=["Ministerio de NATION_1", "Servicio de NATION_2", "Servicio NATION_2"],
                     estamento=["BUILDING", "MACHINERY"], grado=[])
    return df.select("id")


@query("flt08_slider_range", """SELECT id FROM payroll WHERE sueldo_bruto BETWEEN 1000000 AND 5000000""")
def flt08_slider_range(spark, sf_dir):
    return FL.slider_range(payroll(spark, sf_dir), 1_000_000, 5_000_000).select("id")


@query("flt09_cascade", f"""
SELECT count(*) AS n, round(avg(sueldo_bruto), 2) AS promedio FROM payroll
WHERE {CAT11} = 'Municipalidad' AND estamento = 'BUILDING' AND sueldo_bruto BETWEEN 500000 AND 8000000""")
def flt09_cascade(spark, sf_dir):
    df = FL.cascade(categorised(spark, sf_dir),
                    [("categoria_organismo", "Municipalidad"), ("organismo", "Todos"), ("estamento", "BUILDING")],
                    lo=500_000, hi=8_000_000)
    return rounded(df.agg(F.count(F.lit(1)).alias("n"), F.avg(SAL).alias("promedio")), {"promedio": 2})


@query("flt10_option_list", f"""SELECT DISTINCT organismo FROM payroll WHERE {CAT11} = 'Ministerio'""")
def flt10_option_list(spark, sf_dir):
    return FL.option_list(categorised(spark, sf_dir).where(F.col("categoria_organismo") == "Ministerio"), "organismo")


@query("flt11_default_top_options", """SELECT DISTINCT organismo FROM payroll ORDER BY organismo LIMIT 10""")
def flt11_default_top_options(spark, sf_dir):
    return FL.default_top_options(payroll(spark, sf_dir), "organismo", 10)


@query("flt11_preselected_rows", """
SELECT id FROM payroll WHERE organismo IN (SELECT DISTINCT organismo FROM payroll WHERE organismo IS NOT NULL ORDER BY organismo LIMIT 10)""")
def flt11_preselected_rows(spark, sf_dir):
    return FL.preselected(payroll(spark, sf_dir), "organismo", 10).select("id")


@query("flt12_min_group_size", """
SELECT organismo, grado, count(sueldo_bruto) AS n, round(avg(sueldo_bruto), 2) AS promedio FROM payroll
GROUP BY 1, 2 HAVING count(sueldo_bruto) >= 5""")
def flt12_min_group_size(spark, sf_dir):
    agg = payroll(spark, sf_dir).groupBy("organismo", "grado").agg(
        F.count(SAL).alias("n"), F.round(F.avg(SAL), 2).alias("promedio"))
    return FL.min_group_size(agg, "n", 5)


# --- VAL ------------------------------------------------------------------------------------
def _validated(spark, sf_dir):
    return Q.row_errors(Q.clean_for_validation(payroll(spark, sf_dir)))


def _sql_errors():
    s = "sueldo_v"
    n, c = "trim(nombre_v)", "trim(cargo_v)"
    e, o = "upper(trim(estamento_v))", "upper(trim(organismo_v))"
    money0 = lambda x: f"'$' || format('{{:,.0f}}', {x})"
    classes = ", ".join(S.q(x) for x in Q.VALID_CLASSES)
    body_ok = " OR ".join(f"contains({o}, {S.q(k)})" for k in Q.BODY_KEYWORDS)
    return f"""list_filter([
  CASE WHEN {s} IS NULL OR isnan({s}) THEN 'Sueldo: Sueldo nulo'
       WHEN {s} < {Q.SALARY_MIN} THEN 'Sueldo: Sueldo muy bajo: ' || {money0(s)}
       WHEN {s} > {Q.SALARY_MAX} THEN 'Sueldo: Sueldo muy alto: ' || {money0(s)} END,
  CASE WHEN nombre_v IS NULL OR nombre_v = '' THEN 'Nombre: Nombre vacío'
       WHEN length({n}) < {Q.NAME_LEN[0]} THEN 'Nombre: Nombre muy corto'
       WHEN length({n}) > {Q.NAME_LEN[1]} THEN 'Nombre: Nombre muy largo'
       WHEN NOT regexp_matches({n}, '{Q.NAME_RE}') THEN 'Nombre: Nombre contiene caracteres inválidos' END,
  CASE WHEN cargo_v IS NULL OR cargo_v = '' THEN 'Cargo: Cargo vacío'
       WHEN length({c}) < {Q.POST_LEN[0]} THEN 'Cargo: Cargo muy corto'
       WHEN length({c}) > {Q.POST_LEN[1]} THEN 'Cargo: Cargo muy largo' END,
  CASE WHEN estamento_v IS NULL OR estamento_v = '' THEN 'Estamento: Estamento vacío'
       WHEN {e} NOT IN ({classes}) THEN 'Estamento: Estamento no válido: ' || {e} END,
  CASE WHEN organismo_v IS NULL OR organismo_v = '' THEN 'Organismo: Organismo vacío'
       WHEN NOT ({body_ok}) THEN 'Organismo: Organismo no válido: ' || {o} END], lambda x: x IS NOT NULL)"""


VALIDATED_SQL = f"""
cleaned AS (SELECT id, {S.money_validator('sueldo_texto')} AS sueldo_v, {S.capitalize_words('nombre')} AS nombre_v,
  {S.capitalize_words('cargo')} AS cargo_v, {S.canon_class('estamento')} AS estamento_v,
  {S.capitalize_words('organismo')} AS organismo_v FROM payroll),
validated AS (SELECT *, {_sql_errors()} AS errores FROM cleaned)"""


@query("val01_row_rules", f"""WITH {VALIDATED_SQL}
SELECT id, array_to_string(errores, ' | ') AS errores FROM validated""")
def val01_row_rules(spark, sf_dir):
    return _validated(spark, sf_dir).select("id", F.array_join("errores", " | ").alias("errores"))


@query("val02_split_valid", f"""WITH {VALIDATED_SQL}
SELECT count(*) AS total, count_if(len(errores) = 0) AS validos, count_if(len(errores) > 0) AS invalidos,
  round(count_if(len(errores) = 0) * 100.0 / count(*), 4) AS tasa_validez FROM validated""")
def val02_split_valid(spark, sf_dir):
    return rounded(Q.validation_summary(_validated(spark, sf_dir)), {"tasa_validez": 4})


@query("val03_errors_by_rule", f"""WITH {VALIDATED_SQL}
SELECT split_part(e, ':', 1) AS regla, count(*) AS n, count(DISTINCT id) AS filas
FROM (SELECT id, unnest(errores) AS e FROM validated) GROUP BY 1""")
def val03_errors_by_rule(spark, sf_dir):
    return Q.errors_by_rule(_validated(spark, sf_dir))


GEO_SQL = f"""
geo AS (SELECT id, organismo, cargo,
  CASE WHEN coalesce(contains(lower(organismo), 'municipalidad'), false) THEN {S.city_from_text('cargo')} END AS sug
  FROM payroll)"""


@query("val04_geo_mismatch", f"""WITH {GEO_SQL}
SELECT id, NOT (sug IS NOT NULL AND lower(sug) <> lower(organismo)) AS validation_is_valid,
  sug AS suggested_municipality, CASE WHEN sug IS NOT NULL THEN 0.8 ELSE 0.0 END AS validation_confidence,
  CASE WHEN sug IS NOT NULL AND lower(sug) <> lower(organismo) THEN
    printf('Institución ''%s'' sugiere ''%s'' pero está asignada a ''%s''', cargo, sug, organismo) END AS mensaje
FROM geo WHERE contains(lower(organismo), 'municipalidad')""")
def val04_geo_mismatch(spark, sf_dir):
    v = Q.geo_validate(payroll(spark, sf_dir))
    return v.where(F.lower("organismo").contains("municipalidad")).select(
        "id", "validation_is_valid", "suggested_municipality", "validation_confidence",
        F.try_element_at("validation_issues", F.lit(1)).getField("message").alias("mensaje"))


@query("val05_geo_report", f"""WITH {GEO_SQL}
SELECT count(*) AS total_registros, count_if(contains(lower(organismo), 'municipalidad')) AS registros_municipales,
  count_if(sug IS NOT NULL AND lower(sug) <> lower(organismo)) AS registros_invalidos,
  CASE WHEN count_if(contains(lower(organismo), 'municipalidad')) > 0 THEN
    round((count_if(contains(lower(organismo), 'municipalidad')) - count_if(sug IS NOT NULL AND lower(sug) <> lower(organismo)))
    * 100.0 / count_if(contains(lower(organismo), 'municipalidad')), 4) ELSE 0 END AS tasa_validez FROM geo""")
def val05_geo_report(spark, sf_dir):
    return rounded(Q.geo_report(Q.geo_validate(payroll(spark, sf_dir))), {"tasa_validez": 4})


@query("val06_geo_fix", f"""WITH {GEO_SQL}
SELECT CASE WHEN sug IS NOT NULL AND lower(sug) <> lower(organismo) THEN sug ELSE organismo END AS organismo,
  count(*) AS n FROM geo GROUP BY 1""")
def val06_geo_fix(spark, sf_dir):
    fixed = Q.geo_fix(Q.geo_validate(payroll(spark, sf_dir)), apply=True)
    return fixed.groupBy("organismo").agg(F.count(F.lit(1)).alias("n"))


@query("val07_load_gate", """
SELECT count(*) AS n, count(sueldo_bruto) AS con_sueldo, count(organismo) AS nn_organismo,
  count(sueldo_bruto) AS nn_sueldo_bruto FROM payroll""")
def val07_load_gate(spark, sf_dir):
    """The gate's single aggregate; ``sinks.load_gate`` raises on it when a check fails."""
    from nomina.sources.sinks import gate_counts, load_gate
    p = payroll(spark, sf_dir)
    load_gate(p)
    return gate_counts(p)


@query("val08_freshness", """
SELECT max(ts) AS ultima_carga,
  round((epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(max(ts))) / 3.6e9, 4) AS horas,
  CASE WHEN (epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(max(ts))) / 3.6e9 <= 48 THEN 'PASS' ELSE 'FAIL' END
  AS estado FROM events""", payroll=False)
def val08_freshness(spark, sf_dir):
    return rounded(Q.freshness(table(spark, sf_dir, "events"), "ts", "2024-03-01 00:00:00"), {"horas": 4})


@query("val09_quality_score", """
SELECT count(*) AS total, count_if(sueldo_bruto > 0) AS con_sueldo, count(DISTINCT organismo) AS organismos,
  count(DISTINCT fuente) AS fuentes, round(count_if(sueldo_bruto > 0) * 100.0 / count(*), 4) AS pct_con_sueldo,
  'PASS' AS estado FROM payroll""")
def val09_quality_score(spark, sf_dir):
    return rounded(Q.quality_score(payroll(spark, sf_dir)), {"pct_con_sueldo": 4})


@query("val10_distribution_check", """
SELECT 'fuente' AS dimension, fuente AS clave, count(*) AS n FROM payroll GROUP BY 2
UNION ALL SELECT 'estamento', estamento, count(*) FROM payroll GROUP BY 2""")
def val10_distribution_check(spark, sf_dir):
    return Q.distribution_check(payroll(spark, sf_dir))


@query("val11_size_check")
def val11_size_check(spark, sf_dir):
    """Rows-only: size of a written output from the file listing."""
    path = scratch_path(spark, f"size-{uuid.uuid4().hex[:12]}")
    payroll(spark, sf_dir).write.parquet(path)
    return Q.size_check(spark, path)


@query("val12_health_report")
def val12_health_report(spark, sf_dir):
    """Rows-only: freshness + quality + distribution checks rolled into one report."""
    p = payroll(spark, sf_dir)
    fr = Q.freshness(p, "fecha_procesamiento", "2002-01-01 00:00:00", max_hours=24 * 365).select(
        F.lit("frescura").alias("check"), "estado", F.format_string("%.1f horas", F.col("horas")).alias("mensaje"))
    qs = Q.quality_score(p).select(F.lit("calidad").alias("check"), "estado",
                                   F.format_string("%.2f%% con sueldo", F.col("pct_con_sueldo")).alias("mensaje"))
    dist = Q.distribution_check(p).agg(F.count(F.lit(1)).alias("g")).select(
        F.lit("distribucion").alias("check"),
        F.when(F.col("g") > 0, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("estado"),
        F.format_string("%d grupos", F.col("g")).alias("mensaje"))
    return Q.health_report([fr, qs, dist])


@query("val13_completeness", _raw("""
SELECT columna, no_nulos, round(no_nulos * 100.0 / n, 4) AS completitud FROM (
  SELECT count(*) AS n, count("Remuneración bruta mensualizada") AS a, count("Honorario bruto mensual") AS b,
    count("Institución") AS c, count("Nombres") AS d FROM raw_staff)
UNPIVOT (no_nulos FOR columna IN (a AS 'Remuneración bruta mensualizada', b AS 'Honorario bruto mensual',
  c AS 'Institución', d AS 'Nombres'))"""))
def val13_completeness(spark, sf_dir):
    cols = ["Remuneración bruta mensualizada", "Honorario bruto mensual", "Institución", "Nombres"]
    return rounded(Q.completeness(raw_staff(spark, sf_dir), cols), {"completitud": 4})


@query("val14_source_audit", """
SELECT fuente, count(*) AS n, count_if(nombre IS NOT NULL AND nombre <> 'Sin especificar') AS con_nombre,
  0::BIGINT AS urls_oficiales,
  round(count_if(nombre IS NOT NULL AND nombre <> 'Sin especificar') * 100.0 / count(*), 4) AS pct_con_nombre
FROM payroll GROUP BY fuente""")
def val14_source_audit(spark, sf_dir):
    p = payroll(spark, sf_dir).withColumn(
        "archivo_origen", F.concat(F.lit("orders_"), F.col("periodo"), F.lit(".csv")))
    return rounded(Q.source_audit(p), {"pct_con_nombre": 4})


@query("val15_column_profile", """
SELECT columna, 'string' AS tipo, no_nulos, distintos, muestra FROM (
  SELECT 'organismo' AS columna, count(organismo) AS no_nulos, count(DISTINCT organismo) AS distintos,
    array_to_string(list_sort(list_slice(list_sort(list_distinct(list(organismo))), 1, 5)), ' | ') AS muestra FROM payroll
  UNION ALL SELECT 'nombre', count(nombre), count(DISTINCT nombre),
    array_to_string(list_sort(list_slice(list_sort(list_distinct(list(nombre))), 1, 5)), ' | ') FROM payroll
  UNION ALL SELECT 'cargo', count(cargo), count(DISTINCT cargo),
    array_to_string(list_sort(list_slice(list_sort(list_distinct(list(cargo))), 1, 5)), ' | ') FROM payroll
  UNION ALL SELECT 'grado', count(grado), count(DISTINCT grado),
    array_to_string(list_sort(list_slice(list_sort(list_distinct(list(grado))), 1, 5)), ' | ') FROM payroll
  UNION ALL SELECT 'estamento', count(estamento), count(DISTINCT estamento),
    array_to_string(list_sort(list_slice(list_sort(list_distinct(list(estamento))), 1, 5)), ' | ') FROM payroll)""")
def val15_column_profile(spark, sf_dir):
    p = payroll(spark, sf_dir).select("organismo", "nombre", "cargo", "grado", "estamento")
    return Q.column_profile(p, "o")


@query("val16_category_audit", f"""
SELECT {S.categorize_5('organismo')} AS categoria, count(*) AS n, count(DISTINCT organismo) AS organismos,
  round(avg(sueldo_bruto), 2) AS promedio, min(sueldo_bruto) AS minimo, max(sueldo_bruto) AS maximo
FROM payroll GROUP BY 1""")
def val16_category_audit(spark, sf_dir):
    p = payroll(spark, sf_dir).withColumn("categoria", C.categorize_5("organismo"))
    out = p.groupBy("categoria").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("organismo").alias("organismos"),
                                     F.avg(SAL).alias("promedio"), F.min(SAL).alias("minimo"),
                                     F.max(SAL).alias("maximo"))
    return rounded(out, {"promedio": 2})


@query("val17_slice_diff", """
WITH b AS (SELECT * FROM payroll WHERE organismo = 'Municipalidad de NATION_0'),
a AS (SELECT * FROM b WHERE sueldo_bruto > 100000 AND sueldo_bruto < 10000000),
l AS (SELECT count(*) AS perdidos FROM b WHERE id NOT IN (SELECT id FROM a))
SELECT 'antes' AS momento, count(*) AS n, min(sueldo_bruto) AS minimo, max(sueldo_bruto) AS maximo,
  round(avg(sueldo_bruto), 2) AS promedio, (SELECT perdidos FROM l) AS perdidos FROM b
UNION ALL SELECT 'despues', count(*), min(sueldo_bruto), max(sueldo_bruto), round(avg(sueldo_bruto), 2),
  (SELECT perdidos FROM l) FROM a""")
def val17_slice_diff(spark, sf_dir):
    p = payroll(spark, sf_dir)
    after = FL.floor_filter(FL.open_range(p))
    return rounded(Q.slice_diff(p, after, F.col("organismo") == "Municipalidad de NATION_0"), {"promedio": 2})


# --- GEN ------------------------------------------------------------------------------------
@query("gen01_sample_n", """SELECT id FROM payroll ORDER BY md5('42' || CAST(id AS VARCHAR)), id LIMIT 5000""")
def gen01_sample_n(spark, sf_dir):
    return G.sample_n(payroll(spark, sf_dir), 5000).select("id")


@query("gen02_stratified_sample", """
WITH s AS (SELECT count(*) AS n, count(DISTINCT organismo) AS b FROM payroll),
c AS (SELECT p.*, CASE WHEN contains(lower(organismo), 'ministerio') OR contains(lower(organismo), 'servicio')
        THEN greatest(3, 5000 // b) * 3 ELSE greatest(3, 5000 // b) END AS cap FROM payroll p, s),
r AS (SELECT *, row_number() OVER (PARTITION BY organismo ORDER BY md5('42' || CAST(id AS VARCHAR)), id) AS rk FROM c)
SELECT organismo, count(*) AS n FROM r WHERE rk <= cap GROUP BY organismo""")
def gen02_stratified_sample(spark, sf_dir):
    s = G.stratified_sample(payroll(spark, sf_dir), 5000)
    return s.groupBy("organismo").agg(F.count(F.lit(1)).alias("n"))


@query("gen03_assign_from_catalogue", f"""
WITH cat AS (SELECT 'Municipalidad de ' || n_name AS nombre,
  row_number() OVER (ORDER BY 'Municipalidad de ' || n_name) - 1 AS i FROM nation),
gen AS (SELECT id, CASE WHEN fuente = 'F' AND {CAT11} = 'Otros' THEN 'Municipalidad' ELSE organismo END AS organismo
  FROM payroll)
SELECT g.id, CASE WHEN g.organismo = 'Municipalidad' THEN c.nombre ELSE g.organismo END AS organismo,
  g.organismo = 'Municipalidad' AS organismo_imputado
FROM gen g LEFT JOIN cat c ON g.organismo = 'Municipalidad'
  AND c.i = ('0x' || substr(md5(CAST(g.id AS VARCHAR)), 1, 8))::UBIGINT % 25""")
def gen03_assign_from_catalogue(spark, sf_dir):
    p = categorised(spark, sf_dir)
    gen = p.select("id", F.when((F.col("fuente") == "F") & (F.col("categoria_organismo") == "Otros"),
                                F.lit("Municipalidad")).otherwise(F.col("organismo")).alias("organismo"))
    cat = table(spark, sf_dir, "nation").select(F.concat(F.lit("Municipalidad de "), "n_name").alias("nombre"))
    return G.assign_from_catalogue(gen, cat, "nombre").select("id", "organismo", "organismo_imputado")


@query("gen04_synth_payroll")
def gen04_synth_payroll(spark, sf_dir):
    """Rows-only, opt-in synthetic data: people per (class, grade) scale row of the payroll."""
    classes = list(G.CLASS_RULES)
    p = payroll(spark, sf_dir)
    klass = F.element_at(F.array(*[F.lit(c) for c in classes]),
                         (F.pmod(F.col("grado").cast("int"), F.lit(len(classes))) + 1).cast("int"))
    scale = p.groupBy("grado").agg(F.bround(F.avg(SAL), 0).alias("sueldo_base")).withColumn("estamento", klass)
    return G.synth_payroll(scale, p.select("organismo"))


# --- MAP ------------------------------------------------------------------------------------
@query("map02_normalize", _raw(f"""
SELECT {S.clean_text('"Institución"')} AS organismo, {S.clean_text('"Nombres"')} AS nombre,
  {S.clean_text('"Cargo o función"')} AS cargo, {S.clean_text('"Grado EUS"')} AS grado,
  {S.clean_text('"Estamento"')} AS estamento, {S.money_auto(REM)} AS sueldo_bruto, 'orders' AS fuente
FROM raw_staff"""))
def map02_normalize(spark, sf_dir):
    out = MP.normalize(raw_staff(spark, sf_dir), "orders", file_name="orders.parquet", as_of="2025-09-30")
    return out.drop("archivo_origen", "fecha_procesamiento")


@query("map05_first_valid_salary", _raw(f"""
SELECT * FROM (SELECT "Institución" AS organismo, trim("Nombres") AS nombre, trim("Cargo o función") AS cargo,
  trim("Grado EUS") AS estamento,
  coalesce(CASE WHEN {S.money_extractor(REM)} > 100000 THEN {S.money_extractor(REM)} END,
           CASE WHEN {S.money_extractor(HON)} > 100000 THEN {S.money_extractor(HON)} END) AS sueldo_bruto
  FROM raw_staff) WHERE sueldo_bruto IS NOT NULL"""))
def map05_first_valid_salary(spark, sf_dir):
    raw = raw_staff(spark, sf_dir).withColumnRenamed("Institución", "Organismo")
    return MP.extract_rows(raw, threshold=100_000, dialect="extractor").select(
        "organismo", "nombre", "cargo", "estamento", SAL)


@query("map07_last_role_value", _raw("""
SELECT id, coalesce("Estamento", "Grado EUS") AS estamento FROM raw_staff"""))
def map07_last_role_value(spark, sf_dir):
    raw = raw_staff(spark, sf_dir)
    roles = MP.role_columns(raw.columns, exclusive=False)
    return raw.select("id", MP.last_role_value(roles["estamento"]).alias("estamento"))


@query("map08_rename_map", _raw(f"""
SELECT id, "Nombres" AS nombre, "Cargo o función" AS cargo, {HON} AS sueldo FROM raw_staff"""))
def map08_rename_map(spark, sf_dir):
    m = {"Nombres": "nombre", "Cargo o función": "cargo", "Remuneración bruta mensualizada": "sueldo",
         "Honorario bruto mensual": "sueldo"}
    return MP.rename_map(raw_staff(spark, sf_dir), m).select("id", "nombre", "cargo", "sueldo")


@query("map11_full_name", _raw("""
SELECT id, trim(concat_ws(' ', coalesce("Nombres", ''), coalesce("Apellido Paterno", ''),
  coalesce("Apellido Materno", ''))) AS nombre FROM raw_staff"""))
def map11_full_name(spark, sf_dir):
    return raw_staff(spark, sf_dir).select("id", MP.full_name("Nombres", "Apellido Paterno", "Apellido Materno")
                                           .alias("nombre"))


@query("map13_salary_by_priority", _raw(f"""
SELECT id, coalesce({S.money_cl(REM)}, {S.money_cl(HON)}) AS sueldo_bruto FROM raw_staff"""))
def map13_salary_by_priority(spark, sf_dir):
    raw = raw_staff(spark, sf_dir)
    pri = ["Remuneración bruta mensualizada", "Honorario bruto mensual", "Pago Mensual"]
    return raw.select("id", MP.salary_by_priority(raw, pri, "cl", row_level=True).alias(SAL))


@query("map14_salary_by_name_or_last", _raw(f"""SELECT id, {S.money_auto(REM)} AS sueldo_bruto FROM raw_staff"""))
def map14_salary_by_name_or_last(spark, sf_dir):
    raw = raw_staff(spark, sf_dir)
    return raw.select("id", MP.salary_by_name_or_last(raw, "remuneración bruta mensualizada").alias(SAL))


@query("map15_scale_to_payroll", """
SELECT 'Servicio de NATION' AS organismo, NULL::VARCHAR AS nombre, estamento || ' Grado ' || grado AS cargo, grado,
  estamento, sueldo AS sueldo_bruto, 'escala' AS fuente FROM (
  SELECT estamento, grado, max(sueldo_bruto) AS sueldo FROM payroll GROUP BY 1, 2) WHERE sueldo > 100000""")
def map15_scale_to_payroll(spark, sf_dir):
    scale = payroll(spark, sf_dir).groupBy("estamento", "grado").agg(F.max(SAL).alias("sueldo"))
    return MP.scale_to_payroll(scale, "Servicio de NATION", "escala")


@query("map16_source_union", """
SELECT id, organismo, sueldo_bruto, 'planta' AS tipo, 'sii' AS origen FROM payroll WHERE fuente = 'F'
UNION ALL SELECT id, organismo, sueldo_bruto, 'contrata', 'dipres' FROM payroll WHERE fuente = 'O'
UNION ALL SELECT id, organismo, sueldo_bruto, 'honorarios', 'contraloria' FROM payroll WHERE fuente = 'P'""")
def map16_source_union(spark, sf_dir):
    p = payroll(spark, sf_dir).select("id", "organismo", SAL, "fuente")
    parts = [(p.where(F.col("fuente") == f).drop("fuente"), {"tipo": t, "origen": o})
             for f, t, o in [("F", "planta", "sii"), ("O", "contrata", "dipres"), ("P", "honorarios", "contraloria")]]
    return MP.source_union(parts)


@query("map17_fallback_literals", """
SELECT id, CASE WHEN fuente = 'P' THEN 'consolidado' ELSE fuente END AS fuente,
  'orders_' || periodo || '.csv' AS archivo_origen FROM payroll""")
def map17_fallback_literals(spark, sf_dir):
    p = payroll(spark, sf_dir)
    df = p.select("id", F.when(F.col("fuente") != "P", F.col("fuente")).alias("fuente"),
                  F.lit(None).cast("string").alias("archivo_origen"),
                  F.concat(F.lit("https://datos.example.cl/"), F.lit("orders_"), F.col("periodo"),
                           F.lit(".csv")).alias("url_origen"))
    return MP.fallback_literals(df).select("id", "fuente", "archivo_origen")

