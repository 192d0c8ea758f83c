"""Dedicated queries for the mapping steps that the pipelines compose (MAP-01/03/04/06/09/10/12)
and descriptive message text (SCL-30).  All read the raw staff table derived from the payroll."""

from __future__ import annotations

from pyspark.sql import functions as F

from nomina.operators import mapping as MP
from nomina.plans import sqltext as S
from nomina.plans.common import payroll
from nomina.plans.q_quality import HON, _raw, raw_staff
from nomina.plans.registry import query


@query("map01_find_column", _raw("""
SELECT id, "Institución" AS organismo, "Nombres" AS nombre, "Cargo o función" AS cargo, "Grado EUS" AS grado,
  "Estamento" AS estamento, "Remuneración bruta mensualizada" AS sueldo FROM raw_staff"""))
def map01_find_column(spark, sf_dir):
    """Keyword column choice per canonical field (first keyword, then column order), applied as-is."""
    raw = raw_staff(spark, sf_dir)
    picks = {f: MP.find_column(raw.columns, kw) for f, kw in MP.FIELD_KEYWORDS.items()}
    return raw.select("id", *[F.col(f"`{picks[f]}`").alias(f) for f in MP.CANONICAL if f != MP.SAL],
                      F.col(f"`{picks[MP.SAL]}`").alias("sueldo"))


@query("map03_06_exclusive_roles", _raw("""
SELECT id, trim("Nombres") AS nombre, trim("Cargo o función") AS cargo, trim("Grado EUS") AS estamento
FROM raw_staff"""))
def map03_06_exclusive_roles(spark, sf_dir):
    """Exclusive roles (a column takes its first matching role); first column of each role, trimmed."""
    raw = raw_staff(spark, sf_dir)
    roles = MP.role_columns(raw.columns, exclusive=True)
    return raw.select("id", MP.first_role_value(roles["nombre"]).alias("nombre"),
                      MP.first_role_value(roles["cargo"]).alias("cargo"),
                      MP.first_role_value(roles["estamento"]).alias("estamento"))


@query("map04_overlapping_roles", _raw(f"""
SELECT * FROM (SELECT id, trim("Nombres") AS nombre,
  CASE WHEN {S.money_cl(HON)} > 10000 THEN {S.money_cl(HON)} END AS sueldo_bruto
  FROM raw_staff) WHERE sueldo_bruto IS NOT NULL"""))
def map04_overlapping_roles(spark, sf_dir):
    """Overlapping roles; first salary column above 10,000 with the Chilean dialect.

    Keywords match literally: 'Remuneración bruta ...' has neither 'remuneracion'
    (accent) nor 'bruto' (gender), so only the fee column takes the salary role.
    """
    raw = raw_staff(spark, sf_dir)
    roles = MP.role_columns(raw.columns, exclusive=False)
    out = raw.select("id", MP.first_role_value(roles["nombre"]).alias("nombre"),
                     MP.first_valid_salary(roles["sueldo"], 10_000, "cl").alias(MP.SAL))
    return out.where(F.col(MP.SAL).isNotNull())


@query("map09_10_12_union_project_tag", _raw("""
SELECT id, "Remuneración bruta mensualizada" AS remuneracion, NULL::VARCHAR AS honorario, anio, 'planta' AS tipo
FROM raw_staff WHERE "Remuneración bruta mensualizada" IS NOT NULL
UNION ALL
SELECT id, NULL::VARCHAR, "Honorario bruto mensual", anio, 'honorarios' FROM raw_staff
WHERE "Honorario bruto mensual" IS NOT NULL"""))
def map09_10_12_union_project_tag(spark, sf_dir):
    """Two differently-shaped inputs: project the common wanted columns, tag each with its
    type literal, union by name (missing columns become null)."""
    raw = raw_staff(spark, sf_dir)
    staff = MP.project_common(raw.where(F.col("Remuneración bruta mensualizada").isNotNull())
                              .withColumnRenamed("Remuneración bruta mensualizada", "remuneracion"),
                              ["id", "remuneracion", "anio", "no_existe"])
    fees = MP.project_common(raw.where(F.col("Honorario bruto mensual").isNotNull())
                             .withColumnRenamed("Honorario bruto mensual", "honorario"),
                             ["id", "honorario", "anio"])
    u = MP.union_by_name(MP.tag_literals(staff, tipo="planta"), MP.tag_literals(fees, tipo="honorarios"))
    return u.select("id", "remuneracion", "honorario", "anio", "tipo")


@query("scl30_text_concat", """
SELECT organismo, printf('%s: %d registros, %d con sueldo', organismo, count(*), count(sueldo_bruto)) AS mensaje
FROM payroll GROUP BY organismo""")
def scl30_text_concat(spark, sf_dir):
    g = payroll(spark, sf_dir).groupBy("organismo").agg(F.count(F.lit(1)).alias("n"),
                                                         F.count("sueldo_bruto").alias("c"))
    return g.select("organismo", F.format_string("%s: %d registros, %d con sueldo", "organismo", "n", "c")
                    .alias("mensaje"))
