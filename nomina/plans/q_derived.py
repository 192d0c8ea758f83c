"""Registered queries over payroll and document rows with derived values, chosen so that every
rule has several outcomes.  The oracles state the expected values; they share no list or
pattern with the library."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from nomina.functions import categorize as C
from nomina.functions.geo import city_from_text
from nomina.operators import joins as J
from nomina.operators import quality as Q
from nomina.operators import sampling as G
from nomina.operators import stats as ST
from nomina.plans import pipelines as P
from nomina.plans.common import payroll, rounded, table
from nomina.plans.registry import query
from nomina.session import scratch_path
from nomina.sources import documents as D
from nomina.sources import files as FS
from nomina.sources import sinks as SK

# post, the municipality it suggests, the class it implies
POSTS = [
    ("Profesor LICEO SAN FELIPE", "Municipalidad de San Felipe", "Auxiliar"),
    ("Director Escuela Angol", "Municipalidad de Angol", "Directivo"),
    ("Asistente social en Valparaiso", "Municipalidad de Valparaíso", "Administrativo"),
    ("Analista", None, "Técnico"),
    ("Ingeniero de Talcahuano", "Municipalidad de Talca", "Profesional"),
    ("Inspector Viña del Mar", None, "Auxiliar"),
    (None, None, "Sin especificar"),
    ("ALCALDE (S) DE CONCEPCION y Santiago", "Municipalidad de Concepción", "Directivo"),
]
BODIES = ["Municipalidad de San Felipe", "Municipalidad de Talca", "Servicio de Salud", "municipalidad de angol", None]


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v + "'" for v in values) + "]"


POSTS_SQL = f"""
posts AS (SELECT id, {_sql_list(p for p, _, _ in POSTS)}[id % 8 + 1] AS cargo, {_sql_list(BODIES)}[id % 5 + 1] AS organismo,
            {_sql_list(m for _, m, _ in POSTS)}[id % 8 + 1] AS ciudad, {_sql_list(c for _, _, c in POSTS)}[id % 8 + 1] AS clase FROM payroll),
geo AS (SELECT *, coalesce(lower(organismo) LIKE '%municipalidad%', false) AS municipal,
          CASE WHEN lower(organismo) LIKE '%municipalidad%' THEN ciudad END AS sug FROM posts),
val AS (SELECT *, coalesce(sug IS NOT NULL AND lower(sug) <> lower(organismo), false) AS malo FROM geo)"""


def _posts(spark, sf_dir):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("id") % n + 1).cast("int"))
    return payroll(spark, sf_dir).select("id", pick([p for p, _, _ in POSTS], 8).alias("cargo"), pick(BODIES, 5).alias("organismo"))


@query("scl23_city_from_posts", f"WITH {POSTS_SQL} SELECT id, ciudad AS municipio_sugerido FROM posts")
def scl23_city_from_posts(spark, sf_dir):
    return _posts(spark, sf_dir).select("id", city_from_text("cargo").alias("municipio_sugerido"))


@query("scl14_class_from_posts", f"WITH {POSTS_SQL} SELECT id, clase AS estamento FROM posts")
def scl14_class_from_posts(spark, sf_dir):
    return _posts(spark, sf_dir).select("id", C.infer_class("cargo").alias("estamento"))


@query("val04_geo_mismatch_posts", f"""WITH {POSTS_SQL}
SELECT id, NOT malo AS validation_is_valid, sug AS suggested_municipality, CASE WHEN sug IS NULL THEN 0.0 ELSE 0.8 END AS validation_confidence,
  CASE WHEN malo THEN 'Institución ''' || cargo || ''' sugiere ''' || sug || ''' pero está asignada a ''' || organismo || '''' END AS mensaje FROM val""")
def val04_geo_mismatch_posts(spark, sf_dir):
    return Q.geo_validate(_posts(spark, sf_dir)).select(
        "id", F.coalesce("validation_is_valid", F.lit(True)).alias("validation_is_valid"), "suggested_municipality", "validation_confidence",
        F.try_element_at("validation_issues", F.lit(1)).getField("message").alias("mensaje"))


GEO_REPORT = """SELECT count(*) AS total_registros, count_if(municipal) AS registros_municipales, count_if(malo) AS registros_invalidos,
  round((count_if(municipal) - count_if(malo)) * 100.0 / count_if(municipal), 4) AS tasa_validez FROM val"""


@query("val05_geo_report_posts", f"WITH {POSTS_SQL} {GEO_REPORT}")
def val05_geo_report_posts(spark, sf_dir):
    return rounded(Q.geo_report(Q.geo_validate(_posts(spark, sf_dir))), {"tasa_validez": 4})


@query("val06_geo_fix_posts", f"""WITH {POSTS_SQL} SELECT id, CASE WHEN malo THEN sug ELSE organismo END AS organismo FROM val""")
def val06_geo_fix_posts(spark, sf_dir):
    return Q.geo_fix(Q.geo_validate(_posts(spark, sf_dir)), apply=True).select("id", "organismo")


@query("val06_geo_dry_run", f"""WITH {POSTS_SQL} SELECT organismo AS actual, sug AS sugerido, cargo, count(*) AS n FROM val WHERE malo GROUP BY ALL""")
def val06_geo_dry_run(spark, sf_dir):
    dry = Q.geo_fix(Q.geo_validate(_posts(spark, sf_dir)), apply=False)
    return dry.groupBy("actual", "sugerido", "cargo").agg(F.count(F.lit(1)).alias("n"))


@query("pip06_geo_repair_posts", f"""WITH {POSTS_SQL}, f AS (SELECT CASE WHEN malo THEN sug ELSE organismo END AS organismo FROM val),
r AS ({GEO_REPORT})
SELECT organismo, count(*) AS n, any_value(total_registros) AS total_registros, any_value(registros_invalidos) AS registros_invalidos FROM f, r GROUP BY organismo""")
def pip06_geo_repair_posts(spark, sf_dir):
    """Report and repaired rows of one run."""
    report, fixed = P.geo_repair(_posts(spark, sf_dir))
    one = report.select("total_registros", "registros_invalidos").first()  # a row
    return fixed.groupBy("organismo").agg(F.count(F.lit(1)).alias("n")).withColumns({c: F.lit(one[c]) for c in ("total_registros", "registros_invalidos")})


# --- outliers: one salary in fifty is multiplied ------------------------------------------
WIDE_SQL = "wide AS (SELECT id, CASE WHEN id % 50 = 7 THEN sueldo_bruto * 40 ELSE sueldo_bruto END AS sueldo_bruto FROM payroll)"


def _wide(spark, sf_dir):
    far = F.when(F.col("id") % 50 == 7, F.col("sueldo_bruto") * 40).otherwise(F.col("sueldo_bruto"))
    return payroll(spark, sf_dir).select("id", far.alias("sueldo_bruto"))


@query("sta09_outliers_iqr_wide", f"""WITH {WIDE_SQL},
q AS (SELECT quantile_cont(sueldo_bruto, 0.25) AS q1, quantile_cont(sueldo_bruto, 0.75) AS q3 FROM wide)
SELECT round(q1, 2) AS q1, round(q3, 2) AS q3, round(q3 - q1, 2) AS iqr, round(q1 - 1.5 * (q3 - q1), 2) AS limite_inferior, round(q3 + 1.5 * (q3 - q1), 2) AS limite_superior,
  count_if(sueldo_bruto < q1 - 1.5 * (q3 - q1) OR sueldo_bruto > q3 + 1.5 * (q3 - q1)) AS outliers, count(*) AS n,
  round(count_if(sueldo_bruto < q1 - 1.5 * (q3 - q1) OR sueldo_bruto > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*), 4) AS pct
FROM wide, q WHERE sueldo_bruto IS NOT NULL GROUP BY q1, q3""")
def sta09_outliers_iqr_wide(spark, sf_dir):
    return rounded(ST.outlier_summary_iqr(_wide(spark, sf_dir)), {"q1": 2, "q3": 2, "iqr": 2, "limite_inferior": 2, "limite_superior": 2, "pct": 4})


@query("sta10_outliers_z_wide", f"""WITH {WIDE_SQL}, s AS (SELECT avg(sueldo_bruto) AS mu, stddev_pop(sueldo_bruto) AS sd FROM wide)
SELECT round(mu, 2) AS media, round(sd, 2) AS sigma, count_if(abs(sueldo_bruto - mu) / sd > 3) AS outliers, count(*) AS n,
  round(count_if(abs(sueldo_bruto - mu) / sd > 3) * 100.0 / count(*), 4) AS pct FROM wide, s WHERE sueldo_bruto IS NOT NULL GROUP BY mu, sd""")
def sta10_outliers_z_wide(spark, sf_dir):
    return rounded(ST.outlier_summary_z(_wide(spark, sf_dir)), {"media": 2, "sigma": 2, "pct": 4})


@query("sta09_outlier_rows_wide", f"""WITH {WIDE_SQL},
q AS (SELECT quantile_cont(sueldo_bruto, 0.25) AS q1, quantile_cont(sueldo_bruto, 0.75) AS q3 FROM wide)
SELECT id, sueldo_bruto FROM wide, q WHERE sueldo_bruto < q1 - 1.5 * (q3 - q1) OR sueldo_bruto > q3 + 1.5 * (q3 - q1)""")
def sta09_outlier_rows_wide(spark, sf_dir):
    return ST.outliers_iqr(_wide(spark, sf_dir)).select("id", "sueldo_bruto")


# --- samples, by the ids chosen ------------------------------------------------------------
def _cap_sql(source: str, target: int, big: str | None = None) -> str:
    case = f"WHEN organismo = '{big}' THEN {target} // 2 " if big else ""
    return f"""
s AS (SELECT count(*) AS n, count(DISTINCT organismo) AS b FROM {source}),
c AS (SELECT {source}.*, CASE {case}WHEN contains(lower(organismo), 'ministerio') OR contains(lower(organismo), 'servicio')
        THEN greatest(3, {target} // b) * 3 ELSE greatest(3, {target} // b) END AS cap, n FROM {source}, s),
r AS (SELECT *, row_number() OVER (PARTITION BY organismo ORDER BY md5('42' || CAST(id AS VARCHAR)), id) AS rk FROM c)"""


@query("gen02_sample_ids", f"""WITH {_cap_sql('payroll', 1200)} SELECT id, organismo FROM r WHERE n <= 1200 OR rk <= cap""")
def gen02_sample_ids(spark, sf_dir):
    return G.stratified_sample(payroll(spark, sf_dir), 1200).select("id", "organismo")


@query("pip05_sample_ids_big_body", f"""WITH k AS (SELECT * FROM payroll WHERE sueldo_bruto >= 200000), {_cap_sql('k', 1000, 'Municipalidad de ALGERIA')}
SELECT id, organismo, rk IS NULL AS sobra FROM r WHERE n <= 1000 OR rk <= cap""")
def pip05_sample_ids_big_body(spark, sf_dir):
    """The largest body may fill half the sample."""
    _kept, _problems, sample = P.categorise_filter_sample(payroll(spark, sf_dir), target=1000, big_body="Municipalidad de ALGERIA")
    return sample.select("id", "organismo", F.lit(False).alias("sobra"))


@query("pip05_problems", """SELECT id, sueldo_bruto FROM payroll WHERE sueldo_bruto < 200000""")
def pip05_problems(spark, sf_dir):
    """The rows that the floor takes out (a missing salary is neither kept nor a problem)."""
    _kept, problems, _sample = P.categorise_filter_sample(payroll(spark, sf_dir))
    return problems.select("id", "sueldo_bruto")


# --- lookups, audits, manifests, records ----------------------------------------------------
@query("joi05_repeated_urls", """
WITH l AS (SELECT id AS orden, 'https://e.cl/' || id % 97 AS url, organismo FROM payroll),
f AS (SELECT url, arg_min(organismo, orden) AS organismo FROM l GROUP BY url)
SELECT event_id, f.url, f.organismo FROM events JOIN f ON 'https://e.cl/' || event_id % 101 = f.url""")
def joi05_repeated_urls(spark, sf_dir):
    """A link list that names every url many times: the first body counts."""
    links = payroll(spark, sf_dir).select(F.col("id").alias("orden"), F.concat(F.lit("https://e.cl/"), F.col("id") % 97).alias("url"), "organismo")
    results = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("https://e.cl/"), F.col("event_id") % 101).alias("url"))
    return J.url_lookup(results, links).select("event_id", "url", "organismo")


@query("val14_official_origins", """
WITH p AS (SELECT fuente, CASE WHEN id % 9 = 0 THEN NULL WHEN id % 9 = 1 THEN 'Sin especificar' ELSE nombre END AS nombre,
  CASE WHEN id % 4 = 0 THEN 'https://datos.gob.cl/' || id % 12 WHEN id % 4 = 1 THEN NULL ELSE 'otro_' || id END AS origen FROM payroll)
SELECT fuente, count(*) AS n, count_if(nombre IS NOT NULL AND nombre <> 'Sin especificar') AS con_nombre,
  count(DISTINCT CASE WHEN origen LIKE 'https://datos.gob.cl/%' THEN origen END) AS urls_oficiales,
  round(count_if(nombre IS NOT NULL AND nombre <> 'Sin especificar') * 100.0 / count(*), 4) AS pct_con_nombre FROM p GROUP BY fuente""")
def val14_official_origins(spark, sf_dir):
    i = F.col("id")
    p = payroll(spark, sf_dir).select(
        "fuente", F.when(i % 9 == 0, None).when(i % 9 == 1, "Sin especificar").otherwise(F.col("nombre")).alias("nombre"),
        F.when(i % 4 == 0, F.concat(F.lit("https://datos.gob.cl/"), i % 12)).when(i % 4 == 1, None).otherwise(F.concat(F.lit("otro_"), i)).alias("archivo_origen"))
    return rounded(Q.source_audit(p), {"pct_con_nombre": 4})


MANIFEST_SQL = """
prev AS (SELECT doc_id AS clave, sha256(coalesce(text, '')) AS sha256 FROM documents WHERE doc_id % 3 > 0),
cur AS (SELECT doc_id AS clave, sha256(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END) AS sha256 FROM documents WHERE doc_id % 7 > 0)"""


def _manifests(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = F.concat(F.lit("raw/"), F.col("doc_id"), F.lit(".txt"))
    previous = D.content_manifest(docs.where("doc_id % 3 > 0"), "doc_id", "text", path)
    fetched = docs.where("doc_id % 7 > 0").withColumn("text", F.concat("text", F.when(F.col("doc_id") % 5 == 0, "!").otherwise("")))
    return previous, D.content_manifest(fetched, "doc_id", "text", path)


@query("src20_manifest_changes", f"""WITH {MANIFEST_SQL}
SELECT clave, CASE WHEN p.sha256 IS NULL THEN 'NEW' WHEN p.sha256 <> c.sha256 THEN 'CHANGED' ELSE 'SAME' END AS estado
FROM cur AS c LEFT JOIN prev AS p USING (clave)""", payroll=False)
def src20_manifest_changes(spark, sf_dir):
    previous, current = _manifests(spark, sf_dir)
    return D.classify_against_manifest(current, previous).select("clave", "estado")


@query("src20_manifest_upsert", f"""WITH {MANIFEST_SQL}
SELECT coalesce(c.clave, p.clave) AS clave, coalesce(c.sha256, p.sha256) AS sha256 FROM prev AS p FULL JOIN cur AS c ON c.clave = p.clave""", payroll=False)
def src20_manifest_upsert(spark, sf_dir):
    """The stored manifest after the fetch: entries not fetched again stay."""
    previous, current = _manifests(spark, sf_dir)
    return D.upsert_manifest(previous, D.classify_against_manifest(current, previous)).select("clave", "sha256")


@query("src08_json_record_arrays", """SELECT organismo, nombre, sueldo_bruto AS sueldo FROM payroll WHERE nombre IS NOT NULL""")
def src08_json_record_arrays(spark, sf_dir):
    """One document a body and month, ``{"result": {"records": [...]}}``, back to rows."""
    p = payroll(spark, sf_dir).where("nombre is not null")
    records = F.collect_list(F.struct("nombre", F.col("sueldo_bruto").alias("sueldo")))
    docs = p.groupBy("organismo", "periodo").agg(F.to_json(F.struct(F.struct(records.alias("records")).alias("result"))).alias("doc"))
    schema = StructType([StructField("nombre", StringType()), StructField("sueldo", DoubleType())])
    return D.json_records(docs, "doc", schema, keep=("organismo",))


@query("src07_provenance_fields", """SELECT id, fuente, periodo, fuente || '/' || periodo AS directorio, TIMESTAMP '2025-09-30 00:00:00' AS fecha_procesamiento FROM payroll""")
def src07_provenance_fields(spark, sf_dir):
    """Lineage columns that do not name the run: source, period, folder and time."""
    root = scratch_path(spark, f"raw-fields-{uuid.uuid4().hex[:12]}")
    rows = payroll(spark, sf_dir).select("id", "fuente", "periodo")
    rows.hint("rebalance", "fuente", "periodo").write.partitionBy("fuente", "periodo").options(**FS.CSV_FORMAT).option("header", True).csv(root)
    df = FS.month_dir_scan(spark, root, as_of="2025-09-30 00:00:00")
    parts = F.regexp_replace(F.regexp_extract("directorio_fuente", r"/(fuente=[^/]+/periodo=[^/]+)$", 1), "(fuente|periodo)=", "")
    return df.select(F.col("id").cast("long").alias("id"), "fuente", "periodo", parts.alias("directorio"), F.col("fecha_procesamiento").cast("timestamp_ntz").alias("fecha_procesamiento"))


@query("src17_load_log_rows", """
WITH l AS (SELECT 1 AS carga, * FROM payroll UNION ALL SELECT 2, * FROM payroll WHERE sueldo_bruto > 3000000)
SELECT carga, count(*) AS total_registros, count(DISTINCT organismo) AS organismos_unicos, count(DISTINCT estamento) AS estamentos_unicos,
  count(DISTINCT grado) AS grados_unicos, count(DISTINCT fuente) AS fuentes_unicas, round(avg(sueldo_bruto), 4) AS promedio_sueldo,
  round(quantile_cont(sueldo_bruto, 0.5), 4) AS mediana_sueldo, min(sueldo_bruto) AS min_sueldo, max(sueldo_bruto) AS max_sueldo,
  round(stddev_samp(sueldo_bruto), 2) AS desv_std, 'orders' AS archivo_origen FROM l GROUP BY carga""")
def src17_load_log_rows(spark, sf_dir):
    """Two loads, two rows of the load log with all their statistics."""
    path, p = scratch_path(spark, f"log-{uuid.uuid4().hex[:12]}"), payroll(spark, sf_dir)
    SK.metadata_append(SK.load_stats(p, "2025-09-30 00:00:00", "orders"), path)
    SK.metadata_append(SK.load_stats(p.where("sueldo_bruto > 3000000"), "2025-10-31 00:00:00", "orders"), path)
    log = spark.read.parquet(path).withColumn("carga", F.when(F.month("fecha_carga") == 9, 1).otherwise(2))
    return rounded(log.drop("fecha_carga"), {"promedio_sueldo": 4, "mediana_sueldo": 4, "desv_std": 2})
