"""Registered source / sink / HTML / JSON / manifest queries (SRC-*, SCL-18..25)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from nomina.functions import money as M
from nomina.functions import text as T
from nomina.functions import urls as U
from nomina.functions.categorize import file_kind
from nomina.operators import setops as SE
from nomina.plans import sqltext as S
from nomina.plans.common import payroll, table
from nomina.plans.registry import query
from nomina.session import scratch_path
from nomina.sources import documents as D
from nomina.sources import files as FS
from nomina.sources import html as H
from nomina.sources import sinks as SK


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _payroll_rows(spark, sf_dir):
    return payroll(spark, sf_dir).select("id", "organismo", "estamento", "fuente", "periodo", "sueldo_texto")


# --- SQL mirrors of the HTML helpers -----------------------------------------------------
# Patterns of their own, which hold for the driver's pages; the library reads tokens instead.
ANCHOR = '<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
ROOT = "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"
FOLDER = "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/(?:[^?#]*/)?)"


def _sql_resolve(base: str, href: str) -> str:
    h = f"trim({href})"
    scheme = f"regexp_extract({base}, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)"
    root = f"regexp_extract({base}, '{ROOT}', 1)"
    dirp = f"regexp_extract({base}, '{FOLDER}', 1)"
    return (f"CASE WHEN regexp_matches({h}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {h} "
            f"WHEN starts_with({h}, '//') THEN {scheme} || ':' || {h} "
            f"WHEN starts_with({h}, '/') THEN {root} || {h} "
            f"WHEN {h} = '' THEN {base} "
            f"WHEN starts_with({h}, '#') OR starts_with({h}, '?') THEN regexp_replace({base}, '[?#].*$', '') || {h} "
            f"WHEN {dirp} = '' THEN {root} || '/' || {h} ELSE {dirp} || {h} END")


LINKS_SQL = f"""
links AS (
  SELECT page_id, CAST(i - 1 AS INTEGER) AS posicion, {_sql_resolve('url', 'hrefs[i]')} AS url,
    trim(regexp_replace(raws[i], '<[^>]+>', '', 'g')) AS texto
  FROM (SELECT page_id, url, regexp_extract_all(html, '{ANCHOR}', 1) AS hrefs,
               regexp_extract_all(html, '{ANCHOR}', 2) AS raws FROM pages) p,
       LATERAL (SELECT unnest(generate_series(1, len(hrefs))) AS i))"""


def _links(spark, sf_dir):
    return H.html_links(table(spark, sf_dir, "pages"))


# --- file sources and sinks ---------------------------------------------------------------
@query("src01_csv_scan", f"""
SELECT organismo, count(*) AS n, round(sum({S.money_auto('sueldo_texto')}), 2) AS total
FROM payroll GROUP BY organismo""")
def src01_csv_scan(spark, sf_dir):
    path = _scratch(spark, "csv")
    _payroll_rows(spark, sf_dir).write.option("header", True).csv(path)
    df = FS.csv_scan(spark, path)
    return df.groupBy("organismo").agg(F.count(F.lit(1)).alias("n"),
                                       F.round(F.sum(M.money_auto("sueldo_texto")), 2).alias("total"))


@query("src02_csv_dialect", f"""
SELECT estamento, count(*) AS n, round(sum({S.money_auto('sueldo_texto')}), 2) AS total
FROM payroll GROUP BY estamento""")
def src02_csv_dialect(spark, sf_dir):
    path = _scratch(spark, "csv-latin1")
    (_payroll_rows(spark, sf_dir).write.option("header", True).option("sep", ";")
     .option("encoding", FS.LATIN1).csv(path))
    df = FS.csv_dialect_scan(spark, path)
    return df.groupBy("estamento").agg(F.count(F.lit(1)).alias("n"),
                                       F.round(F.sum(M.money_auto("sueldo_texto")), 2).alias("total"))


@query("src03_parquet_roundtrip", """
SELECT fuente, periodo, count(*) AS n FROM payroll GROUP BY fuente, periodo""")
def src03_parquet_roundtrip(spark, sf_dir):
    path = _scratch(spark, "parquet")
    _payroll_rows(spark, sf_dir).write.partitionBy("fuente").parquet(path)
    return FS.parquet_scan(spark, path).groupBy("fuente", "periodo").agg(F.count(F.lit(1)).alias("n"))


@query("src04_first_available", """SELECT estamento, count(*) AS n FROM payroll GROUP BY estamento""")
def src04_first_available(spark, sf_dir):
    base = _scratch(spark, "first")
    _payroll_rows(spark, sf_dir).limit(0).write.parquet(f"{base}/vacio.parquet")
    _payroll_rows(spark, sf_dir).write.parquet(f"{base}/datos.parquet")
    df = FS.first_available(spark, [f"{base}/no_existe.parquet", f"{base}/vacio.parquet",
                                    f"{base}/datos.parquet"])
    return df.groupBy("estamento").agg(F.count(F.lit(1)).alias("n"))


@query("src05_load_many", """SELECT fuente, count(*) AS n FROM payroll GROUP BY fuente""")
def src05_load_many(spark, sf_dir):
    base = _scratch(spark, "many")
    p = _payroll_rows(spark, sf_dir)
    p.where(F.col("fuente") == "F").write.option("header", True).csv(f"{base}/a.csv")
    p.where(F.col("fuente") != "F").drop("estamento").write.parquet(f"{base}/b.parquet")
    df = FS.load_many(spark, [f"{base}/a.csv", f"{base}/falta.csv", f"{base}/b.parquet"])
    return df.groupBy("fuente").agg(F.count(F.lit(1)).alias("n"))


@query("src06_month_dir_scan", """
SELECT fuente, periodo, count(*) AS n, count(DISTINCT organismo) AS organismos FROM payroll GROUP BY 1, 2""")
def src06_month_dir_scan(spark, sf_dir):
    root = _scratch(spark, "raw")
    _payroll_rows(spark, sf_dir).hint("rebalance", "fuente", "periodo").write.partitionBy("fuente", "periodo").option("header", True).csv(root)
    df = FS.month_dir_scan(spark, root, as_of="2025-09-30 00:00:00")
    return df.groupBy("fuente", "periodo").agg(F.count(F.lit(1)).alias("n"),
                                               F.countDistinct("organismo").alias("organismos"))


#: Records of a landed file.
LANDED_RECORDS = 20_000


def _quoted(c):
    """A CSV field in quotes, with the quotes inside doubled."""
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


@query("src06_csv_quoted_landing", """
SELECT fuente, periodo, id, 'Luis "' || estamento || '", hijo' || CASE WHEN id % 3 = 0 THEN chr(10) || chr(10) || '2a línea, "x"' ELSE '' END AS nombre,
  sueldo_texto AS sueldo FROM payroll""")
def src06_csv_quoted_landing(spark, sf_dir):
    """A landing as other programs write it: doubled quotes, delimiters and line breaks inside
    quotes, empty lines before and between the records; half the files are of Latin-1 and
    semicolons."""
    root = _scratch(spark, "raw-quoted")
    semi = F.col("_k") % 2 == 1
    sep = F.when(semi, F.lit(";")).otherwise(F.lit(","))
    name = F.concat(F.lit('Luis "'), F.col("estamento"), F.lit('", hijo'), F.when(F.col("id") % 3 == 0, F.lit('\n\n2a línea, "x"')).otherwise(F.lit("")))
    p = _payroll_rows(spark, sf_dir).withColumn("_k", F.col("id").cast("long") % 2)
    record = F.concat_ws("", F.col("id").cast("string"), sep, _quoted(name), sep, F.coalesce(_quoted(F.col("sueldo_texto")), F.lit("")))
    p = p.select("fuente", "periodo", "_k", F.xxhash64("id", "organismo", "sueldo_texto").alias("_h"), record.alias("_r"))
    # as many files as the records of a directory need, whatever their ids
    sizes = p.groupBy("fuente", "periodo", "_k").agg(F.ceil(F.count(F.lit(1)) / LANDED_RECORDS).alias("_files"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("fuente", "periodo", "_k")]
    p = p.alias("p").join(sizes.alias("s"), same[0] & same[1] & same[2]).select("p.*", F.pmod("_h", "_files").alias("_c"))
    header = F.concat(F.lit("\n\n"), F.when(semi, F.lit("id;nombre;sueldo")).otherwise(F.lit("id,nombre,sueldo")))
    files = p.groupBy("fuente", "periodo", "_k", "_c").agg(F.array_join(F.collect_list("_r"), "\r\n\n").alias("_body"))  # a file a row, about LANDED_RECORDS at most
    files = files.select("fuente", "periodo", F.concat(header, F.lit("\n"), F.col("_body")).alias("value"), semi.alias("_semi"))
    for is_semi, encoding in ((False, "UTF-8"), (True, FS.LATIN1)):
        body = F.col("value") if not is_semi else F.encode("value", FS.LATIN1)
        part = files.where(F.col("_semi") == is_semi).select("fuente", "periodo", body.cast("string").alias("value"))
        part.write.mode("append").partitionBy("fuente", "periodo").option("maxRecordsPerFile", 1).text(root)
    # the sink names files .txt
    df = FS.month_dir_scan(spark, root, as_of="2025-09-30 00:00:00", pattern="*.txt")
    return df.select("fuente", "periodo", F.col("id").cast("long").alias("id"), "nombre", "sueldo")


@query("src14_csv_quotes_back", """
SELECT id, 'Luis "' || estamento || '", hijo' || CASE WHEN id % 5 = 0 THEN chr(10) || ' y más ' ELSE '' END AS nombre, periodo FROM payroll""")
def src14_csv_quotes_back(spark, sf_dir):
    """Names with quotes, delimiters, line breaks and outer spaces, written by period and read
    back from the dated files."""
    base = _scratch(spark, "sink-quoted")
    name = F.concat(F.lit('Luis "'), F.col("estamento"), F.lit('", hijo'), F.when(F.col("id") % 5 == 0, F.lit("\n y más ")).otherwise(F.lit("")))
    dated, _ = SK.write_dated_and_latest(_payroll_rows(spark, sf_dir).select("id", name.alias("nombre"), "periodo"), base)
    back = FS.csv_dialect_scan(spark, f"{dated}/*/*.csv", lambda d: d.withColumn("periodo", F.regexp_extract("_metadata.file_path", "periodo=([^/]+)/", 1)))
    return back.select(F.col("id").cast("long").alias("id"), "nombre", "periodo")


@query("src07_provenance")
def src07_provenance(spark, sf_dir):
    """Rows-only: lineage columns (file name, directory, source, period, time)."""
    root = _scratch(spark, "raw-prov")
    _payroll_rows(spark, sf_dir).hint("rebalance", "fuente", "periodo").write.partitionBy("fuente", "periodo").option("header", True).csv(root)
    df = FS.month_dir_scan(spark, root, as_of="2025-09-30 00:00:00")
    return df.select("id", "fuente", "periodo", "archivo_origen", "fecha_procesamiento")


@query("src14_csv_sink_latest", """SELECT periodo, count(*) AS n FROM payroll GROUP BY periodo""")
def src14_csv_sink_latest(spark, sf_dir):
    base = _scratch(spark, "sink")
    dated, latest = SK.write_dated_and_latest(_payroll_rows(spark, sf_dir), base)
    d = FS.csv_scan(spark, latest).groupBy("periodo").agg(F.count(F.lit(1)).alias("n"))
    return d


@query("src15_json_stats_sink")
def src15_json_stats_sink(spark, sf_dir):
    """Rows-only: statistics document written as JSON and read back."""
    from nomina.operators.aggregates import statistics_doc
    from nomina.plans.common import categorised
    path = _scratch(spark, "stats-json")
    SK.write_json_doc(statistics_doc(categorised(spark, sf_dir)), path)
    return spark.read.json(path)


@query("src16_table_load_replace", """SELECT count(*) AS n, count(sueldo_bruto) AS con_sueldo FROM payroll""")
def src16_table_load_replace(spark, sf_dir):
    path = _scratch(spark, "tabla")
    SK.table_load_replace(payroll(spark, sf_dir), path, "2025-09-30 00:00:00")
    SK.table_load_replace(payroll(spark, sf_dir), path, "2025-10-31 00:00:00")  # replace, not add
    t = spark.read.parquet(path)
    return t.agg(F.count(F.lit(1)).alias("n"), F.count("sueldo_bruto").alias("con_sueldo"))


@query("src17_metadata_append")
def src17_metadata_append(spark, sf_dir):
    """Rows-only: two loads append two statistics rows to the load log."""
    path = _scratch(spark, "metadata")
    p = payroll(spark, sf_dir)
    SK.metadata_append(SK.load_stats(p, "2025-09-30 00:00:00", "orders"), path)
    SK.metadata_append(SK.load_stats(p.where(F.col("sueldo_bruto") > 0), "2025-10-31 00:00:00", "orders"), path)
    return spark.read.parquet(path)


@query("src18_export_csv", """SELECT cargo, count(*) AS n FROM payroll GROUP BY cargo""")
def src18_export_csv(spark, sf_dir):
    t, out = _scratch(spark, "tabla-exp"), _scratch(spark, "export")
    _payroll_rows(spark, sf_dir).join(payroll(spark, sf_dir).select("id", "cargo"), "id").write.parquet(t)
    SK.export_csv(spark, t, out)
    return FS.csv_scan(spark, out).groupBy("cargo").agg(F.count(F.lit(1)).alias("n"))


@query("src19_dedup_columns", """SELECT id, organismo, sueldo_bruto FROM payroll""")
def src19_dedup_columns(spark, sf_dir):
    p = payroll(spark, sf_dir)
    dup = p.select("id", "organismo", "sueldo_bruto", F.col("nombre").alias("organismo"))
    return SK.dedup_columns(dup)


# --- JSON --------------------------------------------------------------------------------
@query("src08_json_records", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""", payroll=False)
def src08_json_records(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return D.json_records(ev, "props", StructType([StructField("k", IntegerType())]), (), keep=("event_id",))


def _pkg_format():
    return (F.when(F.col("event_type") == "click", "CSV").when(F.col("event_type") == "purchase", "xlsx")
            .when(F.col("event_type") == "error", "xls").when(F.col("event_type") == "view", "html")
            .otherwise("pdf"))


@query("src09_json_packages", """
SELECT event_id, 'paquete-' || user_id AS paquete,
  CASE event_type WHEN 'click' THEN 'csv' ELSE 'xlsx' END AS formato,
  'https://datos.example.cl/recurso/' || event_id || '.' || CASE event_type WHEN 'click' THEN 'csv' ELSE 'xlsx' END AS url
FROM events WHERE event_type IN ('click', 'purchase')""", payroll=False)
def src09_json_packages(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    fmt = _pkg_format()
    url = F.when(F.col("event_type") != "error",
                 F.concat(F.lit("https://datos.example.cl/recurso/"), F.col("event_id"), F.lit("."), F.lower(fmt)))
    resources = F.array(F.struct(fmt.alias("format"), url.alias("url")),
                        F.struct(F.lit("api").alias("format"), F.lit("https://datos.example.cl/api").alias("url")))
    doc = F.to_json(F.struct(F.struct(F.array(F.struct(
        F.concat(F.lit("paquete-"), F.col("user_id")).alias("name"), resources.alias("resources")))
        .alias("results")).alias("result")))
    return D.json_packages(ev.select("event_id", doc.alias("doc")), "doc", keep=("event_id",))


# --- HTML --------------------------------------------------------------------------------
@query("src10_html_tables")
def src10_html_tables(spark, sf_dir):
    """Rows-only: every table row of every page (the driver's pages have no tables)."""
    return H.html_tables(table(spark, sf_dir, "pages"))


@query("src11_html_links", f"""WITH {LINKS_SQL} SELECT page_id, posicion, url, texto FROM links""", payroll=False)
def src11_html_links(spark, sf_dir):
    return _links(spark, sf_dir)


@query("src12_link_relevance", f"""
WITH {LINKS_SQL}
SELECT page_id, posicion, url, texto, CASE
  WHEN coalesce(regexp_matches(lower(texto), '{"|".join(f"(?:{p})" for p in H.SALARY_PATTERNS)}'), false) THEN 'texto'
  WHEN {" OR ".join(f"contains(lower(url), '{e}')" for e in H.DATA_EXTENSIONS)} THEN 'extension'
  WHEN contains(lower(url), 'transparencia') OR contains(lower(url), 'remuneraciones') THEN 'ruta' END AS motivo
FROM links WHERE motivo IS NOT NULL""", payroll=False)
def src12_link_relevance(spark, sf_dir):
    return H.link_relevance(_links(spark, sf_dir))


@query("src13_link_domain_filter", f"""
WITH {LINKS_SQL},
f AS (SELECT page_id, url, min(posicion) AS posicion FROM links
      WHERE contains(regexp_extract(url, '{H.HOST_RE}', 1), 'example.com') GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY posicion) AS orden FROM f)
WHERE orden <= 5""", payroll=False)
def src13_link_domain_filter(spark, sf_dir):
    return H.link_domain_filter(_links(spark, sf_dir), "example.com", cap=5)


@query("set02_distinct_ordered", f"""
WITH {LINKS_SQL}
SELECT url, min({{'page_id': page_id, 'posicion': posicion}}).page_id AS primera_page_id,
  min({{'page_id': page_id, 'posicion': posicion}}).posicion AS primera_posicion FROM links GROUP BY url""",
       payroll=False)
def set02_distinct_ordered(spark, sf_dir):
    return SE.distinct_ordered(_links(spark, sf_dir), "url", ["page_id", "posicion"])


@query("scl22_text_relevance", f"""
SELECT page_id, regexp_matches(lower(html), '{"|".join(f"(?:{p})" for p in H.SALARY_PATTERNS)}') AS relevante
FROM pages""", payroll=False)
def scl22_text_relevance(spark, sf_dir):
    return H.text_relevance(table(spark, sf_dir, "pages")).select("page_id", "relevante")


@query("scl18_21_url_fields", f"""
WITH {LINKS_SQL}
SELECT page_id, posicion,
  CASE WHEN regexp_extract(url, '/([0-9]{{4}})/', 1) <> '' THEN regexp_extract(url, '/([0-9]{{4}})/', 1) ELSE '2024' END AS anio,
  {S.month_from_url('url')} AS mes,
  CASE WHEN contains(url, 'planta') THEN 'planta' WHEN contains(url, 'contrata') THEN 'contrata' ELSE 'honorarios' END AS tipo,
  CASE WHEN ends_with(url, '.csv') THEN 'csv' WHEN ends_with(url, '.xlsx') OR ends_with(url, '.xls') THEN 'excel'
       WHEN ends_with(url, '.pdf') THEN 'pdf' ELSE 'html' END AS formato
FROM links""", payroll=False)
def scl18_21_url_fields(spark, sf_dir):
    l = _links(spark, sf_dir)
    return l.select("page_id", "posicion", U.year_from_url("url").alias("anio"),
                    U.month_from_url("url").alias("mes"), U.staff_type_from_url("url").alias("tipo"),
                    file_kind("url").alias("formato"))


@query("scl24_25_slug_filename", """
SELECT page_id, translate(replace(lower(texto), ' ', ''), 'áéíóú', 'aeiou') AS slug,
  CASE WHEN regexp_extract(coalesce(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '([^/]+)$', 1) <> ''
       THEN regexp_extract(coalesce(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '([^/]+)$', 1)
       ELSE regexp_replace(url, '[^\\p{L}\\p{N}_]+', '_', 'g') END AS archivo, posicion
FROM (WITH """ + LINKS_SQL.strip() + """ SELECT * FROM links)""", payroll=False)
def scl24_25_slug_filename(spark, sf_dir):
    l = _links(spark, sf_dir)
    return l.select("page_id", T.slug("texto").alias("slug"), T.safe_filename("url").alias("archivo"), "posicion")


# --- content manifest -----------------------------------------------------------------------
@query("src20_hash_manifest", """
WITH prev AS (SELECT d.doc_id AS clave, sha256(d.text) AS sha256 FROM documents d
              WHERE d.doc_id IN (SELECT doc_id FROM labels)),
cur AS (SELECT doc_id AS clave, sha256(regexp_replace(text, '[ \t]+', ' ', 'g')) AS sha256 FROM documents)
SELECT CASE WHEN p.sha256 IS NULL THEN 'NEW' WHEN p.sha256 <> c.sha256 THEN 'CHANGED' ELSE 'SAME' END AS estado,
  count(*) AS n FROM cur c LEFT JOIN prev p ON c.clave = p.clave GROUP BY 1""", payroll=False)
def src20_hash_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    path = F.concat(F.lit("raw/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    previous = D.content_manifest(labelled, "doc_id", "text", path)
    fetched = docs.withColumn("text", F.regexp_replace("text", "[ \t]+", " "))
    current = D.content_manifest(fetched, "doc_id", "text", path)
    cls = D.classify_against_manifest(current, previous)
    return cls.groupBy("estado").agg(F.count(F.lit(1)).alias("n"))
