"""Registered keyed-state / streaming queries (STR-01..05).

The streaming forms are checked against the same SQL as the batch forms:
an ``AvailableNow`` run over the landed files must equal the batch result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from nomina.plans.common import rounded, table
from nomina.plans.q_relational import PROGRESS_SQL
from nomina.plans.registry import query
from nomina.session import scratch_path
from nomina.streaming import ingest as ING
from nomina.streaming.progress import PUBLIC_COLS, attempts_from_events, failures, progress, progress_summary

PROGRESS_ORACLE = f"""WITH {PROGRESS_SQL}
SELECT organismo_id, status, last_attempt, success_count, error_count, last_error, data_count,
  round(processing_time, 4) AS processing_time FROM prog"""


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@query("str01_progress_upsert", PROGRESS_ORACLE, payroll=False)
def str01_progress_upsert(spark, sf_dir):
    p = progress(attempts_from_events(table(spark, sf_dir, "events"))).select(*PUBLIC_COLS)
    return rounded(p, {"processing_time": 4})


@query("str01_progress_stream", PROGRESS_ORACLE, payroll=False)
def str01_progress_stream(spark, sf_dir):
    """Same table maintained by a file-source stream, one landed file per micro-batch."""
    ev = table(spark, sf_dir, "events")
    landing = _scratch(spark, "landing-events")
    ev.repartition(4, "event_id").write.parquet(landing)
    out = ING.run_progress_stream(spark, landing, ev.schema, _scratch(spark, "progress"),
                                  _scratch(spark, "ckpt-progress"), files_per_trigger=1)
    return rounded(out, {"processing_time": 4})


@query("str02_progress_summary", f"""WITH {PROGRESS_SQL}
SELECT count(*) AS total, count_if(status = 'success') AS exitosos, count_if(status = 'error') AS con_error,
  count_if(status = 'no_data') AS sin_datos, CAST(coalesce(sum(data_total), 0) AS BIGINT) AS datos_extraidos,
  max(last_attempt) AS ultimo_intento,
  round(CASE WHEN count(*) > 0 THEN count_if(status = 'success') * 100.0 / count(*) ELSE 0 END, 4) AS tasa_exito
FROM prog""", payroll=False)
def str02_progress_summary(spark, sf_dir):
    p = progress(attempts_from_events(table(spark, sf_dir, "events")))
    return rounded(progress_summary(p), {"tasa_exito": 4})


SESSIONS_SQL = """ses AS (SELECT event_id // 700 AS id, min(ts) AS inicio, max(ts) AS fin, count(DISTINCT user_id) AS organismos, count(*) AS intentos
  FROM events GROUP BY 1)"""


@query("str02_last_session", f"""WITH {PROGRESS_SQL}, {SESSIONS_SQL}, u AS (SELECT * FROM ses ORDER BY inicio DESC, id DESC LIMIT 1)
SELECT count(*) AS total, count_if(status = 'success') AS exitosos, any_value(u.id) AS sesion_id, any_value(u.inicio) AS sesion_inicio,
  any_value(u.fin) AS sesion_fin, any_value(u.organismos) AS sesion_organismos, any_value(u.intentos) AS sesion_intentos FROM prog, u""", payroll=False)
def str02_last_session(spark, sf_dir):
    """The summary with the session that began last."""
    ev = table(spark, sf_dir, "events")
    sessions = ev.groupBy(F.expr("event_id div 700").alias("id")).agg(
        F.min("ts").alias("inicio"), F.max("ts").alias("fin"), F.countDistinct("user_id").alias("organismos"), F.count(F.lit(1)).alias("intentos"))
    out = progress_summary(progress(attempts_from_events(ev)), sessions)
    return out.select("total", "exitosos", *[c for c in out.columns if c.startswith("sesion_")])


@query("str03_session_rows", """SELECT CAST(count(*) AS BIGINT) AS registros_entrada, 'completada' AS estado FROM events""", payroll=False)
def str03_session_rows(spark, sf_dir):
    """The rows that the sessions of a stream took in are all events, whatever the batches."""
    ev = table(spark, sf_dir, "events")
    landing, state = _scratch(spark, "landing-rows"), _scratch(spark, "progress-rows")
    ev.repartition(3, "event_id").write.parquet(landing)
    ING.run_progress_stream(spark, landing, ev.schema, state, _scratch(spark, "ckpt-rows"))
    return ING.session_log(spark, state).agg(F.sum("registros_entrada").alias("registros_entrada"), F.max("estado").alias("estado"))


def _landed_files(df) -> int:
    """Files of a landing, an even number: they grow with the splits of the table."""
    return 2 * max(1, -(-df.rdd.getNumPartitions() // 2))


@query("str04_changed_content", """
WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256, 1 AS vez FROM documents),
b AS (SELECT doc_id, sha256(coalesce(text, '') || ' v2') AS sha256, 2 AS vez FROM documents WHERE doc_id % 4 = 0)
SELECT doc_id, sha256, vez FROM a UNION ALL SELECT * FROM b""", payroll=False)
def str04_changed_content(spark, sf_dir):
    """A second landing in which a quarter of the documents changed: their new content is
    appended, the rest is skipped."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = _landed_files(docs)
    landing, out, state, ckpt = (_scratch(spark, n) for n in ("landing-chg", "ingested-chg", "manifest-chg", "ckpt-chg"))
    for vez in (1, 2):
        text = F.when((F.col("doc_id") % 4 == 0) & F.lit(vez == 2), F.concat("text", F.lit(" v2"))).otherwise(F.col("text"))
        docs.select("doc_id", text.alias("text"), F.lit(vez).alias("vez")).repartition(n, "doc_id").write.mode("append").parquet(landing)
        got = ING.run_content_ingest(spark, landing, spark.read.parquet(landing).schema, out, state, ckpt, "doc_id", "text", files_per_trigger=n)
    return got.select("doc_id", F.sha2("text", 256).alias("sha256"), "vez")


@query("str03_session_log")
def str03_session_log(spark, sf_dir):
    """Rows-only: one session row per micro-batch of the progress stream."""
    ev = table(spark, sf_dir, "events")
    landing, state = _scratch(spark, "landing-ses"), _scratch(spark, "progress-ses")
    ev.repartition(3, "event_id").write.parquet(landing)
    ING.run_progress_stream(spark, landing, ev.schema, state, _scratch(spark, "ckpt-ses"))
    return ING.session_log(spark, state).select("batch_id", "registros_entrada", "registros_salida", "estado")


@query("str04_incremental_ingest", """SELECT doc_id, sha256(text) AS sha256 FROM documents""", payroll=False)
def str04_incremental_ingest(spark, sf_dir):
    """Documents landed twice; the second landing is all SAME content and is skipped."""
    docs = table(spark, sf_dir, "documents")
    landing = _scratch(spark, "landing-docs")
    n = _landed_files(docs)
    docs.repartition(n, "doc_id").write.parquet(landing)
    docs.repartition(n, "doc_id").write.mode("append").parquet(landing)
    out = ING.run_content_ingest(spark, landing, docs.schema, _scratch(spark, "ingested"),
                                 _scratch(spark, "manifest"), _scratch(spark, "ckpt-docs"), "doc_id", "text", files_per_trigger=n // 2)
    return out.select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("str05_failures_list", f"""WITH {PROGRESS_SQL}
SELECT organismo_id, error_count, last_error FROM prog WHERE status = 'error'
ORDER BY error_count DESC, organismo_id LIMIT 20""", payroll=False)
def str05_failures_list(spark, sf_dir):
    p = progress(attempts_from_events(table(spark, sf_dir, "events")))
    return failures(p, 20).select("organismo_id", "error_count", "last_error")
