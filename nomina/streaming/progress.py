"""Keyed extraction progress: batch form and Structured Streaming form (STR-01..05).

The reference keeps a per-body progress row (status, success/error
counters, last error, data count) updated one attempt at a time.  Here an
*attempt log* is the input; the progress table is its keyed aggregate:

  batch   : ``progress(attempts)`` -- one grouped aggregate (map-side combined)
  stream  : ``start_progress_stream`` -- the same aggregate maintained by a
            file-source stream; each micro-batch is folded into a Parquet
            progress table with ``foreachBatch`` (idempotent per batch id).

Driver test data: ``events`` is the attempt log (key = ``user_id``;
``purchase`` -> success, ``error`` -> error, anything else -> no_data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomina.operators.scalars import attach_row

# Event type -> attempt status for the driver's events table.
STATUS_OF_EVENT = {"purchase": "success", "error": "error"}


def attempts_from_events(events: DataFrame) -> DataFrame:
    """Attempt log view over ``events``."""
    et = F.col("event_type")
    status = F.when(et == "purchase", "success").when(et == "error", "error").otherwise("no_data")
    return events.select(
        F.col("user_id").alias("organismo_id"), F.col("event_id").alias("intento_id"),
        F.col("ts").alias("ts"), status.alias("status"),
        F.when(et == "error", F.concat(F.lit("error "), F.col("props"))).alias("error"),
        F.when(et == "purchase", F.round("value", 0).cast("bigint")).otherwise(F.lit(0)).alias("data_count"),
        F.col("value").alias("processing_time"))


def progress(attempts: DataFrame, key: str = "organismo_id") -> DataFrame:
    """STR-01 (batch): latest status / error / count per key plus counters.

    Status, error, count and time are those of the newest attempt: a later success
    clears the error.  ``data_total`` adds up all attempts.  ``last_order`` (newest
    attempt) is kept so partial progress tables merge exactly (see ``merge_progress``).
    """
    order = F.struct(F.col("ts").alias("ts"), F.col("intento_id").alias("id"))
    return attempts.groupBy(key).agg(
        F.max_by("status", order).alias("status"),
        F.max("ts").alias("last_attempt"),
        F.count_if(F.col("status") == "success").alias("success_count"),
        F.count_if(F.col("status") == "error").alias("error_count"),
        F.max_by("error", order).alias("last_error"),
        F.max_by("data_count", order).alias("data_count"),
        F.max_by("processing_time", order).alias("processing_time"),
        F.sum("data_count").alias("data_total"), F.max(order).alias("last_order"))


PUBLIC_COLS = ["organismo_id", "status", "last_attempt", "success_count", "error_count", "last_error",
               "data_count", "processing_time"]


def progress_summary(prog: DataFrame, sessions: DataFrame | None = None, start: str = "inicio") -> DataFrame:
    """STR-02: totals per status and success rate (0 when no keys); with ``sessions`` also the
    last one by ``start``, its columns named ``sesion_...`` (null if there was none)."""
    agg = prog.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("exitosos"),
        F.count_if(F.col("status") == "error").alias("con_error"),
        F.count_if(F.col("status") == "no_data").alias("sin_datos"),
        F.coalesce(F.sum("data_total"), F.lit(0)).alias("datos_extraidos"),
        F.max("last_attempt").alias("ultimo_intento"))
    out = agg.withColumn("tasa_exito", F.when(F.col("total") > 0,
                                              F.col("exitosos") * 100.0 / F.col("total"))
                         .otherwise(F.lit(0.0)))
    if sessions is None:
        return out
    whole = F.struct(*sessions.columns)
    last = sessions.agg(F.max_by(whole, F.struct(start, *[c for c in sessions.columns if c != start])).alias("_s"))
    return attach_row(out, last.select(*[F.col(f"_s.{c}").alias(f"sesion_{c}") for c in sessions.columns]))


def failures(prog: DataFrame, n: int = 20, key: str = "organismo_id") -> DataFrame:
    """STR-05: failed keys by error count, most first."""
    return (prog.where(F.col("status") == "error")
            .orderBy(F.desc("error_count"), F.asc(key)).limit(n))


def merge_progress(current: DataFrame | None, batch_progress: DataFrame, key: str = "organismo_id") -> DataFrame:
    """Fold a micro-batch's progress into the stored table (STR-01 upsert).

    Counters add; status, error, count and time follow the newest attempt, so
    folding batches in any order equals the batch aggregate over all attempts.
    """
    if current is None:
        return batch_progress
    cols = batch_progress.columns
    u = current.select(*cols).unionByName(batch_progress)
    return u.groupBy(key).agg(
        F.max_by("status", "last_order").alias("status"),
        F.max("last_attempt").alias("last_attempt"),
        F.sum("success_count").alias("success_count"),
        F.sum("error_count").alias("error_count"),
        F.max_by("last_error", "last_order").alias("last_error"),
        F.max_by("data_count", "last_order").alias("data_count"),
        F.max_by("processing_time", "last_order").alias("processing_time"),
        F.sum("data_total").alias("data_total"),
        F.max("last_order").alias("last_order")).select(*cols)
