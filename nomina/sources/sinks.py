"""Sinks (SRC-14..19) and the load gate (VAL-07).

Writes are plain DataFrameWriter calls: partitioned Parquet/CSV, overwrite
for "replace the table", append for the load log.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomina.operators.scalars import attach_row
from nomina.operators.selection import quantiles
from nomina.sources.files import CSV_FORMAT


class LoadGateError(ValueError):
    """Raised by ``load_gate`` when a frame must not be loaded."""


def write_dated_and_latest(df: DataFrame, base: str, fmt: str = "csv",
                           partition: str = "periodo") -> tuple[str, str]:
    """SRC-14: write partitioned by period, and a second 'latest' copy.  CSV files double the
    quotes inside quotes, as other readers expect."""
    dated, latest = f"{base}/por_periodo", f"{base}/latest"
    # REBALANCE: AQE packs each period into few files and splits a hot period
    # across tasks (a plain repartition(partition) would give it one task).
    options = {**CSV_FORMAT, "header": "true"} if fmt == "csv" else {}
    w = df.hint("rebalance", partition).write.mode("overwrite").options(**options)
    w.partitionBy(partition).format(fmt).save(dated)
    df.write.mode("overwrite").options(**options).format(fmt).save(latest)
    return dated, latest


def write_json_doc(doc: DataFrame, path: str) -> str:
    """SRC-15: a (one-row) statistics document as JSON."""
    doc.coalesce(1).write.mode("overwrite").json(path)
    return path


def dedup_columns(df: DataFrame) -> DataFrame:
    """SRC-19: keep the first of any duplicated column names (positional rename)."""
    names = df.columns
    tmp = [f"_c{i}" for i in range(len(names))]
    seen, keep = set(), []
    for i, n in enumerate(names):
        if n not in seen:
            seen.add(n)
            keep.append(F.col(tmp[i]).alias(n))
    return df.toDF(*tmp).select(*keep)


def gate_counts(df: DataFrame, required=("organismo", "sueldo_bruto"), value: str = "sueldo_bruto") -> DataFrame:
    """The one-pass aggregate behind ``load_gate``: rows, rows with salary, non-nulls per column."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("con_sueldo"),
                  *[F.count(c).alias(f"nn_{c}") for c in required])


def load_gate(df: DataFrame, required=("organismo", "sueldo_bruto"), value: str = "sueldo_bruto",
              max_null_rate: float | None = None) -> dict:
    """VAL-07: required columns present, frame non-empty, some salary; else raise.

    One aggregate pass returns the counts; the optional null-rate bound on
    the required columns fixes the columns-only check of the reference (A-34).
    """
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise LoadGateError(f"faltan columnas requeridas: {missing}")
    row = gate_counts(df, required, value).first()
    if row["n"] == 0:
        raise LoadGateError("no hay registros")
    if row["con_sueldo"] == 0:
        raise LoadGateError("ningún registro tiene sueldo")
    if max_null_rate is not None:
        for c in required:
            rate = 1 - row[f"nn_{c}"] / row["n"]
            if rate > max_null_rate:
                raise LoadGateError(f"{c}: tasa de nulos {rate:.3f} > {max_null_rate}")
    return row.asDict()


def table_load_replace(df: DataFrame, path: str, as_of, required=("organismo", "sueldo_bruto")) -> str:
    """SRC-16: gate, add ``fecha_carga`` and replace the stored table."""
    load_gate(df, required)
    df.withColumn("fecha_carga", F.lit(as_of).cast("timestamp")).write.mode("overwrite").parquet(path)
    return path


def load_stats(df: DataFrame, as_of, origin: str, value: str = "sueldo_bruto") -> DataFrame:
    """One load-log row (SRC-17): counts, distincts and salary statistics."""
    v = F.col(value)
    stats = df.agg(
        F.count(F.lit(1)).alias("total_registros"),
        F.countDistinct("organismo").alias("organismos_unicos"),
        F.countDistinct("estamento").alias("estamentos_unicos"),
        F.countDistinct("grado").alias("grados_unicos"),
        F.countDistinct("fuente").alias("fuentes_unicas"),
        F.avg(v).alias("promedio_sueldo"), F.min(v).alias("min_sueldo"), F.max(v).alias("max_sueldo"),
        F.stddev_samp(v).alias("desv_std"))
    both = attach_row(stats, quantiles(df, value, {"mediana_sueldo": 0.5}))
    return both.select(
        F.lit(as_of).cast("timestamp").alias("fecha_carga"), "total_registros", "organismos_unicos", "estamentos_unicos", "grados_unicos", "fuentes_unicas",
        "promedio_sueldo", "mediana_sueldo", "min_sueldo", "max_sueldo", "desv_std", F.lit(origin).alias("archivo_origen"))


def metadata_append(stats_row: DataFrame, path: str) -> str:
    """SRC-17: append one statistics row per load to the load log."""
    stats_row.write.mode("append").parquet(path)
    return path


def export_csv(spark, table_path: str, out: str) -> str:
    """SRC-18: stored table -> CSV export."""
    spark.read.parquet(table_path).write.mode("overwrite").options(**CSV_FORMAT).option("header", True).csv(out)
    return out
