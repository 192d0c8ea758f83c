"""JSON documents and content manifests (SRC-08, SRC-09, SRC-20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Data formats kept from package search results.
DATA_FORMATS = ["csv", "xls", "xlsx"]


def json_records(df: DataFrame, col: str, record_schema: StructType,
                 path: tuple[str, ...] = ("result", "records"), keep=()) -> DataFrame:
    """SRC-08: ``{"result": {"records": [...]}}`` text -> one row per record.

    ``path=()`` treats the JSON value itself as a single record.
    """
    if not path:
        parsed = df.select(*keep, F.from_json(col, record_schema).alias("_r"))
        return parsed.select(*keep, "_r.*")
    schema: StructType | ArrayType = ArrayType(record_schema)
    for name in reversed(path):
        schema = StructType([StructField(name, schema)])
    parsed = df.select(*keep, F.from_json(col, schema).alias("_j"))
    arr = F.col("_j." + ".".join(path))
    return parsed.select(*keep, F.explode(arr).alias("_r")).select(*keep, "_r.*")


PACKAGE_SCHEMA = StructType([StructField("result", StructType([StructField("results", ArrayType(
    StructType([StructField("name", StringType()), StructField("resources", ArrayType(StructType([
        StructField("format", StringType()), StructField("url", StringType())])))])))]))])


def json_packages(df: DataFrame, col: str, keep=()) -> DataFrame:
    """SRC-09: package search result -> resources with a data format and a url."""
    parsed = df.select(*keep, F.from_json(col, PACKAGE_SCHEMA).alias("_j"))
    res = parsed.select(*keep, F.explode("_j.result.results").alias("_p"))
    rs = res.select(*keep, F.col("_p.name").alias("paquete"), F.explode("_p.resources").alias("_r"))
    out = rs.select(*keep, "paquete", F.lower("_r.format").alias("formato"), F.col("_r.url").alias("url"))
    return out.where(F.col("formato").isin(DATA_FORMATS) & F.col("url").isNotNull() & (F.col("url") != ""))


def content_manifest(df: DataFrame, key: str, content: str, path: F.Column | None = None) -> DataFrame:
    """Manifest rows ``(key, sha256, path)`` for a content table."""
    p = path if path is not None else F.lit(None).cast("string")
    return df.select(F.col(key).alias("clave"), F.sha2(F.col(content), 256).alias("sha256"), p.alias("ruta"))


def classify_against_manifest(current: DataFrame, previous: DataFrame) -> DataFrame:
    """SRC-20: NEW / CHANGED / SAME per key of the current fetch.

    A shuffle join on the key; unchanged content is what an incremental run
    skips (``estado == 'SAME'``).
    """
    prev = previous.select("clave", F.col("sha256").alias("_prev"))
    j = current.join(prev, "clave", "left")
    estado = (F.when(F.col("_prev").isNull(), F.lit("NEW"))
              .when(F.col("_prev") != F.col("sha256"), F.lit("CHANGED"))
              .otherwise(F.lit("SAME")))
    return j.select("clave", "sha256", "ruta", estado.alias("estado"))


def upsert_manifest(previous: DataFrame, classified: DataFrame) -> DataFrame:
    """New manifest: previous entries not re-fetched, plus every NEW/CHANGED entry."""
    changed = classified.where(F.col("estado") != "SAME").select("clave", "sha256", "ruta")
    kept = previous.join(changed.select("clave"), "clave", "left_anti")
    return kept.unionByName(changed)
