"""File sources (SRC-01..07): CSV / Parquet scans, dialects per file, multi-file loads.

Raw tables are read with an all-string schema (money is parsed later by
``functions.money``), never with ``inferSchema`` (a full extra pass).
Only the list of files and their dialects reaches the driver.

CSV is read as RFC 4180 has it: a quote inside quotes is doubled, quoted fields may hold
delimiters and line breaks, empty lines are passed, also before the header.  Files whose
lines all hold an even number of quotes are split and scanned by line.  In the others the
quotes before each line decide whether it begins a record (``csv_records``), which keeps
large files splittable too.
"""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nomina.session import ensure_checkpoint_dir

# Candidate CSV delimiters, in preference order on ties.
DELIMITERS = [",", ";", "\t", "|"]
LATIN1 = "ISO-8859-1"
# A quote inside quotes is written twice, white space is part of the value.
CSV_FORMAT = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _quotes(line: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def csv_scan(spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "UTF-8",
             header: bool = True, multi_line: bool | None = None) -> DataFrame:
    """SRC-01: CSV with one header for all files, every column a string.

    ``multi_line``: whether quoted fields hold line breaks; by default one narrow scan finds
    out.  All files must agree in their columns (else see ``csv_dialect_scan``)."""
    if multi_line is None:
        multi_line = not _lines(spark, path).where(_quotes("_line") % 2 == 1).isEmpty()
    if multi_line:
        records = csv_records(spark, path, encoding)
        first = records.where("_first").agg(F.min_by("_record", "_rec")).first()[0]
        if first is None:
            return spark.createDataFrame([], "_c0 string").drop("_c0")
        names = csv_names(first, sep)
        return parse_records(records, names if header else [f"_c{i}" for i in range(len(names))], sep, header).drop("_metadata")
    return (spark.read.options(**CSV_FORMAT).option("header", header).option("sep", sep).option("encoding", encoding)
            .option("inferSchema", False).option("mode", "PERMISSIVE").csv(path))


def _lines(spark: SparkSession, path) -> DataFrame:
    """Every line with its file, the start of its split and its place in it."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("_name"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"), F.rtrim(F.col("value"), F.lit("\r")).alias("_line"))


def csv_names(record: str, sep: str) -> list[str]:
    """The fields of a header record; empty ones are named by their place."""
    return [n or f"_c{i}" for i, n in enumerate(next(csv.reader([record], delimiter=sep)))]


def csv_records(spark: SparkSession, path, encoding: str = "UTF-8") -> DataFrame:
    """The non-empty records of CSV files whose quoted fields hold line breaks: ``_metadata``
    (file_path, file_name), ``_rec`` (ascending within a file), ``_first`` (its file's first,
    the header), ``_record``.

    A line begins a record if an even number of quotes is before it in its file: those of the
    splits before, summed split by split, and those of the lines before in its own split.  No
    task holds more than one split or one record."""
    ensure_checkpoint_dir(spark)
    value = F.col("_line") if encoding == "UTF-8" else F.decode(F.col("_line").cast("binary"), encoding)
    lines = _lines(spark, path).withColumn("_q", F.length("_line") - F.length(F.replace("_line", F.lit('"'), F.lit(""))))
    lines = lines.withColumn("_line", value).checkpoint()
    split = Window.partitionBy("file_path", "_start").orderBy("_at")
    earlier = Window.partitionBy("file_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file_path", "_start").agg(F.sum("_q").alias("_q"))
    splits = splits.select("file_path", "_start", F.coalesce(F.sum("_q").over(earlier), F.lit(0)).alias("_before"))
    lines = lines.withColumn("_in", F.coalesce(F.sum("_q").over(split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lines = lines.join(splits, ["file_path", "_start"])
    lines = lines.withColumn("_begin", F.when((F.col("_before") + F.col("_in")) % 2 == 0, F.col("_at"))).checkpoint()
    # a split's first lines may go on with the last record of an earlier one
    last = lines.groupBy("file_path", "_start").agg(F.max("_begin").alias("_last"))
    last = last.select("file_path", "_start", F.max("_last").over(earlier).alias("_last"))
    lines = lines.withColumn("_rec", F.max("_begin").over(split.rowsBetween(Window.unboundedPreceding, 0))).join(last, ["file_path", "_start"])
    lines = lines.withColumn("_rec", F.coalesce("_rec", "_last"))
    parts = F.sort_array(F.collect_list(F.struct("_start", "_at", "_line")))
    records = lines.groupBy("file_path", "_name", "_rec").agg(F.array_join(F.transform(parts, lambda x: x["_line"]), "\n").alias("_record"))
    records = records.where(F.trim("_record") != "")
    first = records.groupBy("file_path").agg(F.min("_rec").alias("_rec")).select("file_path", "_rec", F.lit(True).alias("_first"))
    return records.join(first, ["file_path", "_rec"], "left").select(
        F.struct("file_path", F.col("_name").alias("file_name")).alias("_metadata"), "_rec", F.coalesce("_first", F.lit(False)).alias("_first"), "_record")


def parse_records(records: DataFrame, names: list[str], sep: str, header: bool = True) -> DataFrame:
    """Records as columns ``names`` (all strings) and ``_metadata``, without the headers."""
    quoted = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = records.where(~F.col("_first")) if header else records
    return rows.select("_metadata", F.from_csv("_record", quoted, {**CSV_FORMAT, "sep": sep, "multiLine": "true"}).alias("_r")).select("_metadata", "_r.*")


def _separator(rows: DataFrame, text: str, *more: Column) -> DataFrame:
    """file_path, ``sep`` and ``more`` aggregates: of the candidate delimiters the one whose
    least count outside quotes over the non-empty ``text`` (plus one if all agree) is
    greatest, earlier candidates first."""
    rows = rows.withColumn("_plain", F.regexp_replace(text, r'(?s)"[^"]*"', ""))
    stats = [agg for i, d in enumerate(DELIMITERS) for n in [F.when(F.trim(text) != "", F.length("_plain") - F.length(F.replace("_plain", F.lit(d), F.lit(""))))]
             for agg in (F.min(n).alias(f"_lo{i}"), F.max(n).alias(f"_hi{i}"))]
    per = rows.groupBy("file_path").agg(*more, *stats)
    score = F.array(*[F.struct(F.when(F.col(f"_hi{i}") > 0, F.col(f"_lo{i}") + (F.col(f"_lo{i}") == F.col(f"_hi{i}")).cast("int")).otherwise(-1).alias("s"),
                               F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])
    return per.withColumn("sep", F.array_max(score)["d"]).drop(*[f"_{x}{i}" for i in range(len(DELIMITERS)) for x in ("lo", "hi")])


def file_dialects(spark: SparkSession, path) -> DataFrame:
    """A row a file: ``file_path``, its first non-empty line or record (``header``), ``sep``,
    ``encoding`` and ``multi_line`` (a quoted field may hold a line break).

    Decided from all bytes of the file, in one scan with map-side aggregation: Latin-1 as soon
    as one line is not valid UTF-8; for the delimiter see ``_separator``.  Only files with a
    line of an odd number of quotes are read again, record by record.
    """
    lines = _lines(spark, path)
    per = _separator(lines, "_line", F.min(F.when(F.trim("_line") != "", F.struct("_start", "_at", "_line"))).alias("_head"),
                     F.bool_and(F.is_valid_utf8("_line")).alias("_utf8"), F.bool_or(_quotes("_line") % 2 == 1).alias("multi_line"))
    ensure_checkpoint_dir(spark)
    per = per.select("file_path", F.col("_head._line").alias("header"), "sep", F.when(F.col("_utf8"), "UTF-8").otherwise(LATIN1).alias("encoding"), "multi_line").checkpoint()
    multi = [r[0] for r in per.where("multi_line").select("file_path").collect()]
    if not multi:
        return per
    records = csv_records(spark, multi).withColumn("file_path", F.col("_metadata.file_path"))
    again = _separator(records, "_record", F.min_by("_record", "_rec").alias("header")).select("file_path", "header", "sep")
    again = again.join(per.select("file_path", "encoding", "multi_line"), "file_path")
    return per.where("not multi_line").unionByName(again)


def csv_dialect_scan(spark: SparkSession, path, finish=lambda df: df) -> DataFrame | None:
    """SRC-02: every file under ``path`` with its own delimiter, encoding and header.

    Files that agree in all of these are one scan; scans are united by column name.  The list
    of files, which Spark's driver holds for any scan, is all that reaches the driver.
    ``finish`` is applied to each scan before the union.
    """
    groups: dict[tuple, list[str]] = {}
    for f in file_dialects(spark, path).where("header is not null").collect():
        groups.setdefault((f["multi_line"], f["encoding"], f["sep"], f["header"]), []).append(f["file_path"])
    frames = []
    for (multi, encoding, sep, _), files in sorted(groups.items()):
        if multi:
            records = csv_records(spark, sorted(files), encoding)
            names = csv_names(records.where("_first").first()["_record"], sep)
            frames.append(finish(parse_records(records, names, sep)).drop("_metadata"))
        else:
            frames.append(finish(csv_scan(spark, sorted(files), sep=sep, encoding=encoding, multi_line=False)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def parquet_scan(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03."""
    return spark.read.parquet(path)


def _try_read(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame | None:
    """Read ``path`` or return None when it does not exist (listing is eager)."""
    from pyspark.errors import AnalysisException

    try:
        return read_any(spark, path, fmt)
    except AnalysisException:
        return None


def read_any(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    fmt = fmt or path.rsplit(".", 1)[-1].lower()
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "json":
        return spark.read.json(path)
    return csv_scan(spark, path)


def first_available(spark: SparkSession, candidates: list[str]) -> DataFrame | None:
    """SRC-04: the first existing, non-empty source of an ordered list (or None)."""
    for path in candidates:
        df = _try_read(spark, path)
        if df is not None and not df.isEmpty():
            return df
    return None


def load_many(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """SRC-05: read every listed file by its format, skip missing ones, union by name."""
    frames = [df.withColumn("archivo_origen", F.lit(p.rsplit("/", 1)[-1]))
              for p in paths if (df := _try_read(spark, p)) is not None]
    if not frames:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# raw/<source>/<YYYY-MM>/<file>  (also accepts hive-style source=/periodo= dirs)
LAYOUT_RE = r"/(?:[a-z_]+=)?([^/=]+)/(?:[a-z_]+=)?([0-9]{4}-[0-9]{2})/([^/]+)$"


def with_provenance(df: DataFrame, as_of=None) -> DataFrame:
    """SRC-07: lineage columns from the file each row came from."""
    p = F.col("_metadata.file_path")
    out = df.withColumns({
        "fuente": F.regexp_extract(p, LAYOUT_RE, 1),
        "periodo": F.regexp_extract(p, LAYOUT_RE, 2),
        "archivo_origen": F.col("_metadata.file_name"),
        "directorio_fuente": F.regexp_extract(p, r"^(.*)/[^/]+$", 1),
    })
    ts = F.lit(as_of).cast("timestamp") if as_of is not None else F.current_timestamp()
    return out.withColumn("fecha_procesamiento", ts)


def landed_sources(spark: SparkSession, root: str) -> list[str]:
    """The source directories of a landing, from the paths of its files."""
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/*/*.csv").select("path")
    return sorted(r[0] for r in files.select(F.regexp_extract("path", r"/([^/]+)/[^/]+/[^/]+$", 1)).distinct().collect())


def month_dir_scan(spark: SparkSession, root: str, sources: list[str] | None = None, as_of=None,
                   pattern: str = "*.csv") -> DataFrame | None:
    """SRC-06: ``root/<source>/<YYYY-MM>/*.csv`` with provenance; all sources of the landing
    unless some are named.  Every file has its own header, delimiter and encoding; rows meet
    by column name.
    """
    from pyspark.errors import AnalysisException

    frames = []
    for src in sources or ["*"]:
        try:
            df = csv_dialect_scan(spark, f"{root.rstrip('/')}/{src}/*/{pattern}", lambda d: with_provenance(d, as_of))
        except AnalysisException:  # a named source that has not landed
            df = None
        if df is not None:
            frames.append(df)
    if not frames:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
