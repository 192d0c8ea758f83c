"""Helpers shared by the operators: reading tables, cutting lineage, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nomina.session import ensure_checkpoint_dir

#: Rows of a narrow table (a few numbers or short strings a row) that may be broadcast.
BROADCAST_ROWS = 500_000
#: Bytes of a table's strings that may be broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there.

    What follows survives a lost executor without repeating the work, and branches of
    the plan share it.  Spark removes the files with the frame."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a narrow kept table that one task reads or writes.
ROWS_A_TASK = 50_000


#: Bytes of a batch of rows on its way to Python, which both sides hold whole outside the heap.
BATCH_BYTES = 2 << 20


def map_batches(rows: DataFrame, run, schema: str) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` with batches of about ``BATCH_BYTES``; a longer row is a
    batch of its own."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` narrow rows, in no more partitions than they need: small tables
    then cost a few files a step, large ones keep their partitions."""
    return df.coalesce(rows // ROWS_A_TASK + 1)


def small(df: DataFrame, strings: Column | None = None,
          max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its measured size is within the bounds, else ``df``
    itself, which Spark then joins by shuffle (with skewed partitions split).

    ``strings`` are the variable-length contents; their bytes are summed and checked."""
    size = F.lit(0) if strings is None else F.coalesce(F.octet_length(strings), F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def row_key(df: DataFrame, doc_id: str, *others: str) -> DataFrame:
    """Key columns ``_id`` and ``_digest`` that rows share only if ``doc_id`` and the
    ``others`` agree; nulls differ from every value."""
    parts = [F.struct(F.col(c).isNull(), F.col(c)) for c in others]
    return df.select("*", F.col(doc_id).alias("_id"), F.xxhash64(*parts).alias("_digest"))


def only_rows(docs: DataFrame, keys: DataFrame, doc_id: str, *others: str, anti: bool = False) -> DataFrame:
    """Rows of ``docs`` whose key is (``anti``: is not) among ``keys`` (``_id``, ``_digest``)."""
    cols = docs.columns
    d, k = row_key(docs, doc_id, *others), keys.select("_id", "_digest").distinct()
    k = small(k).alias("k")
    on = F.col("d._id").eqNullSafe(F.col("k._id")) & (F.col("d._digest") == F.col("k._digest"))
    return d.alias("d").join(k, on, "left_anti" if anti else "left_semi").select(*cols)


def attach(docs: DataFrame, values: DataFrame, doc_id: str, *others: str) -> DataFrame:
    """``docs`` with the further columns of ``values`` (one row for each ``_id``, ``_digest``);
    rows whose key it lacks go."""
    v = small(values.withColumnsRenamed({"_id": "__i", "_digest": "__d"}))
    joined = row_key(docs, doc_id, *others).join(v, F.col("_id").eqNullSafe(F.col("__i")) & (F.col("_digest") == F.col("__d")))
    return joined.select(*docs.columns, *[c for c in values.columns if c not in ("_id", "_digest")])


def held_out(doc_id: str) -> Column:
    """Rows that nothing is learned from: CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
