"""Running totals in a global order, in two levels.

The rows are dealt out by ranges of the order; each range's total reaches the driver (a row
a partition), the sums of the ranges before come back as a small table, and each range adds
up its own rows.  No task holds more than one range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nomina.session import ensure_checkpoint_dir


def running_totals(df: DataFrame, order: list[str], measure: str, out: str, ranges: int | None = None) -> tuple[DataFrame, object]:
    """(``df`` with ``out``, the sum of ``measure`` over all rows up to the row's own, the sum
    over all rows).  Nulls add nothing; before the first value the sum is null.  Rows equal in
    ``order`` come in any order."""
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    ranged = ranged.withColumn("_range", F.spark_partition_id()).checkpoint()
    totals = ranged.groupBy("_range").agg(F.sum(measure).alias("_sum"))
    before, so_far = [], None
    for row in sorted(totals.collect()):
        before.append((row["_range"], so_far))
        so_far = row["_sum"] if so_far is None else so_far if row["_sum"] is None else so_far + row["_sum"]
    kind = dict(totals.dtypes)["_sum"]
    offsets = df.sparkSession.createDataFrame(before, f"_range int, _before {kind}")
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = F.sum(measure).over(inner)
    joined = ranged.withColumn("_local", local).join(F.broadcast(offsets), "_range")
    total = F.when(F.col("_local").isNull(), F.col("_before")).otherwise(F.col("_local") + F.coalesce("_before", F.lit(0).cast(kind)))
    return joined.select(*df.columns, total.alias(out)), so_far
