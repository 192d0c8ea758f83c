"""Window operators (WIN-01..05).

Windows always have a partition key, or run over an already-aggregated
table whose size is bounded by the number of groups (never over raw rows
without a partition).  The global ordered ones (WIN-01) use the rank table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nomina.operators.prefix import running_totals
from nomina.operators.ranks import avg_rank_percentile

SAL = "sueldo_bruto"

__all__ = ["avg_rank_percentile", "running_share", "top_n_per_group", "top_n_summary",
           "top_issues", "batch_numbers"]


def running_share(grouped: DataFrame, order: str, measure: str) -> DataFrame:
    """WIN-02: cumulative sum and cumulative share of ``measure`` in ``order``, over any number
    of rows (two-level running totals; no task holds them all)."""
    out, total = running_totals(grouped, [order], measure, "acumulado")
    kind = dict(out.dtypes)["acumulado"]
    return out.withColumn("participacion_acumulada", F.try_divide(F.col("acumulado"), F.lit(total).cast(kind)))


def top_n_per_group(df: DataFrame, group: str, item: str, n: int = 5) -> DataFrame:
    """WIN-03: the ``n`` most frequent items per group (count desc, item asc)."""
    c = df.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), F.asc(item))
    return c.withColumn("rango", F.row_number().over(w)).where(F.col("rango") <= n)


def top_n_summary(df: DataFrame, group: str, item: str, n: int = 10) -> DataFrame:
    """WIN-03 (audit form): first ``n`` sorted items per group with their counts,
    plus the number of remaining items ("... and N more")."""
    c = df.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.asc(item))
    sizes = c.groupBy(group).agg(F.count(F.lit(1)).alias("items_grupo"))
    ranked = c.withColumn("rango", F.row_number().over(w)).where(F.col("rango") <= n)
    return (ranked.join(sizes, ranked[group].eqNullSafe(sizes[group])).drop(sizes[group])
            .withColumn("restantes", F.greatest(F.col("items_grupo") - n, F.lit(0)))
            .drop("items_grupo"))


def top_issues(issues: DataFrame, kind: str, order: str, per_kind: int = 10, overall: int = 20) -> DataFrame:
    """WIN-04: first ``per_kind`` issues per type, then the first ``overall`` of those."""
    from nomina.operators.sampling import top_k_per_group

    first = top_k_per_group(issues, kind, [F.col(order)], per_kind).drop("rango")
    return first.orderBy(kind, order).limit(overall)


def batch_numbers(keys: DataFrame, order: str, size: int, max_batches: int | None = None) -> DataFrame:
    """WIN-05: cut an ordered list into batches of ``size``; keep the first ``max_batches``.

    With a batch cap the list is first cut to ``size * max_batches`` rows by a
    distributed top-k, so the numbering window sees a bounded number of rows.
    """
    ordered = keys.orderBy(order)
    if max_batches is not None:
        ordered = ordered.limit(size * max_batches)
    numbered = dense_index(ordered, order, "posicion", start=1)
    return numbered.withColumn("lote", F.floor((F.col("posicion") - 1) / F.lit(size)).cast("int"))


def dense_index(df: DataFrame, order: str, name: str = "i", start: int = 0) -> DataFrame:
    """Consecutive positions in ``order``.

    A distributed sort tags every row with ``monotonically_increasing_id`` (partition index in the high
    bits), the tagged frame is checkpointed so the ids are fixed, per-partition
    counts give exclusive offsets (one row per partition, broadcast), and
    ``offset + position within partition`` is the consecutive index.
    """
    from nomina.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    tagged = df.orderBy(order).withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    part = F.shiftright(F.col("_mid"), 33)
    counts = tagged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select("_p", F.coalesce(F.sum("_c").over(
        Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    j = tagged.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    idx = F.col("_o") + (F.col("_mid") - F.shiftleft(F.col("_p"), 33)) + F.lit(start)
    return j.withColumn(name, idx).drop("_p", "_o", "_mid")
