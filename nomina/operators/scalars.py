"""Attach single-row aggregates (global constants) to rows without a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of ``one_row`` (a global aggregate: exactly one row) to every row.

    Expressed as one scalar subquery over a struct of all its columns: Spark
    evaluates it once and inlines the value, so there is no join of any kind
    (and the subquery fails loudly if it ever returned more than one row).
    """
    packed = one_row.select(F.struct(*[F.col(f"`{c}`") for c in one_row.columns]).alias("_row")).scalar()
    return df.withColumn("_row", packed).select("*", "_row.*").drop("_row")
