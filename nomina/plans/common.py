"""Shared helpers for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomina.functions.categorize import categorize_11
from nomina.sources.tables import payroll, table  # noqa: F401  (re-export)

SAL = "sueldo_bruto"


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round the named double columns (half-up, like SQL ``round``)."""
    return df.select(*[F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c)
                       for c in df.columns])


def categorised(spark, sf_dir) -> DataFrame:
    """Payroll rows with the eleven-way body category (SCL-12)."""
    return payroll(spark, sf_dir).withColumn("categoria_organismo", categorize_11("organismo"))
