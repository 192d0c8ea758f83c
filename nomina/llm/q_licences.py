"""Query of licence scans."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomina.llm.common import table
from nomina.llm.licences import scan


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), "n_paragraphs", "n_licences", F.array_join("families", ",").alias("families"))


QUERIES = {"op3_licence_scan": op3_licence_scan}
ORACLES = {}
