"""Query of the SimHash near-duplicates.  SQL has no XXH64; tests/llm holds the brute force."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomina.llm.common import table
from nomina.llm.simhash import near_codes


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_codes(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op11_simhash": op11_simhash}
ORACLES: dict = {}
