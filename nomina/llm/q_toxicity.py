"""Query of toxicity by the nearest labelled examples."""

from pyspark.sql import DataFrame, SparkSession

from nomina.llm.common import held_out, table
from nomina.llm.toxicity import fit, toxicity


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = fit(docs, labels.where(~held_out("doc_id")))
    return toxicity(docs, index).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "evidence")


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES = {}
