"""Query of the cross-tokenizer alignment.  SQL has no tokenizers; tests/llm holds the brute
force."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomina.llm.align import align
from nomina.llm.common import table


def op12_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = align(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op12_align_tokens": op12_align_tokens}
ORACLES: dict = {}
