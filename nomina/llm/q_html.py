"""Query of main-text extraction."""

from pyspark.sql import DataFrame, SparkSession

from nomina.llm.common import table
from nomina.llm.html_text import extract


def op10_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op10_line_blocks": op10_line_blocks}
ORACLES = {}
