"""Queries of the unigram operators: token counts and language identification."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomina.llm import language, unigram
from nomina.llm.common import held_out, table
from nomina.llm.token_counts import token_counts


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~held_out("doc_id")), "doc_id", "text", "lang", unigram.VOCABULARY)
    return language.identify(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_token_counts": op1_token_counts, "op7_language_id": op7_language_id}
ORACLES = {}
