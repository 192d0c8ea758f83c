"""Query of mixing sources to target weights."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomina.llm.common import attach, keep, only_rows, table
from nomina.llm.mix import mixture, whole


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = mixture(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes its words, in whole documents: taken /
    size, the fractions rounded so that the words of each source come near its target;
    documents that the mix leaves out go, documents taken twice stand twice.  Repeated rows
    share their copies evenly, one of them has those left over."""
    copies = keep(whole(mixture(docs, key=("text", "source"))[0]))

    def times(rows: DataFrame, n: str) -> DataFrame:
        mixed = attach(rows, copies.select("_id", "_digest", F.expr(n).cast("int").alias("_copies")).where("_copies > 0"), "doc_id", "text", "source")
        return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)

    again = keep(copies.where("n > 1 and copies % n > 0"))
    mixed = times(docs, "copies div n")
    if again.isEmpty():
        return mixed
    once = only_rows(docs, again, "doc_id", "text", "source").dropDuplicates(["doc_id", "text", "source"])
    return mixed.union(times(once, "if(n > 1, copies % n, 0)"))


QUERIES = {"op8_mix_sources": op8_mix_sources}
ORACLES = {}
