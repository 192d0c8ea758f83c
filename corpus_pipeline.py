"""The corpus pipeline: each stage takes what its predecessor kept.

run(spark, sf_dir) applies STAGES to ``documents``; every stage but the last returns the
columns of ``documents``, is written as Parquet to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from nomina.llm import q_decontaminate, q_mix, q_quality, q_shard, q_similar
from nomina.llm.common import table
from nomina.session import scratch_path

STAGES = [
    ("quality rules", q_quality.stage),
    ("n-gram Jaccard join", q_similar.stage),
    ("benchmark decontamination", q_decontaminate.stage),
    ("mixing sources to target weights", q_mix.stage),
    ("sharding", q_shard.stage),
]
#: The mix draws pseudorandom blocks, which SQL does not express; tests/llm has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = table(spark, sf_dir, "documents"), scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
