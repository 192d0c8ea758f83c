import pytest
from pyspark.sql import functions as F

from nomina.llm import shard as module
from nomina.llm.shard import shard


@pytest.mark.parametrize("rows_a_bin", [8, 4096])
def test_hot_group_is_split_and_slots_have_no_gaps(spark, monkeypatch, rows_a_bin):
    monkeypatch.setattr(module, "BIN_ROWS", rows_a_bin)
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"),
                                   F.lit("clash").alias("shard"), F.lit(1).alias("extra"))
    p = shard(docs).toPandas()
    assert sorted(p.doc_id) == list(range(900)) and p.extra.eq(1).all()
    per = p.groupby("shard")["size"].sum()
    assert len(per) == 16 and per.max() - per.min() <= 2 * p["size"].max()
    for _, g in p.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_groups_within_tolerance_stay_whole(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 20_000).cast("string")).alias("text"))
    p = shard(docs).toPandas()
    assert (p.merge(docs.toPandas()).groupby("text")["shard"].nunique() == 1).all()
    per = p.groupby("shard")["size"].sum()
    assert per.max() < 1.01 * per.mean() and per.min() > 0.99 * per.mean()


def test_few_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    p = shard(docs).toPandas()
    assert len(p) == 3 and p["size"].tolist().count(1) == 1 and p.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()
