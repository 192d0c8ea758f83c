from nomina.llm.decontaminate import decontaminate


def test_spans_and_threshold(spark):
    item = " ".join(f"i{k}" for k in range(20))
    pad = lambda n: " ".join(f"p{k}" for k in range(n))
    docs = spark.createDataFrame([(1, f"{pad(5)} {item.upper()}"), (2, f"{pad(260 - 13)} " + " ".join(f"I{k}." for k in range(13))),
                                  (3, f"{pad(261 - 13)} " + " ".join(f"i{k}" for k in range(13))), (4, " ".join(f"i{k}" for k in range(12)))], "doc_id long, text string")
    items = spark.createDataFrame([("b", item), ("a", item), (None, "")], "item_id string, text string")
    got = {r["_id"]: r for r in decontaminate(docs, items).collect()}
    assert [got[i]["n_hit"] for i in (1, 2, 3, 4)] == [20, 13, 13, 0]
    assert [got[i]["contaminated"] for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert got[1]["items"] == ["a", "b"] and got[4]["items"] == []
    assert (min(s["at"] for s in got[1]["spans"]), max(s["end"] for s in got[1]["spans"])) == (5, 25)


def test_many_fingerprints_use_the_large_bitmap(spark):
    from pyspark.sql import functions as F

    from nomina.llm.decontaminate import bitmap, passes

    fps = spark.range(40_000).select(F.xxhash64("id").alias("fp"))
    import numpy as np

    own = np.array([r[0] for r in fps.collect()], np.int64).view(np.uint64)
    other = np.array([r[0] for r in spark.range(50_000, 90_000).select(F.xxhash64("id")).collect()], np.int64).view(np.uint64)
    bits = bitmap(fps)
    assert bits.dtype != bool and passes(bits, own).all() and passes(bits, other).mean() < 0.05
