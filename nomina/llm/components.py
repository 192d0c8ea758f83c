"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomina.llm.common import few, keep


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b; whole numbers): root is the smallest
    node its links reach, itself included.  Self-links and repeated links do no harm; no
    links give no rows.

    Each round keeps one row a link at most; a hub's links are joined, never gathered."""
    e = keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        n = e.count()
        if not n:
            break
        e = few(e, n)
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = keep(few(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), n))
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("c"))
        joined = few(large.join(low, "a"), n)
        # (a, m) for every a, (b, m) for its other neighbours
        to = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
        nxt = keep(few(joined.select(F.explode(F.array_distinct(F.array(F.struct(to.alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))).alias("e"))
                       .select("e.*").distinct(), n))
        e = nxt
        # settled when every node below another is below a single one, which is below none
        up = nxt.groupBy("a").agg(F.count(F.lit(1)).alias("c")).alias("u")
        if nxt.select("b").distinct().alias("r").join(up, F.col("r.b") == F.col("u.a"), "left").agg(F.count("u.c")).first()[0] == 0 \
                and up.where("c > 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
