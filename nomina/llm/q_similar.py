"""Query of the n-gram Jaccard join, and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomina.llm.common import keep, only_rows, table
from nomina.llm.similar import similar


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similar(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents one stays: the one with the smallest doc_id (then
    the smallest digest of its text); of its repeated rows one stays.  Documents without a
    link stay."""
    out = keep(similar(docs))
    own = F.col("_id") == F.col("component")
    linked = out.where("n_shingles > 0")
    first = keep(linked.where(own).groupBy("component").agg(F.min("_digest").alias("lo"), F.max("_digest").alias("hi"), F.count(F.lit(1)).alias("c")))
    tied = linked.where(own).join(first.where("lo <> hi"), "component").where("_digest <> lo")
    docs = only_rows(docs, linked.where(~own).union(tied.select(linked.columns)), "doc_id", "text", anti=True)
    again = keep(first.where("c > 1").select(F.col("component").alias("_id"), F.col("lo").alias("_digest")))
    if again.isEmpty():
        return docs
    once = only_rows(docs, again, "doc_id", "text").dropDuplicates(["doc_id", "text"])
    return only_rows(docs, again, "doc_id", "text", anti=True).union(once)


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT rid, array_to_string(ws[i:i + 3], ' ') AS s
      FROM (SELECT rid, ws, unnest(generate_series(1, greatest(1, len(ws) - 3))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
c AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM g AS a JOIN g AS b ON a.s = b.s AND a.rid <> b.rid GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n AS p ON p.rid = x JOIN n AS q ON q.rid = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
r(x, y) AS (SELECT rid, rid FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN r ON r.x = d.rid JOIN d AS o ON o.rid = r.y LEFT JOIN n ON n.rid = d.rid GROUP BY d.rid, d.doc_id, n.n
"""
QUERIES = {"op6_ngram_jaccard": op6_ngram_jaccard}
ORACLES = {"op6_ngram_jaccard": SQL}
