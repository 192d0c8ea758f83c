"""Query of benchmark decontamination, and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomina.llm.common import only_rows, table
from nomina.llm.decontaminate import decontaminate


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("_id").alias("doc_id"), "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated.  Rows with a null, empty or wordless text stay;
    repeated rows stay or go together; without a benchmark all stay; very long texts are judged
    whole; all columns pass through."""
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return only_rows(docs, out.where("contaminated"), "doc_id", "text", anti=True)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bl AS (SELECT item_id, ws, least(13, len(ws)) AS m FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS win
       FROM (SELECT item_id, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM bl)),
dw AS (SELECT rid, m, i, array_to_string(ws[i:i + m - 1], ' ') AS win
       FROM (SELECT rid, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i
             FROM d, (SELECT DISTINCT m FROM bw) AS ms WHERE len(ws) >= m)),
h AS (SELECT rid, i, dw.m AS m, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
c AS (SELECT rid, count(DISTINCT j) AS n_hit
      FROM (SELECT rid, unnest(generate_series(i, i + m - 1)) AS j FROM (SELECT DISTINCT rid, i, m FROM h)) GROUP BY rid),
o AS (SELECT rid, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items
      FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN o USING (rid)
"""
QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLES = {"op2_decontaminate": SQL}
