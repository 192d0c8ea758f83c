"""Query of sharding by histogram sort."""

from pyspark.sql import DataFrame, SparkSession

from nomina.llm.common import table
from nomina.llm.shard import shard


def op5_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their shard and slot.  Null and empty texts have size 1; repeated rows
    each have a slot; an empty table stays empty; columns named like the result's are replaced."""
    return shard(docs)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, strlen(coalesce(text, '')) + 1 AS size,
                  CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS g,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS r,
                  hex(encode(coalesce(text, ''))) AS hx FROM documents),
k AS (SELECT list(c ORDER BY n) AS t FROM (
        SELECT n, list_reduce([CAST(n AS BIGINT)] || [CAST(0 AS BIGINT) FOR z IN range(8)],
               lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS x(n))),
crc AS (SELECT rid, xor(list_reduce([4294967295] || [CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT) FOR i IN range(length(hx) // 2)],
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, k),
tot AS (SELECT sum(size) AS total, count(*) AS rows FROM d),
gs AS (SELECT g, sum(size) AS gb, count(DISTINCT r) AS ids FROM d GROUP BY g),
v AS (SELECT d.*, CASE WHEN gb * 1600 <= total OR ids = 1 THEN -1 ELSE r END AS r0 FROM d JOIN gs USING (g), tot),
u AS (SELECT g, r0, sum(size) AS b FROM v GROUP BY ALL),
us AS (SELECT g, r0, least(15, (2 * (sum(b) OVER (ORDER BY g, r0) - b) + b) * 16 // (2 * total)) AS shard FROM u, tot),
s AS (SELECT v.*, us.shard, CASE WHEN rows // 4096 = 0 THEN 0 ELSE length(bin(rows // 4096)) END AS bits
      FROM v JOIN us USING (g, r0), tot),
b AS (SELECT *, g >> CAST(60 - bits AS INT) AS bn, count(*) OVER (PARTITION BY shard, g >> CAST(60 - bits AS INT)) AS c FROM s)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY bn,
         r >> CAST(60 - greatest(0, ceil(log2(c / 4096))) AS INT), g, r, doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM b JOIN crc USING (rid)
"""
QUERIES = {"op5_histogram_sort": op5_histogram_sort}
ORACLES = {"op5_histogram_sort": SQL}
