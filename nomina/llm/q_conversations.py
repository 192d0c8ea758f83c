"""Query of the conversation prefix trie, and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomina.llm.common import keep, small, table
from nomina.llm.prefix_trie import ordered_turns, prefix_trie

#: Conversations of a family, and the most first turns that one takes from its family's first.
FAMILY, SHARED = 20, 4


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv, depth, a, b, words; convs: conv).  Conversation c begins with the first h
    turns of conversation c - c % 20, h = crc32(c) % 4, and goes on with its own after its
    first h."""
    turns = keep(ordered_turns(turns))
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("_n"))
    convs = convs.withColumns({"_h": F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED, "_base": F.col("conv") - F.col("conv") % FAMILY})
    convs = keep(convs)
    lengths = small(convs.select(F.col("conv").alias("_base"), F.col("_n").alias("_most")))
    convs = keep(convs.join(lengths, "_base", "left").select("conv", "_base", "_h", F.least("_h", F.coalesce("_most", F.lit(0))).alias("_m")))
    first = turns.where(f"i < {SHARED}").withColumnRenamed("conv", "_base")
    shared = first.join(small(convs.where("_m > 0")), "_base").where("i <= _m").select("conv", F.col("i").alias("depth"), "a", "b", "words")
    own = turns.join(small(convs), "conv").where("i > _h").select("conv", (F.col("i") - F.col("_h") + F.col("_m")).alias("depth"), "a", "b", "words")
    return shared.union(own), convs.select("conv")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                      F.col("saved").alias("saved_tokens"), "ends_sha256")


SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT list(c ORDER BY n) AS t FROM (
        SELECT n, list_reduce([CAST(n AS BIGINT)] || [CAST(0 AS BIGINT) FOR z IN range(8)],
               lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS x(n))),
s AS (SELECT DISTINCT c, c - c % 20 AS base, hex(encode(CAST(c AS VARCHAR))) AS hx FROM t),
h AS (SELECT c, base, xor(list_reduce([4294967295] || [CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT) FOR i IN range(length(hx) // 2)],
             lambda c, b: xor(c >> 8, k.t[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h FROM s, k),
r AS (SELECT h.c, 0 AS part, t.i, t.role, t.text FROM h JOIN t ON t.c = h.base AND t.i <= h.h
      UNION ALL SELECT h.c, 1, t.i, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.i > h.h),
d AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY part, i) AS depth FROM r),
m(c, depth, path, words) AS (  -- the path of a node: digest of the parent's path and the last turn
  SELECT c, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT) FROM h
  UNION ALL
  SELECT m.c, d.depth, sha256(m.path || sha256(d.role) || sha256(d.text)), CAST(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')) AS BIGINT)
  FROM m JOIN d ON d.c = m.c AND d.depth = m.depth + 1),
n AS (SELECT depth, path, min(c) AS conv, count(*) AS n_convs, any_value(words) AS words FROM m GROUP BY ALL),
e AS (SELECT depth, path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends
      FROM (SELECT c, depth, path FROM m QUALIFY depth = max(depth) OVER (PARTITION BY c)) GROUP BY ALL),
p AS (SELECT DISTINCT x.depth, x.path, y.path AS up FROM m AS x JOIN m AS y ON y.c = x.c AND y.depth = x.depth - 1),
f AS (SELECT n.*, p.up, q.conv AS parent, coalesce(w.kids, 0) AS kids FROM n LEFT JOIN p USING (depth, path) LEFT JOIN n AS q ON q.depth = n.depth - 1 AND q.path = p.up
      LEFT JOIN (SELECT depth - 1 AS depth, up AS path, count(*) AS kids FROM p GROUP BY ALL) AS w ON w.depth = n.depth AND w.path = n.path),
u AS (SELECT DISTINCT a.depth AS ad, a.path AS ap, b.depth AS bd, b.path AS bp FROM m AS a JOIN m AS b ON a.c = b.c AND a.depth <= b.depth),
z AS (SELECT ad, ap, sum(CASE WHEN f.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((f.n_convs - 1) * f.words) AS saved
      FROM u JOIN f ON f.depth = bd AND f.path = bp GROUP BY ALL)
SELECT f.conv AS conv_id, f.depth, f.parent AS parent_conv_id, f.n_convs, CAST(f.kids AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, coalesce(e.ends, 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855') AS ends_sha256
FROM f JOIN z ON z.ad = f.depth AND z.ap = f.path LEFT JOIN e ON e.depth = f.depth AND e.path = f.path
"""
QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLES = {"op13_prefix_trie": SQL}
