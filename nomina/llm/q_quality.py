"""Query of the host-level quality rules, and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomina.llm.common import only_rows, table
from nomina.llm.host_rules import host_rules

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_fails", "host_strict", "kept")


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(table(spark, sf_dir, "documents")).select(F.col("_id").alias("doc_id"), *COLUMNS)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.  Rows with a null or empty text fail the base rule and go;
    repeated rows share a verdict; rows that agree in id but not in text are judged apart; an
    empty table stays empty; all columns pass through."""
    verdicts = host_rules(docs)
    rejected = verdicts.where(~F.col("kept")).select("_id", "_digest")
    return only_rows(docs, rejected, "doc_id", "text", "source", anti=True)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT rid, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8),
g AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS win FROM p),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(generate_series(i, i + 7)) AS j FROM r) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
ld AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
       FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.rid, doc_id, source, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars,
             len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN ld USING (rid) LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             CAST(10 * n_symbols > n_words AS INT) + CAST(word_chars < 3 * n_words OR word_chars > 10 * n_words AS INT)
             + CAST(10 * n_dup_lines > 3 * n_lines AS INT) + CAST(10 * n_repeat_words > n_words AS INT) AS n_fails FROM m),
h AS (SELECT source, count(*) AS nd, count(*) FILTER (n_fails > 0) AS nf FROM f GROUP BY source),
pr AS (SELECT avg(nf / nd) AS mu, var_pop(nf / nd) AS v FROM h),
s AS (SELECT mu, CASE WHEN v <= 1e-12 THEN 1e6 ELSE least(1e6, greatest(1.0, mu * (1 - mu) / v - 1)) END AS s FROM pr),
hv AS (SELECT source, (nf + mu * s) / (nd + s) >= 0.5 AS host_strict FROM h, s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, CAST(n_fails AS INT) AS n_fails, host_strict,
       NOT base_failed AND n_fails < CASE WHEN host_strict THEN 1 ELSE 2 END AS kept
FROM f JOIN hv ON f.source IS NOT DISTINCT FROM hv.source
"""
QUERIES = {"op4_host_rules": op4_host_rules}
ORACLES = {"op4_host_rules": SQL}
