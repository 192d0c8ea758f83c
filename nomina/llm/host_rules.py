"""Host-level quality rules.

Each text is measured once; the rules a host's documents fail are summed by host, the
host's failure rate is shrunk towards the corpus by a beta prior fitted to all hosts
(method of moments), and the host's verdict goes back to its documents:

* a document that fails a base rule (too short, mostly repeated) is rejected everywhere;
* a host whose shrunk rate is ``strict_rate`` or more is strict: one failed rule rejects;
* elsewhere ``lenient_fails`` failed rules of the four reject.

A document that fails no rule is therefore kept whatever its host is.

Edge cases: a null or empty text has no words and fails the base rule; rows with a null
host form one host; repeated rows each count; an empty table gives an empty result; very long texts
are measured whole, a chunk each; a host exactly at the limit of the shrunk rate is strict;
columns other than the named ones are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomina.llm import words
from nomina.llm.common import keep, map_batches, small

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a window that counts as repeated if the text has it again.
WINDOW = 8
RULES = ("symbols", "word_length", "dup_lines", "repeats")


def measure(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """One row a document: _id, _host, _digest (of the text), n_words, word_chars,
    n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = words.Powers()
        symbol = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
        starts_char = (np.arange(256) & 0xC0) != 0x80
        for batch in batches:
            parts = [[] for _ in names]
            for _, c in words.chunks(batch.column(3), powers, words.SPACE):
                values = (c.words, c.per_text(c.in_word & starts_char[c.data]), c.per_text(symbol[c.data]), *_lines(c), _repeats(c))
                for p, v in zip(parts, values, strict=True):
                    p.append(v)
            cols = [pa.array(np.concatenate(p) if p else [], pa.int64()) for p in parts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=["_id", "_host", "_digest", *names])

    rows = docs.select(F.col(doc_id).alias("_id"), F.col(host).alias("_host"),
                       F.xxhash64(F.struct(F.col(text).isNull(), F.col(text)), F.struct(F.col(host).isNull(), F.col(host))).alias("_digest"),
                       F.col(text).alias("_text"))
    kinds = dict(rows.dtypes)
    schema = f"_id {kinds['_id']}, _host {kinds['_host']}, _digest long, " + ", ".join(f"{n} long" for n in names)
    return map_batches(rows, run, schema)


def _lines(c: words.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line of their text."""
    cut = np.flatnonzero(c.data == 0x0A)
    begin = np.unique(np.concatenate([c.off[:-1], cut + 1]))
    begin = begin[begin < len(c.data)]
    end = np.append(begin[1:], len(c.data))
    newline = c.data[end - 1] == 0x0A if len(end) else np.empty(0, bool)
    end = end - newline
    full = np.searchsorted(c.start, end) > np.searchsorted(c.start, begin)
    begin, end = begin[full], end[full]
    doc = np.searchsorted(c.off, begin, "right") - 1
    h = c.span_hash(begin, end) + words.mix(doc.astype(np.uint64))
    first = np.unique(h, return_index=True)[1]
    lines = np.bincount(doc, minlength=c.n)
    return lines, lines - np.bincount(doc[first], minlength=c.n)


def _repeats(c: words.Chunk) -> np.ndarray:
    """Words inside windows that their text has twice or more."""
    at, h = c.grams(WINDOW)
    h = h + words.mix(c.doc[at].astype(np.uint64))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(c.start) + 1, np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + WINDOW, -1)
    return np.bincount(c.doc[np.cumsum(edge)[:-1] > 0], minlength=c.n)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_fails() -> dict[str, Column]:
    """The four rules, in whole numbers: symbols beyond a tenth of the words, a mean word
    beyond 3 to 10 characters, duplicates beyond 30 % of the lines, repeats beyond 10 %."""
    n = F.col("n_words")
    return {
        "symbols": 10 * F.col("n_symbols") > n,
        "word_length": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n),
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "repeats": 10 * F.col("n_repeat_words") > n,
    }


def host_verdicts(fails: DataFrame, strict_rate: float = 0.5) -> DataFrame:
    """From rows (_host, n_fails): a row per host with its documents, those that fail a rule,
    the shrunk rate (failing + a) / (documents + a + b), and ``strict``.

    Method of moments over hosts, each weighed alike: with mean m and variance v of the
    rates, a + b = m(1 - m)/v - 1, held to 1..1e6 (1e6 if all rates agree)."""
    hosts = fails.groupBy("_host").agg(F.count(F.lit(1)).alias("host_docs"),
                                       F.count_if(F.col("n_fails") > 0).alias("host_failing"))
    rate = F.col("host_failing") / F.col("host_docs")
    prior = hosts.agg(F.avg(rate).alias("_m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("_v"))
    prior = prior.select("_m", F.when(F.col("_v") <= 1e-12, 1e6).otherwise(
        F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.col("_m") * (1 - F.col("_m")) / F.when(F.col("_v") > 0, F.col("_v")) - 1))).alias("_s"))
    row = prior.first()  # two numbers
    m, s = (row["_m"] or 0.0), (row["_s"] or 1e6)
    shrunk = (F.col("host_failing") + m * s) / (F.col("host_docs") + s)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_strict", shrunk >= strict_rate)


def host_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
               strict_rate: float = 0.5, lenient_fails: int = 2) -> DataFrame:
    """One row a document: its key (_id, _digest), measures, base_failed, n_fails and the
    failed rules, its host's figures, kept."""
    rules = rule_fails()
    m = keep(measure(docs, doc_id, text, host)).withColumn("base_failed", base_failed())
    m = m.withColumn("failed_rules", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()])))
    m = m.withColumn("n_fails", F.size("failed_rules"))
    hosts = keep(host_verdicts(m.select("_host", "n_fails"), strict_rate)).withColumnRenamed("_host", "_h")
    out = m.join(small(hosts, F.col("_h").cast("string")), F.col("_host").eqNullSafe(F.col("_h")), "left").drop("_h")
    verdict = F.col("n_fails") < F.when(F.col("host_strict"), 1).otherwise(lenient_fails)
    return out.withColumn("kept", ~F.col("base_failed") & verdict)
