"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest k-gram hash of every sliding window of ``w``
successive k-grams.  Two texts that share ``span = k + w - 1`` words share such a window,
hence its smallest hash: joining fingerprints loses no shared span of ``span`` words.
A hit is extended to the ``span``-word windows around it, which are compared word by word.
An item of fewer words than ``span`` is one window; for each such length present among the
items (at most ``span - 1``) documents are fingerprinted with k = that length and w = 1.

Documents emit only fingerprints that a bitmap of the items' fingerprints lets through.
The bitmap has at most 2**27 bits whatever the benchmark's size; what passes by chance falls
out in the exact join, which is broadcast only if the items' windows are measured small.

Edge cases: a null, empty or wordless text has no words, is in no hit and is not
contaminated; a null, empty or wordless item has no window; repeated items count by
item_id, repeated documents each give a row; an empty benchmark gives no hits, empty
documents an empty result; very long texts are searched whole, a chunk each; hits that touch or
overlap count their words once; item_ids are sorted as strings, equal ones once; columns
other than the named ones are not read, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nomina.llm import words
from nomina.llm.common import keep, map_batches, small

SPAN = 13
GRAM = 7
MAX_BITS = 27


def _winners(c: words.Chunk, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, fingerprint, first word of its winner k-gram) of every window of ``w`` k-grams."""
    at, h = c.grams(k)
    n = len(at) - w + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    low, where = h[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, w):
        less = h[j:j + n] <= low
        low[less], where[less] = h[j:j + n][less], j
    whole = at[w - 1:] - at[:n] == w - 1
    whole &= c.doc[at[:n]] == c.doc[at[w - 1:]]
    return at[:n][whole], low[whole], (at[:n] + where)[whole]


def item_windows(items: DataFrame, item_id: str, text: str, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Rows (fp, win, length, item): each window of an item with its fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = words.Powers()
        for batch in batches:
            for lo, c in words.chunks(batch.column(1), powers, words.NON_ALNUM, words.LOWER):
                first, fp, _ = _winners(c, gram, span - gram + 1)
                length = np.full(len(first), span)
                for m in range(1, span):
                    own = c.words == m
                    if own.any():
                        a, h = c.grams(m)
                        pick = own[c.doc[a]]
                        first, fp = np.append(first, a[pick]), np.append(fp, h[pick])
                        length = np.append(length, np.full(pick.sum(), m))
                win = [c.word_text(a, m) for a, m in zip(first.tolist(), length.tolist(), strict=True)]
                ids = batch.column(0).take(pa.array(c.doc[first] + lo))
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(win, pa.string()), pa.array(length, pa.int32()), ids],
                                                 names=["fp", "win", "length", "item"])

    rows = items.select(F.col(item_id).alias("item"), F.col(text).alias("_text"))
    return map_batches(rows, run, f"fp long, win string, length int, item {dict(rows.dtypes)['item']}").distinct()


def bitmap(fps: DataFrame) -> np.ndarray:
    """Bits (as bytes) of the top bits of ``fp``: at least 64 bits a fingerprint, at most
    2**MAX_BITS in all, gathered as 64-bit words."""
    n = fps.agg(F.count(F.lit(1))).first()[0]
    bits = int(min(MAX_BITS, max(16, np.ceil(np.log2(max(n, 1))) + 6)))
    slot = F.shiftrightunsigned("fp", 64 - bits)
    cells = (fps.select(F.shiftright(slot, 6).alias("cell"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - bits}) & 63 as int))").alias("bit"))
             .groupBy("cell").agg(F.bit_or("bit").alias("bit")))
    out = np.zeros(1 << (bits - 6), np.int64)
    got = cells.toPandas()  # 2**21 rows at most
    out[got["cell"].to_numpy()] = got["bit"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool) if bits <= 20 else out


def passes(bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    if bits.dtype == bool:
        return bits[(fp >> np.uint64(64 - int(np.log2(len(bits))))).astype(np.int64)]
    slot = (fp >> np.uint64(64 - int(np.log2(len(bits))) - 6)).astype(np.int64)
    return (bits[slot >> 6] >> (slot & 63)) & 1 > 0


def document_windows(docs: DataFrame, doc_id: str, text: str, others: tuple[str, ...], bits: np.ndarray, short: list[int],
                     span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """A row a document: _row, _id, _digest, n_words, and ``found``: the windows (fp, win, at,
    length) whose fingerprint the bitmap lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    found = pa.list_(pa.struct([("fp", pa.int64()), ("win", pa.string()), ("at", pa.int64()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bits = words.Powers(), shared.value
        for batch in batches:
            n_words, hits = [], []
            for _, c in words.chunks(batch.column(3), powers, words.NON_ALNUM, words.LOWER):
                n_words.append(c.words)
                rows = [[] for _ in range(c.n)]
                begin = np.searchsorted(c.doc, np.arange(c.n))
                for k, w, length in [(gram, span - gram + 1, span)] + [(m, 1, m) for m in short]:
                    first, fp, _ = _winners(c, k, w)
                    pick = passes(bits, fp)
                    for a, h in zip(first[pick].tolist(), fp[pick].view(np.int64).tolist(), strict=True):
                        doc = c.doc[a]
                        rows[doc].append({"fp": h, "win": c.word_text(a, length), "at": a - begin[doc], "length": length})
                hits += rows
            counts = pa.array(np.concatenate(n_words) if n_words else [], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], counts, pa.array(hits, found)], names=["_row", "_id", "_digest", "n_words", "found"])

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("_id"),
                       F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in others]).alias("_digest"), F.col(text).alias("_text"))
    return map_batches(rows, run, f"_row long, _id {dict(rows.dtypes)['_id']}, _digest long, n_words long, "
                                "found array<struct<fp:long,win:string,at:long,length:int>>")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", share: int = 20, key: tuple[str, ...] | None = None) -> DataFrame:
    """One row a document: _id, _digest, n_words, n_hit (words inside an occurring window),
    n_items, items (sorted ids), spans (the hit word ranges), contaminated (a hit and
    ``share * n_hit >= n_words``)."""
    wins = keep(item_windows(items, item_id, item_text))
    bits = bitmap(wins.select("fp").distinct())
    short = sorted(r[0] for r in wins.where(F.col("length") < SPAN).select("length").distinct().collect())  # 12 at most
    found = keep(document_windows(docs, doc_id, text, key or (text,), bits, short))
    cand = found.where(F.size("found") > 0).select("_row", F.explode("found").alias("f")).select("_row", "f.*")
    bench = small(wins.select("fp", "win", "item"), F.col("win"))
    hits = keep(cand.join(bench, ["fp", "win"]).select("_row", "at", "length", "item"))

    order = Window.partitionBy("_row").orderBy("at", "length")
    end = F.col("at") + F.col("length")
    before = F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = hits.select("_row", "at", "length").distinct().withColumn("_before", before)
    fresh = fresh.withColumn("_new", F.greatest(F.lit(0), end - F.greatest(F.col("_before"), F.col("at"))))
    spans = fresh.groupBy("_row").agg(F.sum("_new").alias("n_hit"), F.sort_array(F.collect_list(F.struct("at", end.alias("end")))).alias("spans"))
    owners = hits.select("_row", "item").distinct().groupBy("_row").agg(
        F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("items"))
    out = found.drop("found").join(spans, "_row", "left").join(owners, "_row", "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "n_items": F.coalesce("n_items", F.lit(0)),
                           "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
