"""Toxicity by the nearest labelled examples.

1.  Terms are all words, and beginnings of words of 4, 5 and 6 bytes.  A text is its TF-IDF
    vector over all its terms; terms whose presence goes with the label (likelihood ratio
    G2, over the labelled examples) weigh more.
2.  Examples stand in an inverted index, cut into blocks of 64 examples: for each term the
    blocks it occurs in with its largest weight there, and within a block its examples.  The
    lists of terms that one in DENSE examples has are kept as rows of a matrix.  The texts of
    a chunk are searched together.  A block's best possible cosine follows from its largest
    sum over the common terms and its largest weights of the others; each text's most
    promising blocks are read first, then all blocks that can still reach its k-th neighbour.
    The k neighbours are therefore exact (ties: the smaller index).
3.  The votes of the k neighbours, weighed by 1 / (distance + ``SOFT``) and by how many rows
    an example stands for, give a raw score.  Leave-one-out scores of the examples, made
    monotone against their labels, turn it into a probability.  A text that shares no term
    with any example gets the examples' rate.

The classifier is fitted on ``EXAMPLES`` labelled rows a class at most, chosen by a hash of
the id; everything else covers all rows and whole texts, with all their terms.

Edge cases: null and empty texts have no terms; without any example the score is 0; null
labels are not learned from; an id labelled twice counts as the larger label, of several
texts of one id the one with the smallest hash is learned from; very long texts are a chunk
of their own; repeated documents each give a row; columns other than the named ones are not
read; empty tables give an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomina.llm import words
from nomina.llm.common import keep, small

#: Labelled rows a class in the index, about; neighbours; examples a block.
EXAMPLES = 800
NEIGHBOURS = 15
BLOCK = 64
#: Blocks of a text read before bounds are compared.
FIRST = 4
#: A list that holds an example in so many is kept as a row.
DENSE = 16
#: A term that goes with label 1 weighs up to 1 + STRENGTH times its TF-IDF, half of that at a
#: G2 of HALF (chance gives a few).
STRENGTH, HALF = 100.0, 15.0
SOFT = 0.05
STEMS = (4, 5, 6)


def _terms(c: words.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word and of its beginnings; a beginning's hash differs from that
    of the same bytes as a word."""
    doc, h = [c.doc], [c.word_hash()]
    for k in STEMS:
        long = c.stop - c.start >= k
        doc.append(c.doc[long])
        h.append(words.mix(c.span_hash(c.start[long], c.start[long] + k) ^ np.uint64(k)))
    return np.concatenate(doc), np.concatenate(h)


def _counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, times) of the distinct terms of each text."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(first, append=len(h))


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, number) of all numbers of some ranges."""
    n = stop - start
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


@dataclass
class Index:
    """The examples.  ``terms`` sorted hashes, ``idf`` their weights (``unknown``: of others);
    ``blocks``: term t's blocks are entries ``by_term[t]`` to ``by_term[t + 1]`` of ``block``
    and ``high``; entry j's examples are ``by_block[j]`` to ``by_block[j + 1]`` of ``example``
    and ``weight``.  Common terms have a ``row`` (else -1) of ``rows`` instead."""

    terms: np.ndarray
    idf: np.ndarray
    unknown: float
    ids: np.ndarray
    label: np.ndarray
    stands: np.ndarray
    by_term: np.ndarray
    block: np.ndarray
    high: np.ndarray
    by_block: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    row: np.ndarray
    rows: np.ndarray
    plain: float
    curve: tuple[np.ndarray, np.ndarray]

    def vectors(self, c: words.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, unit TF-IDF weight) of the chunk's texts; terms that no example has count
        for the length only."""
        doc, h, n = _counted(*_terms(c))
        at = np.minimum(np.searchsorted(self.terms, h), max(0, len(self.terms) - 1))
        hit = self.terms[at] == h if len(self.terms) else np.zeros(len(h), bool)
        w = (1 + np.log(n)) * np.where(hit, self.idf[at] if len(self.terms) else 0.0, self.unknown)
        norm = np.sqrt(np.bincount(doc, w * w, minlength=c.n))
        return doc[hit], at[hit], w[hit] / norm[doc[hit]]

    def nearest(self, doc: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, but: np.ndarray | None = None, k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of ``n`` texts the ``k`` examples of greatest cosine (above 0), and the
        cosines; ``but``: an example to leave out for each."""
        n_blocks = -(-len(self.ids) // BLOCK)
        if not n_blocks:
            return [(np.empty(0, np.int64), np.empty(0))] * n
        common = self.row[term]
        some = common >= 0
        query = np.zeros((n, len(self.rows)))
        if self.rows.dtype != float:
            self.rows = self.rows.astype(float)  # sums are exact to 12 digits
        query[doc[some], common[some]] = w[some]
        cosine = np.zeros((n, n_blocks * BLOCK))
        cosine[:, :len(self.ids)] = query @ self.rows
        doc, term, w = doc[~some], term[~some], w[~some]
        own, entry = _ranges(self.by_term[term], self.by_term[term + 1])
        cell = doc[own] * n_blocks + self.block[entry]
        bound = np.bincount(cell, w[own] * self.high[entry], n * n_blocks).astype(float).reshape(n, n_blocks)
        bound += cosine.reshape(n, n_blocks, BLOCK).max(2)
        read = np.zeros((n, n_blocks), bool)
        some = min(FIRST, n_blocks)
        np.put_along_axis(read, np.argpartition(-bound, some - 1, axis=1)[:, :some], True, axis=1)
        read &= bound > 0
        self._add(cosine, read, cell, own, entry, doc, w)
        if but is not None:
            cosine[np.arange(n), but] = 0
        # whatever block can still reach the k-th neighbour, or tie with it, is read whole; sums
        # over the common terms alone are never too high
        top = min(k, cosine.shape[1])
        least = np.partition(cosine, cosine.shape[1] - top, axis=1)[:, -top] - 1e-9
        more = ~read & (bound > 0) & (bound >= least[:, None])
        self._add(cosine, more, cell, own, entry, doc, w)
        if but is not None:
            cosine[np.arange(n), but] = 0
        cosine = np.round(cosine[:, :len(self.ids)], 12)
        out = []
        top = min(k, cosine.shape[1])
        least = np.partition(cosine, cosine.shape[1] - top, axis=1)[:, -top]
        for row, bar in zip(cosine, least, strict=True):
            e = np.flatnonzero((row >= bar) & (row > 0))
            e = e[np.lexsort((e, -row[e]))[:k]]
            out.append((e, row[e]))
        return out

    def _add(self, cosine: np.ndarray, read: np.ndarray, cell: np.ndarray, own: np.ndarray, entry: np.ndarray, doc: np.ndarray, w: np.ndarray) -> None:
        """Adds up the cosines with all examples of the (text, block) cells to ``read``."""
        pick = np.flatnonzero(read.ravel()[cell])
        which, at = _ranges(self.by_block[entry[pick]], self.by_block[entry[pick] + 1])
        vector = own[pick][which]
        cosine += np.bincount(doc[vector] * cosine.shape[1] + self.example[at], w[vector] * self.weight[at], cosine.size).reshape(cosine.shape)

    def vote(self, e: np.ndarray, cosine: np.ndarray) -> float:
        w = self.stands[e] / (1 - np.minimum(cosine, 1) + SOFT)
        return float((w * self.label[e]).sum() / w.sum())

    def calibrated(self, raw: float) -> float:
        return float(np.interp(raw, *self.curve))


def term_counts(examples: DataFrame) -> DataFrame:
    """h, hot, n: the examples with each term, labelled 1 and all.  ``examples``: text, toxic."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = words.Powers()
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, c in words.chunks(batch.column(0), powers, words.NON_ALNUM, words.LOWER):
                doc, h, _ = _counted(*_terms(c))
                u, at = np.unique(h, return_inverse=True)
                hot = np.bincount(at, weights=label[lo + doc], minlength=len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(hot), pa.array(np.bincount(at, minlength=len(u)))], names=["h", "hot", "n"])

    return examples.select("text", "toxic").mapInArrow(count, "h long, hot long, n long").groupBy("h").agg(F.sum("hot").alias("hot"), F.sum("n").alias("n"))


def _g2(n: np.ndarray, hot: np.ndarray, size: int, all_hot: int) -> np.ndarray:
    """Likelihood ratio of a term's presence and the label, 0 for terms that go with label 0."""
    total = np.zeros(len(n))
    rate = all_hot / max(1, size)
    for seen, expected in ((hot, n * rate), (n - hot, n * (1 - rate)), (all_hot - hot, (size - n) * rate), (size - all_hot - n + hot, (size - n) * (1 - rate))):
        ok = (seen > 0) & (expected > 0)
        total[ok] += seen[ok] * np.log(seen[ok] / expected[ok])
    return np.where(hot > n * rate, np.maximum(2 * total, 0), 0.0)


def _bare(terms: np.ndarray, n: np.ndarray, size: int, g2: np.ndarray | None = None) -> Index:
    """An index that knows its terms, but no examples yet.  ``n``: examples with each term."""
    order = np.argsort(terms)
    none, line = np.empty(0, np.int64), np.array([0.0, 1.0])
    boost = 1 + STRENGTH / (1 + (HALF / np.maximum(np.zeros(len(terms)) if g2 is None else g2, 1e-3)) ** 4)
    idf = ((np.log((1 + size) / (1 + n)) + 1) * boost).astype(np.float32)
    return Index(terms[order], idf[order], np.log(1 + size) + 1, none, *[none] * 2, np.zeros(len(terms) + 1, np.int64), none, none, np.zeros(1, np.int64), *[none] * 2, np.full(len(terms), -1, np.int32), np.zeros((0, 0)), 0.0, (line, line))


def _vectorise(rows: DataFrame, index: Index) -> pa.Table:
    """i, toxic, stands, terms, weights of the examples."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = words.Powers()
        for batch in batches:
            for lo, c in words.chunks(batch.column(3), powers, words.NON_ALNUM, words.LOWER):
                doc, term, w = shared.value.vectors(c)
                off = pa.array(np.searchsorted(doc, np.arange(c.n + 1)), pa.int32())
                part = batch.slice(lo, c.n)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(off, pa.array(term, pa.int32())), pa.ListArray.from_arrays(off, pa.array(w))],
                                                 names=["i", "toxic", "stands", "terms", "weights"])

    kind = dict(rows.dtypes)["i"]
    found = rows.select("i", "toxic", "stands", "text").mapInArrow(run, f"i {kind}, toxic int, stands double, terms array<int>, weights array<double>").toArrow()
    shared.destroy()
    return found


def _fill(index: Index, ids: np.ndarray, toxic: np.ndarray, stands: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Builds the index from the examples' vectors (terms, weights) and returns those in its
    order.  Examples with the same heaviest term and label stand in the same blocks, which
    keeps the blocks' bounds tight."""
    index.plain = float((stands * toxic).sum() / max(1.0, stands.sum()))
    full = [j for j, (t, _) in enumerate(vectors) if len(t)]
    full.sort(key=lambda j: (vectors[j][0][int(np.argmax(vectors[j][1]))], toxic[j], ids[j]))
    vectors = [vectors[j] for j in full]
    index.ids, index.label, index.stands = ids[full], toxic[full].astype(float), stands[full].astype(float)
    if not full:
        return vectors
    example = np.repeat(np.arange(len(full)), [len(t) for t, _ in vectors])
    term, weight = (np.concatenate(x) for x in zip(*vectors, strict=True))
    weight = weight.astype(np.float32)  # what goes to the executors is kept small
    order = np.lexsort((example, term))
    example, term, weight = example[order].astype(np.int32), term[order], weight[order]
    often = np.flatnonzero(np.bincount(term, minlength=len(index.terms)) * DENSE >= len(full))
    index.row[often] = np.arange(len(often))
    index.rows = np.zeros((len(often), len(full)), np.float32)
    own = index.row[term] >= 0
    index.rows[index.row[term[own]], example[own]] = weight[own]
    example, term, weight = example[~own], term[~own], weight[~own]
    block = example // BLOCK
    first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
    index.example, index.weight, index.block = example.astype(np.min_scalar_type(len(full))), weight, block[first].astype(np.min_scalar_type(len(full)))
    index.high, index.by_block = np.maximum.reduceat(weight, first) if len(first) else weight, np.append(first, len(term)).astype(np.int32)
    index.by_term = np.searchsorted(term[first], np.arange(len(index.terms) + 1)).astype(np.int32)
    return vectors


def _monotone(raw: np.ndarray, label: np.ndarray, stands: np.ndarray, bins: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Rates by range of the raw score, pooled until they rise (pool adjacent violators)."""
    at = np.minimum((raw * bins).astype(int), bins - 1)
    n = np.bincount(at, stands, bins) + 1e-3
    hot = np.bincount(at, stands * label, bins) + 1e-3 * (np.arange(bins) + 0.5) / bins
    pools: list[list[float]] = []
    for i in range(bins):
        pools.append([hot[i], n[i], 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            b = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], b, strict=True)]
    rate = np.concatenate([[p[0] / p[1]] * int(p[2]) for p in pools])
    return (np.arange(bins) + 0.5) / bins, np.clip(rate, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES) -> Index:
    """The calibrated index of the labelled examples."""
    spark = docs.sparkSession
    one = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("i")).agg(F.max(label).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}  # 0 and 1
    share = F.lit(0.0)
    for k in (0, 1):
        share = F.when(F.col("toxic") == k, min(1.0, examples / max(1, sizes.get(k, 0)))).otherwise(share)
    picked = one.where(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < share * (1 << 20)).withColumn("stands", 1 / share)
    own = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("text")).join(small(picked), "i")
    own = own.groupBy("i", "toxic", "stands").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    own = keep(own)  # 2 x EXAMPLES texts, read from here on
    size, hot = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    chosen = term_counts(own).toArrow()  # the terms of 2 x EXAMPLES texts
    h, with_, n = (chosen.column(c).to_numpy() for c in ("h", "hot", "n"))
    index = _bare(h.view(np.uint64), n.astype(float), size, _g2(n, with_, size, hot))
    rows = _vectorise(own, index)  # a row an example
    lists = [rows.column(c).combine_chunks() for c in ("terms", "weights")]
    if isinstance(lists[0], pa.ChunkedArray):
        lists = [pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], x.type) for x in lists]
    cut = lists[0].offsets.to_numpy() if len(lists[0]) else np.zeros(1, np.int64)
    flat = [x.values.to_numpy(zero_copy_only=False) if len(x) else np.empty(0) for x in lists]
    vectors = [(flat[0][a:b].astype(np.int64), flat[1][a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    order = np.argsort(rows.column("i").to_numpy(), kind="stable")
    cols = [rows.column(c).to_numpy()[order] for c in ("i", "toxic", "stands")]
    vectors = _fill(index, *cols, [vectors[j] for j in order])
    if not len(index.ids):
        return index
    shared = spark.sparkContext.broadcast((index, [(t.astype(np.int32), w.astype(np.float32)) for t, w in vectors]))

    def leave_one_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, vectors = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at in np.split(ids, range(BLOCK, len(ids), BLOCK)):
                doc = np.repeat(np.arange(len(at)), [len(vectors[e][0]) for e in at])
                near = index.nearest(doc, *(np.concatenate(x) for x in zip(*[vectors[e] for e in at], strict=True)), len(at), but=at) if len(at) else []
                raw = [index.vote(*x) if len(x[0]) else index.plain for x in near]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(raw, pa.float64())], names=["e", "raw"])

    got = spark.range(len(index.ids)).repartition(max(1, len(index.ids) // 500), "id").mapInArrow(leave_one_out, "e long, raw double").collect()
    e, raw = np.array([r["e"] for r in got]), np.array([r["raw"] for r in got])
    shared.destroy()
    index.curve = _monotone(raw, index.label[e], index.stands[e])
    return index


def toxicity(docs: DataFrame, index: Index, doc_id: str = "doc_id", text: str = "text", evidence: int = 3) -> DataFrame:
    """One row a document: ``doc_id``, score, predicted, evidence (ids of its nearest examples)."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, powers = shared.value, words.Powers()
        for batch in batches:
            for lo, c in words.chunks(batch.column(1), powers, words.NON_ALNUM, words.LOWER):
                score, found = np.empty(c.n), []
                doc, term, w = index.vectors(c)
                for first in range(0, c.n, 2 * BLOCK):  # texts searched together
                    last = min(c.n, first + 2 * BLOCK)
                    some = slice(*np.searchsorted(doc, [first, last]))
                    for i, near in enumerate(index.nearest(doc[some] - first, term[some], w[some], last - first)):
                        score[first + i] = index.calibrated(index.vote(*near)) if len(near[0]) else index.plain
                        found.append(index.ids[near[0][:evidence]].tolist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, c.n), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(found, pa.list_(pa.int64()))],
                                                 names=["doc_id", "score", "predicted", "evidence"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int, evidence array<long>")
