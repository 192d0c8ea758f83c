"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary, from the
pieces of its training texts, smoothed with those of all languages.  A word's probability is
the sum over all its segmentations (forward algorithm over a trie of distinct words), a
text's the product over its words; with the languages' shares as prior this gives each
language's posterior.

The model learns from about ``per_language`` training texts a language at most, chosen by a
hash of the id; everything else covers all rows.

Edge cases: null texts and texts without a letter are ``und`` with score 0; so is all if
there is nothing to learn from; rows with a null language are predicted, not learned from;
very long texts are scored whole; of equally likely languages the first by name counts;
repeated rows each give a row; columns other than the named ones are not read; an empty
table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomina.llm import unigram, words

#: Training texts a language, about.
PER_LANGUAGE = 3000
#: Pseudo-counts of the pieces of all languages in each language's probabilities, and of
#: every piece alike in those.
BACKGROUND, EVEN = 200.0, 0.01


def train(docs: DataFrame, doc_id: str, text: str, lang: str, vocabulary: str, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probability by piece and language, log prior) from ``docs``."""
    spark = docs.sparkSession
    docs = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in docs.groupBy(lang).count().collect()}  # a row a language
    if not sizes:
        return [], np.empty((0, 0)), np.empty(0)
    share = F.lit(1.0)
    for name, n in sizes.items():
        share = F.when(F.col(lang) == name, min(1.0, per_language / n)).otherwise(share)
    picked = docs.where(F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) < share * (1 << 20)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    with open(vocabulary, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        coder = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = total.setdefault(name, np.zeros(coder.get_piece_size(), np.int64))
                n += np.bincount(np.array(coder.encode(t, num_threads=1), np.int64), minlength=len(n))
        for name, n in total.items():
            own = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(own, pa.int32()), pa.array(n[own])], names=["lang", "piece", "n"])

    counts = picked.mapInArrow(count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()  # languages x pieces
    names = sorted(sizes)
    pieces = unigram.read_pieces(vocabulary)
    n = np.zeros((len(pieces), len(names)))
    for name, piece, c in counts:
        n[piece, names.index(name)] = c
    back = n.sum(1) + EVEN
    n += BACKGROUND * (back / back.sum())[:, None]
    size = np.array([sizes[x] for x in names], float)
    return names, np.log(n / n.sum(0)), np.log(size / size.sum())


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], doc_id: str = "doc_id", text: str = "text",
             vocabulary: str = unigram.VOCABULARY) -> DataFrame:
    """One row a document: ``doc_id``, lang_pred, score (posterior), log_likelihoods by language."""
    shared = docs.sparkSession.sparkContext.broadcast((unigram.read_pieces(vocabulary), *model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, names, logp, prior = shared.value
        vocab, memo, powers = unigram.Vocabulary(pieces), unigram.Memo(max(1, len(names))), words.Powers()

        def score(new: list[bytes]) -> np.ndarray:
            trie = unigram.Trie(new, vocab)
            return unigram.all_segmentations(trie, logp)[trie.terminal]

        for batch in batches:
            letters = np.array([any(map(str.isalpha, t or "")) for t in batch.column(1).to_pylist()], bool)
            parts = [np.empty((0, len(names)))]
            for _, c in words.chunks(batch.column(1), powers, words.SPACE, size=1 << 20):
                total = np.zeros((c.n, len(names)))
                if names and len(c.start):
                    value, word = memo.of(c, score)
                    for j in range(len(names)):
                        total[:, j] = np.bincount(c.doc, weights=value[word, j], minlength=c.n)
                parts.append(total)
            like = np.concatenate(parts)
            known = letters & bool(names)
            if names:
                post = like + prior
                best = post.argmax(1)
                score_ = 1 / np.exp(np.minimum(post - post.max(1, keepdims=True), 0)).sum(1)
            else:
                best, score_ = np.zeros(len(letters), int), np.zeros(len(letters))
            pred = [names[b] if k else "und" for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(np.where(known, score_, 0.0)),
                                              pa.array(list(like), pa.list_(pa.float64()))], names=["doc_id", "lang_pred", "score", "log_likelihoods"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, log_likelihoods array<double>")
