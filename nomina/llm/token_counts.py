"""Token counts under a unigram model, by a trie shared by all pre-tokens of a task.

Pre-tokens are the words between ASCII white space with a space mark before them.  The
distinct ones of a chunk of texts go into a trie; the forward score of every prefix is
computed once, and a word's count is what stands at its last node.  Counts are kept for the
task's later texts in a table of bounded size.

The model is the vocabulary's own order: the cost of a piece is the logarithm of its rank
(Zipf's law), in 1/10,000; single bytes, the way out for what no piece covers, cost 20 more.
The count is that of the cheapest segmentation, of equally cheap ones the shortest.

Edge cases: null, empty and blank texts have 0 tokens; repeated rows each give a row; an
empty table gives an empty result; a very long text is a chunk of its own and counts whole, a
very long word too; of equally cheap segmentations the one with the fewest pieces counts;
columns other than the named ones are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomina.llm import unigram, words


def rank_costs(pieces: list[bytes]) -> np.ndarray:
    rank = np.cumsum([len(p) > 0 for p in pieces])
    one = np.array([len(p) == 1 and p >= b"\x80" for p in pieces])
    return np.round(1e4 * (np.log(rank + 1) + 20 * one)).astype(np.int64)


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = unigram.VOCABULARY) -> DataFrame:
    """One row a document: ``doc_id``, n_words (pre-tokens), n_distinct_words, n_tokens."""
    pieces = unigram.read_pieces(vocabulary)
    # an ASCII byte piece has its letter's bytes: the later entry, the letter, counts
    shared = docs.sparkSession.sparkContext.broadcast((pieces, rank_costs(pieces)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, cost = shared.value
        vocab, memo, powers = unigram.Vocabulary(pieces), unigram.Memo(1), words.Powers()

        def count(new: list[bytes]) -> np.ndarray:
            trie = unigram.Trie(new, vocab)
            return unigram.best_counts(trie, cost)[trie.terminal][:, None]

        for batch in batches:
            cols = [[] for _ in range(3)]
            for _, c in words.chunks(batch.column(1), powers, words.SPACE, size=1 << 20):
                value, word = memo.of(c, count)
                kinds = np.unique(c.doc * len(value) + word) // max(1, len(value)) if len(word) else c.doc
                tokens = np.bincount(c.doc, weights=value[word, 0], minlength=c.n) if len(word) else np.zeros(c.n)
                for col, v in zip(cols, (c.words, np.bincount(kinds, minlength=c.n), tokens), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x) if x else np.empty(0), pa.int64(), safe=False) for x in cols)],
                                             names=["doc_id", "n_words", "n_distinct_words", "n_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_distinct_words long, n_tokens long")
