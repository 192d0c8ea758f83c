"""Pieces of a fixed public vocabulary, and scores of words over all or the best of their
segmentations, computed once for each prefix that words share.

Words carry a leading space mark, as in the vocabulary.  Every single byte is a piece too
(the vocabulary's byte pieces), so each word has a segmentation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from nomina.llm import words

MARK = "▁".encode()
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """The vocabulary's pieces as bytes, in its order; control pieces are empty."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            out.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
        else:
            out.append(b"" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i).encode())
    return out


class Vocabulary:
    """Pieces by hash.  Of pieces with equal bytes (a byte piece and a letter) the last counts."""

    def __init__(self, pieces: list[bytes]) -> None:
        own = {p: i for i, p in enumerate(pieces) if p and MARK not in p[1:]}
        self.powers = words.Powers()
        c = _side_by_side(list(own), self.powers)
        h, ids = c.span_hash(c.off[:-1], c.off[1:]), np.fromiter(own.values(), np.int64, len(own))
        order = np.argsort(h)
        self.hash, self.id = h[order], ids[order]
        self.lengths = sorted({len(p) for p in own})
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hash >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        out = np.full(len(h), -1)
        some = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hash, h[some]), len(self.hash) - 1)
        hit = self.hash[at] == h[some]
        out[some[hit]] = self.id[at[hit]]
        return out


def _side_by_side(texts: list[bytes], powers: words.Powers) -> words.Chunk:
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    return words.Chunk(np.frombuffer(b"".join(texts), np.uint8), off, powers, np.zeros(256, bool))


class Trie:
    """The distinct prefixes of ``texts`` (none empty).  A node stands for a prefix; node 0 is
    the empty one.  ``terminal`` is each text's node."""

    def __init__(self, texts: list[bytes], vocabulary: Vocabulary) -> None:
        c = _side_by_side(texts, vocabulary.powers)
        n = len(c.data)
        text = np.repeat(np.arange(len(texts)), np.diff(c.off))
        begin = c.off[:-1][text]
        at = np.arange(n)
        _, first, node = np.unique(c.span_hash(begin, at + 1), return_index=True, return_inverse=True)
        node = node + 1
        depth = first - begin[first] + 1
        self.n, self.terminal = len(first) + 1, node[c.off[1:] - 1]
        found: list[tuple[np.ndarray, ...]] = []
        for k in vocabulary.lengths:
            long = np.flatnonzero(depth >= k)
            end = first[long] + 1
            piece = vocabulary.find(c.span_hash(end - k, end))
            hit = piece >= 0
            own = long[hit]
            up = np.where(depth[own] == k, 0, node[np.maximum(first[own] - k, 0)])
            found.append((depth[own], own + 1, up, piece[hit]))
        #: Steps (node, node it goes on from, piece), by depth; within one array each node once.
        level, own, up, piece = [np.concatenate(x) for x in zip(*found, strict=True)]
        size = np.concatenate([np.full(len(x[0]), i) for i, x in enumerate(found)])
        order = np.lexsort((size, level))
        cut = np.flatnonzero(np.diff(level[order] * len(found) + size[order])) + 1
        self.steps = list(zip(*(np.split(x[order], cut) for x in (own, up, piece)), strict=True))


def best_counts(trie: Trie, cost: np.ndarray) -> np.ndarray:
    """Pieces of the cheapest segmentation of every prefix (of equally cheap ones the fewest).
    ``cost``: whole numbers by piece."""
    least, count = np.full(trie.n, np.iinfo(np.int64).max // 2), np.zeros(trie.n, np.int64)
    least[0] = 0
    for own, up, piece in trie.steps:
        c, n = least[up] + cost[piece], count[up] + 1
        better = (c < least[own]) | ((c == least[own]) & (n < count[own]))
        least[own], count[own] = np.where(better, c, least[own]), np.where(better, n, count[own])
    return count


def all_segmentations(trie: Trie, logp: np.ndarray) -> np.ndarray:
    """Log of the summed probabilities of all segmentations of every prefix, by column of
    ``logp`` (piece, model)."""
    out = np.full((trie.n, logp.shape[1]), -np.inf)
    out[0] = 0
    for own, up, piece in trie.steps:
        out[own] = np.logaddexp(out[own], out[up] + logp[piece])
    return out


class Memo:
    """Values of words by hash, for one task.  Beyond ``most`` words it starts anew, which
    costs time and changes no result."""

    def __init__(self, width: int, most: int = 400_000) -> None:
        self.hash, self.value, self.width, self.most = np.empty(0, np.uint64), np.empty((0, width)), width, most

    def of(self, c: words.Chunk, score: Callable[[list[bytes]], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(value by distinct word of the chunk, each word's distinct word)."""
        h, first, inverse = np.unique(c.word_hash(), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash, h), max(0, len(self.hash) - 1))
        known = self.hash[at] == h if len(self.hash) else np.zeros(len(h), bool)
        value = np.empty((len(h), self.width))
        value[known] = self.value[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            value[new] = score([MARK + c.data[a:b].tobytes() for a, b in zip(c.start[first[new]], c.stop[first[new]], strict=True)])
            if len(self.hash) + len(new) > self.most:
                self.hash, self.value = h, value
            else:
                both = np.concatenate([self.hash, h[new]])
                order = np.argsort(both, kind="stable")
                self.hash, self.value = both[order], np.concatenate([self.value, value[new]])[order]
        return value, inverse
