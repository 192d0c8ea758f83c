"""Words, word hashes and n-gram hashes of a batch of texts, on whole byte buffers.

A batch is cut into chunks of about ``CHUNK`` bytes (a longer text is a chunk of its own),
so memory follows the chunk and no text is cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18

#: Bytes that end a word: ASCII white space (0x20, 0x09-0x0D).
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes that end a word made of ASCII letters, digits and everything beyond ASCII.
NON_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
#: A-Z to a-z, all else unchanged.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
SAME = np.arange(256, dtype=np.uint8)

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator: spreads every bit over all 64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_SLOT = mix(np.arange(1, 65, dtype=np.uint64) * _U(0xD1342543DE82EF95)) | _U(1)


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.full(max(n, CHUNK), base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


def chunks(texts: pa.Array, powers: Powers, ends: np.ndarray, lower: np.ndarray = SAME, size: int = CHUNK) -> Iterator[tuple[int, Chunk]]:
    """(first row, Chunk) over the rows of ``texts``; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        hi = min(hi, lo + 4096, len(texts))
        yield lo, Chunk(lower[data[off[lo]:off[hi]]], off[lo:hi + 1] - off[lo], powers, ends)
        lo = hi


class Chunk:
    """Texts side by side: ``data`` bytes, ``off`` their limits; words as ``start``/``stop``
    offsets with their text's index ``doc``."""

    def __init__(self, data: np.ndarray, off: np.ndarray, powers: Powers, ends: np.ndarray) -> None:
        self.data, self.off, self.powers, self.n = data, off, powers, len(off) - 1
        word = ~ends[data]
        first = np.zeros(len(data) + 1, bool)
        first[off] = True
        before = np.empty(len(data), bool)
        before[:1], before[1:] = True, ~word[:-1]
        after = np.empty(len(data), bool)
        after[-1:], after[:-1] = True, ~word[1:]
        self.start = np.flatnonzero(word & (before | first[:-1]))
        self.stop = np.flatnonzero(word & (after | first[1:])) + 1
        self.doc = np.searchsorted(off, self.start, "right") - 1
        self.words = np.bincount(self.doc, minlength=self.n)
        self.in_word = word

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]

    def span_hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes of each span, wherever it stands."""
        if not hasattr(self, "_sums"):
            up, self._down = self.powers.to(len(self.data) + 1)
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * up[:-1], out=self._sums[1:])
        return mix((self._sums[stop] - self._sums[start]) * self._down[start])

    def word_hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            self._hash = self.span_hash(self.start, self.stop)
        return self._hash

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (word indexes) at which ``k`` words of one text begin, and their hashes."""
        h, n = self.word_hash(), len(self.start) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1:])
        total = np.full(len(at), _SLOT[k], np.uint64)
        for j in range(k):
            total += h[at + j] * _SLOT[j]
        return at, mix(total)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every distinct ``k``-word shingle, sorted by both; a text with fewer
        words, but not none, has its whole word sequence as one."""
        at, h = self.grams(k)
        docs, hashes = [self.doc[at]], [h]
        for m in range(1, k):
            if (short := self.words == m).any():
                at, h = self.grams(m)
                own = short[self.doc[at]]
                docs.append(self.doc[at][own])
                hashes.append(h[own])
        d, h = np.concatenate(docs), np.concatenate(hashes)
        order = np.lexsort((h, d))
        d, h = d[order], h[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        return d[new], h[new]

    def word_text(self, first: int, n: int) -> str:
        """``n`` words from word ``first`` on, with one space between."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(
            self.start[first:first + n], self.stop[first:first + n], strict=True)).decode()
