"""Alignment of two tokenizers over a corpus, by byte offsets.

Some places end a token of both tokenizers whatever is around them: before a single space
between two characters that are no white space, and between a Latin letter and an ASCII
sign that no piece of the vocabulary has after a letter.  A text (with the space in front of
it) is cut there into pieces, which are tokenized and aligned apart, each distinct one once
in a task.

1.  The new pieces of a batch: pandas ``merge_asof``, keyed by piece, finds for each token
    start the other side's covering token; the union of both directions are the overlaps.
    Overlapping tokens with equal ends close a group.  Every A token of a group is linked
    with every B token of it.  A document's distinct id pairs are kept, packed.
2.  Id pairs are counted by documents over the whole corpus (each task adds up its own
    first); a pair is an A id's best if no pair of that id has a higher count.
3.  Each document sums its links' counts.  The most frequent pairs, as many as HEAD allows,
    are broadcast; links of all others meet their counts in a join.

Edge cases: a null or empty text has no tokens and zeros; so has a text whose B tokens do
not give back its bytes (it holds the space mark itself); texts of white space, control
characters or special tokens' strings are plain text; repeated rows count as documents of
their own; ties for the highest count are all best; very long texts without spaces are one
piece; columns other than the named ones are not read; an empty table gives an empty
result."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomina.llm.common import keep

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: How byte-level BPE of this kind cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = "▁"
#: Letters at which a text may be cut: Latin ones, which all Unicode versions agree on.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Bytes of text aligned at once, pieces a task remembers, pair counts it holds before it
#: sends them on, and pairs that are broadcast.
CHUNK, PIECES, HELD, HEAD = 1 << 20, 400_000, 1 << 20, 1 << 20


def byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for
    themselves, the rest in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def token_bytes(a_json: str) -> dict[bytes, int]:
    """Bytes to id of the vocabulary's ordinary entries.  Its ids must follow the merges'
    order, since merging goes by id."""
    model, chars = json.loads(a_json), byte_chars()
    special = {t["id"] for t in model["added_tokens"]}
    vocab = model["model"]["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
    ids = [vocab["".join(m)] for m in merges]
    if any(x >= y for x, y in zip(ids, ids[1:], strict=False)):
        raise ValueError("the vocabulary's ids do not follow its merges")
    return {bytes(chars[c] for c in token): i for token, i in vocab.items() if i not in special}


class Aligner:
    """Pieces seen so far, by number, with what their alignment gives."""

    def __init__(self, a_json: str, b_model: bytes) -> None:
        import sentencepiece
        import tiktoken

        a = token_bytes(a_json)
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=a, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a_len = np.zeros(max(a.values()) + 1, np.int64)
        self.a_len[list(a.values())] = [len(x) for x in a]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in x.lstrip(MARK) for x in names if x != MARK):
            raise ValueError("a piece of the vocabulary goes on after a space")
        mixed = {y for i, x in enumerate(names) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i))
                 for y in re.findall(f"(?<=[{LETTERS}])[!-/:-@\\[-`{{-~\t\n\r]", x)}
        signs = "".join(re.escape(chr(c)) for c in (*range(9, 11), 13, *range(33, 127)) if not chr(c).isalnum() and chr(c) not in mixed)
        self.cut = re.compile(rf"(?<=\S)(?= \S)|(?<=[{LETTERS}])(?=[{signs}])")
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(MARK, " ").encode() for i, x in enumerate(names)]
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.n_b = len(names)
        self.kind = "<i4" if len(self.a_len) * self.n_b < 1 << 31 else "<i8"
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.sizes = np.empty((0, 5), np.int64)  # valid, n_a, n_b, n_groups, n_links
        self.text: list[str] = []
        self.first = np.zeros(1, np.int64)  # a piece's own part of pair and times
        self.pair = self.times = np.empty(0, np.int64)

    def numbers(self, text: str) -> list[int]:
        """The numbers of a text's pieces; new pieces get the next ones."""
        index = self.index
        return [index.setdefault(p, len(index)) for p in self.cut.split(" " + text)] if text else []

    def learn(self) -> None:
        """Tokenize and align the pieces that are new since the last call."""
        new = list(islice(self.index, len(self.text), None))
        if not new:
            return
        n, size = len(new), np.array([len(p.encode()) for p in new])
        base = np.cumsum(size) - size
        (a_piece, a), (b_piece, b), valid = self._encode(new, size)
        left, right = self._tokens(a_piece, a, self.a_len, base), self._tokens(b_piece, b, self.b_len, base)
        cover = pd.merge_asof(left, right, on="at", by="piece", suffixes=("", "_b"))[["piece", "end", "end_b"]]
        back = pd.merge_asof(right, left, on="at", by="piece", suffixes=("_b", ""))[["piece", "end", "end_b"]]
        overlaps = pd.concat([cover, back])
        ends = np.unique(overlaps["end"].to_numpy()[overlaps["end"].to_numpy() == overlaps["end_b"].to_numpy()])
        groups = [np.searchsorted(ends, t["end"].to_numpy()) for t in (left, right)]
        of_group = np.zeros(len(ends), np.int64)
        of_group[groups[0]] = left["piece"].to_numpy()
        count = [np.bincount(g, minlength=len(ends)) for g in groups]
        sizes = np.stack([valid, np.bincount(left["piece"], minlength=n), np.bincount(right["piece"], minlength=n), np.bincount(of_group, minlength=n),
                          np.bincount(of_group, weights=count[0] * count[1], minlength=n).astype(np.int64)], axis=1).astype(np.int64)
        # ids of a group, equal ones together, every A with every B
        (ga, ia, ca), (gb, ib, cb) = (_distinct(g, t["id"].to_numpy()) for g, t in zip(groups, (left, right), strict=True))
        m = np.bincount(gb, minlength=len(ends))
        begin = np.cumsum(m) - m
        rep = m[ga]
        own = np.repeat(np.arange(len(ga)), rep)
        other = np.arange(len(own)) - np.repeat(np.cumsum(rep) - rep, rep) + begin[ga][own]
        piece, pair, times = _distinct(of_group[ga][own], ia[own] * self.n_b + ib[other], ca[own] * cb[other])
        self.sizes, self.pair, self.times = np.concatenate([self.sizes, sizes]), np.concatenate([self.pair, pair]), np.concatenate([self.times, times])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(piece, minlength=n))])
        self.text += _texts(left, right, groups, n)

    def _encode(self, new: list[str], size: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
        """(piece, id) of all A tokens and of all B tokens, by piece; and which pieces B gives
        back.  Pieces are cut from their neighbours whatever these are, so they go through the
        tokenizers as one text (but those that end with white space or begin with two)."""
        valid, a, b = np.ones(len(new), bool), [], []
        alone = {i for i, p in enumerate(new) if p[-1].isspace() or MARK in p or p[0] == " " and (len(p) == 1 or p[1].isspace())}
        row = [i for i in range(len(new)) if i not in alone]
        if row:
            # a piece that follows a letter gets one, which no piece owns
            fill = np.array([0 if new[i][0] == " " else 2 for i in row])
            line = "".join([new[i] if new[i][0] == " " else " a" + new[i] for i in row])
            begin = np.cumsum(size[row] + fill) - size[row]
            edges = np.stack([begin - fill, begin], axis=1).ravel()
            owner = np.stack([np.where(fill > 0, -1, row), row], axis=1).ravel()
            x, y = np.array(self.a.encode_ordinary(line), np.int64), np.array(self.b.encode(line[1:]), np.int64)
            if b"".join([self.b_bytes[i] for i in y.tolist()]) == line.encode():
                for ids, length, out in ((x, self.a_len, a), (y, self.b_len, b)):
                    at = np.cumsum(length[ids]) - length[ids]
                    piece = owner[np.searchsorted(edges, at, "right") - 1]
                    out.append((piece[piece >= 0], ids[piece >= 0]))
            else:
                alone = range(len(new))
        for i in alone:
            after = new[i][0] != " "
            y = self.b.encode("a" + new[i])[1:] if after else self.b.encode(new[i][1:])
            valid[i] = b"".join([self.b_bytes[j] for j in y]) == new[i].encode()
            if valid[i]:
                for ids, out in ((self.a.encode_ordinary(new[i]), a), (y, b)):
                    out.append((np.full(len(ids), i), np.array(ids, np.int64)))
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        found = []
        for parts in (a, b):
            piece, ids = (np.concatenate(x) for x in zip(none, *parts, strict=True))
            order = np.argsort(piece, kind="stable")
            found.append((piece[order], ids[order]))
        return found[0], found[1], valid

    @staticmethod
    def _tokens(piece: np.ndarray, ids: np.ndarray, length: np.ndarray, base: np.ndarray) -> pd.DataFrame:
        """piece, id, at and end (offsets; pieces lie side by side) of all tokens."""
        size = length[ids]
        total = np.cumsum(size)
        begin = np.zeros(len(base), np.int64)
        first = np.flatnonzero(np.diff(piece, prepend=-1))
        begin[piece[first]] = (total - size)[first]
        end = base[piece] + total - begin[piece]
        return pd.DataFrame({"piece": piece, "id": ids, "at": end - size, "end": end})

    def expand(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``number``, index into ``pair``) of the pieces' links."""
        n = self.first[number + 1] - self.first[number]
        own = np.repeat(np.arange(len(number)), n)
        return own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + self.first[number][own]


def _distinct(group: np.ndarray, value: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, value) in order, with their number or summed weight."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.flatnonzero((np.diff(g, prepend=-1) != 0) | (np.diff(v, prepend=-1) != 0))
    w = np.ones(len(g), np.int64) if weight is None else weight[order]
    return g[new], v[new], np.add.reduceat(w, new) if len(new) else np.empty(0, np.int64)


def _texts(left: pd.DataFrame, right: pd.DataFrame, groups: list[np.ndarray], n: int) -> list[str]:
    """``a1,a2|b1;a3|b2`` of every piece."""
    group = np.concatenate(groups)
    side = np.repeat([0, 1], [len(left), len(right)])
    order = np.lexsort((side, group))  # stable: tokens keep their order
    piece, ids = (np.concatenate([left[c].to_numpy(), right[c].to_numpy()])[order] for c in ("piece", "id"))
    last = (np.diff(group[order] * 2 + side[order], append=-1) != 0)
    sep = np.where(~last, ",", np.where(side[order] == 0, "|", ";"))
    parts = [f"{i}{s}" for i, s in zip(ids.tolist(), sep.tolist(), strict=True)]
    cut = np.searchsorted(piece, np.arange(n + 1)).tolist()
    return ["".join(parts[i:j])[:-1] for i, j in zip(cut, cut[1:], strict=False)]


class Documents:
    """The documents of one chunk as the numbers of their pieces."""

    def __init__(self, texts: list[str | None], own: Aligner) -> None:
        numbers = [own.numbers(t or "") for t in texts]
        own.learn()
        self.numbers = numbers
        self.n, self.doc = len(texts), np.repeat(np.arange(len(texts)), [len(x) for x in numbers])
        self.piece = np.array([i for x in numbers for i in x], np.int64)
        self.valid = np.bincount(self.doc, weights=own.sizes[self.piece, 0] == 0, minlength=self.n) == 0
        some = self.valid[self.doc]
        self.doc, self.piece = self.doc[some], self.piece[some]

    def links(self, own: Aligner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, links) for every distinct pair of every document."""
        doc, piece, c = _distinct(self.doc, self.piece)
        at, link = own.expand(piece)
        return _distinct(doc[at], own.pair[link], own.times[link] * c[at])


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of about CHUNK characters each; no text is cut."""
    first, texts, size = 0, [], 0
    for i in range(len(column)):
        t = column[i].as_py()
        texts.append(t)
        size += len(t or "")
        if size >= CHUNK or i == len(column) - 1:
            yield first, texts
            first, texts, size = i + 1, [], 0


def _packed(pair: np.ndarray, times: np.ndarray, kind: str) -> bytes:
    """Ascending pairs by their differences, and their links, compressed."""
    return zlib.compress(np.concatenate([np.diff(pair, prepend=0), times]).astype(kind).tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), kind).astype(np.int64)
    return np.cumsum(both[:len(both) // 2]), both[len(both) // 2:]


def aligned(docs: DataFrame, doc_id: str, text: str, vocabularies) -> DataFrame:
    """A row a document: _row, _id, n_a, n_b, n_groups, n_links, groups_sha256, _pairs (packed)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Aligner(*vocabularies.value)
        for batch in batches:
            for first, texts in _chunks(batch.column(2)):
                d = Documents(texts, own)
                edge = np.searchsorted(d.doc, np.arange(d.n + 1))
                cols = []
                for value in own.sizes.T[1:]:
                    total = np.concatenate([[0], np.cumsum(value[d.piece])])
                    cols.append(pa.array(total[edge[1:]] - total[edge[:-1]]))
                names = [";".join([own.text[i] for i in x]) if ok and x else "" for x, ok in zip(d.numbers, d.valid, strict=True)]
                doc, pair, times = d.links(own)
                at = np.searchsorted(doc, np.arange(d.n + 1)).tolist()
                packs = [_packed(pair[i:j], times[i:j], own.kind) for i, j in zip(at, at[1:], strict=False)]
                part = batch.slice(first, d.n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *cols, pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in names]), pa.array(packs, pa.binary())],
                    names=["_row", "_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_pairs"])
                if len(own.index) > PIECES:
                    own.clear()

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"_row long, _id {dict(rows.dtypes)['_id']}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _pairs binary")


def pair_counts(rows: DataFrame, kind: str) -> DataFrame:
    """pair, n (documents that hold it linked); each task adds up its own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            for data in batch.column(0).to_pylist():
                held.append(_unpacked(data, kind)[0])
                size += len(held[-1])
                if size > HELD:
                    yield out()
                    held, size = [], 0
        yield out()

    return rows.select("_pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def frequent(pairs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(pair, n, best) of the pairs with the highest counts, at most ``most`` of them, sorted
    by pair; and whether these are all."""
    octaves = pairs.groupBy(F.floor(F.log2("n")).cast("long").alias("o")).agg(F.count(F.lit(1)).alias("c")).collect()  # 64 rows at most
    total, least = 0, 63
    for o, c in sorted(octaves, reverse=True):
        if total + c > most:
            break
        total, least = total + c, o
    all_of = total == sum(r.c for r in octaves)
    got = pairs.where(F.col("n") >= F.lit(1 << least)).toPandas().sort_values("pair") if total else pairs.limit(0).toPandas()
    return got["pair"].to_numpy(np.int64), got["n"].to_numpy(np.int64), got["best"].to_numpy(np.int64), all_of


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """Two tables.  Documents: _row, _id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256.  Pairs: pair (A id x B's vocabulary size + B id), n (documents), best."""
    spark = docs.sparkSession
    with open(a_file, encoding="utf-8") as a, open(b_file, "rb") as b:
        vocabularies = spark.sparkContext.broadcast((a.read(), b.read()))
    one = Aligner(*vocabularies.value)
    n_b, kind = one.n_b, one.kind
    rows = keep(aligned(docs, doc_id, text, vocabularies))
    counts = keep(pair_counts(rows, kind))
    highest = counts.groupBy(F.expr(f"pair div {n_b}").alias("_a")).agg(F.max("n").alias("_max"))  # a row an A id at most
    pairs = keep(counts.join(F.broadcast(highest), F.expr(f"pair div {n_b}") == F.col("_a")).select("pair", "n", F.expr("if(n = _max, 1L, 0L)").alias("best")))
    *known, all_of = frequent(pairs, head)
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            links = [_unpacked(data, kind) for data in batch.column("_pairs").to_pylist()]
            doc = np.repeat(np.arange(len(links)), [len(x) for x, _ in links])
            own, times = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*links, strict=True)) if links else (np.empty(0, np.int64),) * 2
            at = np.minimum(np.searchsorted(pair, own), max(0, len(pair) - 1))
            hit = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            edge = np.searchsorted(doc, np.arange(len(links) + 1))
            cols = []
            for value in (best, n):
                total = np.zeros(len(own) + 1, np.int64)
                np.cumsum(np.where(hit, times * value[at], 0) if len(pair) else total[1:], out=total[1:])
                cols.append(pa.array(total[edge[1:]] - total[edge[:-1]]))
            off = pa.array(np.searchsorted(doc[~hit], np.arange(len(links) + 1)), pa.int32())
            rest = [pa.ListArray.from_arrays(off, pa.array(x[~hit])) for x in (own, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols, *rest], names=[*batch.schema.names[:-1], "n_best", "count_sum", "_others", "_times"])

    numbers = ("n_a", "n_b", "n_groups", "n_links")
    out = rows.mapInArrow(run, f"_row long, _id {dict(rows.dtypes)['_id']}, {', '.join(f'{c} long' for c in numbers)}, groups_sha256 string, n_best long, count_sum long, "
                               "_others array<long>, _times array<long>")
    cols = ("_row", "_id", *numbers, "n_best", "count_sum", "groups_sha256")
    if all_of:
        return out.select(*cols), pairs
    out = keep(out)
    rest = out.select("_row", F.explode(F.arrays_zip("_others", "_times")).alias("e")).select("_row", F.col("e._others").alias("pair"), F.col("e._times").alias("_t"))
    rest = rest.join(pairs, "pair").groupBy("_row").agg(F.sum(F.col("_t") * F.col("best")).alias("_best"), F.sum(F.col("_t") * F.col("n")).alias("_sum"))
    out = out.join(rest, "_row", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
    return out.select(*cols), pairs
