"""Alignment of two tokenizers against whole texts in the vocabularies' own libraries."""

import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from nomina.llm import align as al
from nomina.llm.q_align import op12_align_tokens
from tests.llm.conftest import nasty_documents

EXTRA = ["  two  spaces \n\n  and\tmore ", "it's <|endoftext|> and <s> </s> <unk>", "mark ▁ itself", "▁", "emoji 😀😀 é̀ x́   no-break", "日本語のテキスト です 中文", "\x00 \x1c a\x1cb \x85 c",
         "a" * 5000, " " * 700, "tab\tsep a\n b\n  c", "don't we'll I'M 's", "x  ", " y", "1 2 33 4444 5,5", "ﬁ ½ Ⅳ ²"]


def whole(texts):
    """(ids of A, ids of B, byte lengths) of whole texts; None where the bytes differ."""
    a = Tokenizer.from_file(al.A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=al.B_FILE)
    chars = al.byte_chars()
    for t in texts:
        if not t:
            yield None
            continue
        x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        xb = [bytes(chars[c] for c in a.id_to_token(i)) for i in x]
        yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        same = b"".join(xb) == b"".join(yb) == (" " + t).encode()
        yield (x, y, list(map(len, xb)), list(map(len, yb))) if same else None


def brute(rows):
    aligned, counts = [], Counter()
    for got in whole([r[1] for r in rows]):
        groups = []
        if got:
            x, y, xl, yl = got
            ends = []
            for sizes in (xl, yl):
                total, at = 0, []
                for s in sizes:
                    total += s
                    at.append(total)
                ends.append(at)
            common = sorted(set(ends[0]) & set(ends[1]))
            by = defaultdict(lambda: ([], []))
            for side, (ids, at) in enumerate(zip((x, y), ends, strict=True)):
                for i, e in zip(ids, at, strict=True):
                    by[next(c for c in common if c >= e) if len(common) < 50 else common[__import__("bisect").bisect_left(common, e)]][side].append(i)
            groups = [by[c] for c in common]
        links = Counter((i, j) for p, q in groups for i in p for j in q)
        counts.update(links.keys())
        aligned.append((got, groups, links))
    best = defaultdict(int)
    for (i, _), c in counts.items():
        best[i] = max(best[i], c)
    out = []
    for r, (got, groups, links) in zip(rows, aligned, strict=True):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((r[0], len(got[0]) if got else 0, len(got[1]) if got else 0, len(groups), sum(links.values()),
                    sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str), counts, best


def test_nasty_rows(spark, nasty):
    assert sorted((tuple(r) for r in op12_align_tokens(spark, nasty).collect()), key=str) == brute(nasty_documents())[0]


@pytest.mark.parametrize("head", [1 << 20, 50, 0])
def test_all_some_or_no_pairs_broadcast(spark, head):
    rows = [(i, t) for i, t in enumerate([*EXTRA, *EXTRA[:4], "the cat sat", "the dog sat", None, ""])]
    docs = spark.createDataFrame(rows, "k long, t string").repartition(3)
    out, pairs = al.align(docs, "k", "t", head=head)
    want, counts, best = brute(rows)
    assert sorted((tuple(r) for r in out.drop("_row").collect()), key=str) == want
    n_b = sentencepiece.SentencePieceProcessor(model_file=al.B_FILE).get_piece_size()
    assert {(r.pair // n_b, r.pair % n_b): (r.n, r.best) for r in pairs.collect()} == {p: (c, int(c == best[p[0]])) for p, c in counts.items()}


def test_driver_rows(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op12_align_tokens(spark, sf_small).collect()), key=str) == brute(rows)[0]


def test_forgetting_pieces_changes_nothing(spark, sf_small, monkeypatch):
    want = sorted((tuple(r) for r in op12_align_tokens(spark, sf_small).collect()), key=str)
    for name, value in (("PIECES", 10), ("HELD", 100), ("CHUNK", 2000)):
        monkeypatch.setattr(al, name, value)
    assert sorted((tuple(r) for r in op12_align_tokens(spark, sf_small).collect()), key=str) == want
