import math
from types import SimpleNamespace

import numpy as np
import pytest

from nomina.llm import catalog, language, unigram
from nomina.llm.common import table
from nomina.llm.token_counts import rank_costs
from tests.llm.conftest import nasty_documents


def words_of(text):
    return (text or "").encode().split()


def test_token_counts_against_brute_force(spark, nasty):
    pieces = unigram.read_pieces()
    cost = rank_costs(pieces)
    own = {p: int(cost[i]) for i, p in enumerate(pieces) if p}
    longest = max(map(len, own))

    def count(word):
        w = unigram.MARK + word
        best = [(0, 0)] + [(math.inf, 0)] * len(w)
        for j in range(1, len(w) + 1):
            best[j] = min((best[i][0] + own[w[i:j]], best[i][1] + 1) for i in range(max(0, j - longest), j) if w[i:j] in own)
        return best[-1][1]

    memo = {}
    want = sorted((i if i is not None else -1, len(words_of(t)), len(set(words_of(t))), sum(memo.setdefault(w, count(w)) for w in words_of(t)))
                  for i, t, *_ in nasty_documents())
    got = sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in catalog.QUERIES["op1_token_counts"](spark, nasty).collect())
    assert got == want


def test_all_segmentations_against_brute_force():
    pieces = [unigram.MARK, b"a", b"b", b"ab", unigram.MARK + b"a", b"ba", b"bab"]
    logp = np.log(np.array([[.1, .2], [.2, .1], [.1, .1], [.2, .2], [.1, .2], [.2, .1], [.1, .1]]))

    def total(w, k):
        return 1.0 if not w else sum(math.exp(logp[i, k]) * total(w[len(p):], k) for i, p in enumerate(pieces) if w.startswith(p))

    texts = [unigram.MARK + w for w in (b"a", b"ab", b"abab", b"babab", b"aab")]
    trie = unigram.Trie(texts, unigram.Vocabulary(pieces))
    got = unigram.all_segmentations(trie, logp)[trie.terminal]
    assert np.allclose(np.exp(got), [[total(w, k) for k in (0, 1)] for w in texts])
    assert trie.n < 1 + sum(map(len, texts))  # prefixes are shared


def test_a_full_memo_starts_anew(spark):
    import pyarrow as pa

    from nomina.llm import words

    memo, asked = unigram.Memo(1, most=3), []

    def score(new):
        asked.append(len(new))
        return np.array([[float(len(w))] for w in new])

    for text in ("a bb ccc", "bb dddd", "a bb"):
        for _, c in words.chunks(pa.array([text]), words.Powers(), words.SPACE):
            value, at = memo.of(c, score)
            assert value[at, 0].tolist() == [len(w) + 3 for w in text.split()]
    assert asked == [3, 1, 1]


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    p = catalog.QUERIES["op7_language_id"](spark, d).toPandas().merge(table(spark, d, "documents").select("doc_id", "lang").toPandas())
    own = p[p.held_out & p.lang.notna()]
    assert (own.lang == own.lang_pred).mean() > 0.95 and p.score.between(0, 1).all()


def test_language_edge_cases(spark, nasty):
    got = catalog.QUERIES["op7_language_id"](spark, nasty).collect()
    assert len(got) == len(nasty_documents())
    plain = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "word")], "doc_id long, text string")
    none = language.identify(plain, ([], np.empty((0, 0)), np.empty(0))).collect()
    assert [(r["lang_pred"], r["score"]) for r in none] == [("und", 0.0)] * 4
    model = language.train(table(spark, nasty, "documents"), "doc_id", "text", "lang", unigram.VOCABULARY)
    some = {r["doc_id"]: r["lang_pred"] for r in language.identify(plain, model).collect()}
    assert [some[i] for i in (1, 2, 3)] == ["und"] * 3 and some[4] in model[0]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000])
def test_vocabulary_finds_what_it_has(n):
    pieces = [bytes([65 + i % 26, 97 + i // 26]) for i in range(n)]
    v = unigram.Vocabulary(pieces)
    c = unigram._side_by_side([*pieces, b"??"], v.powers)
    got = v.find(c.span_hash(c.off[:-1], c.off[1:]))
    want = {p: i for i, p in enumerate(pieces)}
    assert got.tolist() == [want[p] for p in pieces] + [-1]


def test_counts_of_very_long_pre_tokens():
    """A chain of more than 2**20 single pieces, and a dearer piece that skips one of them."""
    n, zero = (1 << 20) + 3, np.array([0])
    steps = ((np.array([i]), np.array([i - 1]), zero) for i in range(1, n + 1))
    skip = [(np.array([n]), np.array([n - 2]), np.array([1]))]
    trie = SimpleNamespace(n=n + 1, steps=(x for part in (steps, skip) for x in part))
    assert unigram.best_counts(trie, np.array([9000, 18_001]))[-2:].tolist() == [n - 1, n]
