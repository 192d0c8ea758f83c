import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nomina.llm import catalog, toxicity, words
from nomina.llm.common import held_out, table
from tests.llm.conftest import nasty_documents


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    p = catalog.QUERIES["op9_toxicity"](spark, d).toPandas().merge(table(spark, d, "labels").select("doc_id", "toxic").toPandas())
    own = p[p.held_out]
    rank = own.score.rank().to_numpy()
    hot = own.toxic.to_numpy() == 1
    auc = (rank[hot].sum() - hot.sum() * (hot.sum() + 1) / 2) / (hot.sum() * (~hot).sum())
    assert auc > 0.85 and (own.predicted == own.toxic).mean() > 0.9 and p.score.between(0, 1).all()


def _dense(index) -> np.ndarray:
    out = np.zeros((len(index.ids), len(index.terms)))
    entry = np.repeat(np.arange(len(index.block)), np.diff(index.by_block))
    term = np.repeat(np.arange(len(index.terms)), np.diff(index.by_term))
    out[index.example, term[entry]] = index.weight
    own = np.flatnonzero(index.row >= 0)
    out[:, own] = index.rows[index.row[own]].T
    return out


def _check(index, dense, texts, but=None):
    doc = np.repeat(np.arange(len(texts)), [len(t) for t, _ in texts])
    term, w = (np.concatenate(x) for x in zip(*texts, strict=True))
    got = index.nearest(doc, term, w, len(texts), but)
    for i, (t, x) in enumerate(texts):
        cosine = np.round(dense[:, t] @ x, 12)
        if but is not None:
            cosine[but[i]] = 0
        want = [e for e in np.lexsort((np.arange(len(cosine)), -cosine))[:toxicity.NEIGHBOURS] if cosine[e] > 0]
        e, c = got[i]
        assert len(e) == len(want) and np.allclose(c, cosine[want], atol=1e-9) and np.allclose(cosine[e], cosine[want], atol=1e-9)


def test_neighbours_are_exact(spark):
    """Block-max search of whole texts against the cosines with all examples, over all terms."""
    d = "/root/testdata/sf0.01"
    index = toxicity.fit(table(spark, d, "documents"), table(spark, d, "labels").where(~held_out("doc_id")))
    assert len(index.ids) > 100 and len(index.terms) > 10_000
    dense = _dense(index)
    texts = [r[0] for r in table(spark, d, "documents").where("length(text) < 3000").select("text").limit(60).collect()]
    (_, c), = words.chunks(pa.array(texts), words.Powers(), words.NON_ALNUM, words.LOWER, 1 << 24)
    doc, term, w = index.vectors(c)
    cut = np.searchsorted(doc, np.arange(c.n + 1))
    _check(index, dense, [(term[a:b], w[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)])
    assert np.allclose((dense ** 2).sum(1), 1)


@pytest.mark.parametrize("terms,dense", [(30, 8), (30, 1000), (30, 1), (300, 8)])
def test_many_blocks_are_exact(monkeypatch, terms, dense):
    """With all lists as rows, with none and with some."""
    monkeypatch.setattr(toxicity, "DENSE", dense)
    r = np.random.default_rng(1)
    n = 1000
    vectors = []
    for _ in range(n):
        t = np.sort(r.choice(terms, r.integers(1, 5), replace=False))
        w = r.random(len(t))
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = toxicity._bare(np.arange(terms).astype(np.uint64), np.ones(terms), n)
    vectors = toxicity._fill(index, np.arange(n), (r.random(n) < 0.3).astype(int), np.ones(n), vectors)
    _check(index, _dense(index), vectors[:80], np.arange(80))
    _check(index, _dense(index), vectors[500:540])


def test_a_text_that_shares_any_term_has_neighbours(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").where(~held_out("doc_id"))
    own = docs.join(labels, "doc_id").select("text").limit(3).collect()
    index = toxicity.fit(docs, labels)
    some = [r[0].split()[0] for r in own if r[0] and r[0].split()]
    rows = spark.createDataFrame([(i, f"{t} qqqqzzzz") for i, t in enumerate(some)] + [(99, "qqqqzzzz"), (100, None)], "doc_id long, text string")
    got = {r.doc_id: r.evidence for r in toxicity.toxicity(rows, index).collect()}
    assert all(len(got[i]) > 0 for i in range(len(some))) and got[99] == [] and got[100] == []


def test_one_of_several_texts_of_an_id_is_learned_from(spark):
    docs = spark.createDataFrame([(i % 7, f"word{i % 11} text{i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, toxic int")
    a, b = (toxicity.fit(x, labels) for x in (docs, docs.repartition(5).orderBy(F.desc("text"))))
    assert a.ids.tolist() == b.ids.tolist() and np.allclose(_dense(a), _dense(b))


def test_nasty_rows_and_no_labels(spark, nasty):
    got = catalog.QUERIES["op9_toxicity"](spark, nasty).collect()
    assert len(got) == len(nasty_documents()) and all(0 <= r["score"] <= 1 for r in got)
    docs = table(spark, nasty, "documents")
    none = toxicity.toxicity(docs, toxicity.fit(docs, table(spark, nasty, "labels").limit(0))).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}
