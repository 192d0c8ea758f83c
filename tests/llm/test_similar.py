import random

import numpy as np
import pytest

from nomina.llm import similar as module
from nomina.llm.components import components
from nomina.llm.similar import similar


def brute(texts: dict[int, str]) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j:j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("pairs,progress", [(2, 0.01), (0, 1.1), (0, 1e-9)])
def test_near_copies_against_brute_force(spark, monkeypatch, pairs, progress):
    """Groups of near copies around the threshold; also with one round of pivots, and with
    rounds until none joins anything."""
    monkeypatch.setattr(module, "OPEN_PAIRS", pairs)
    monkeypatch.setattr(module, "PROGRESS", progress)
    r = random.Random(5)
    texts = {}
    for group in range(4):
        base = [f"g{group}w{r.randrange(500)}" for _ in range(100 + 40 * group)]
        for _ in range(25):
            w = list(base)
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            texts[r.randrange(10**6)] = " ".join(w)
    common = " ".join(f"c{i}" for i in range(30))
    for k in range(20):
        texts[10**6 + k] = f"{common} d{k} " + " ".join(f"u{r.randrange(10**5)}" for _ in range(r.randrange(1, 40)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["_id"]: x["component"] for x in similar(docs).collect()}
    assert got == brute(texts)


def test_components_of_a_path_a_hub_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(500, 500), (2000, 1999), (1999, 2000)]
    r = random.Random(1)
    r.shuffle(links)
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(80)}, 1999: 1999, 2000: 1999}


def test_two_thousand_near_misses(spark):
    """Edits of one text, most pairs of which are just below the bound: the components are those
    of all pairs compared."""
    r = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(2000):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3])):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        if i % 5 == 0:
            w += [f"t{r.randrange(40)}" for _ in range(r.randrange(8))]
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[j:j + 4]) for j in range(len(t.split()) - 3)} for _, t in rows]
    index = {g: j for j, g in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(rows), len(index)), np.float32)
    for i, s in enumerate(sets):
        m[i, [index[g] for g in s]] = 1
    both, n = m @ m.T, m.sum(1)
    linked = 100 * both >= 85 * (n[:, None] + n[None, :] - both)
    assert 0.02 < linked.mean() < 0.9
    root = np.arange(len(rows))
    while True:
        new = np.array([root[linked[i]].min() for i in range(len(rows))])
        if (new == root).all():
            break
        root = new
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {x._id: x.component for x in similar(df).collect()}
    assert got == dict(enumerate(root.tolist()))


def test_pairs_of_a_large_group_follow_its_size(spark, monkeypatch):
    """Copies of one text with a few edits each, many of which link to few others: the pairs that
    come out of the joins are fewer than the copies, not near their square."""
    compared, verify = [], module._verify
    monkeypatch.setattr(module, "_verify", lambda pairs, *rest: compared.append(pairs.count()) or verify(pairs, *rest))
    r = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    texts = {0: " ".join(base)}
    for i in range(1, 1200):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 5, 5, 8])):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        texts[i] = " ".join(w)
    # one component around the unchanged text: a copy is linked into it or to nothing
    sets = [{tuple(t.split()[j:j + 4]) for j in range(len(t.split()) - 3)} for t in texts.values()]
    index = {g: j for j, g in enumerate(set().union(*sets))}
    m = np.zeros((len(sets), len(index)), np.float32)
    for i, s in enumerate(sets):
        m[i, [index[g] for g in s]] = 1
    both, n = m @ m.T, m.sum(1)
    linked = (100 * both >= 85 * (n[:, None] + n[None, :] - both)) & ~np.eye(len(sets), dtype=bool)
    want = {i: 0 if linked[0, i] else i for i in texts}
    alone = [i for i in texts if i and want[i]]
    assert not linked[alone].any()
    got = {x["_id"]: x["component"] for x in similar(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)).collect()}
    assert got == want
    assert sum(compared) <= len(texts), compared
