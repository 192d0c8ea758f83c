import random

import numpy as np
import pytest

from nomina.llm import catalog, mix, q_mix
from tests.llm.conftest import nasty_documents


def brute_targets(words: dict, percent=150, most=2, weights=(5, 2, 1)) -> dict:
    names = sorted((s for s in words if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in words)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, capped, left = {}, set(), sum(words.values()) * percent / 100
    while True:
        rest = [s for s in names if s not in capped]
        target |= {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if target[s] > most * words[s]]
        if not over:
            return target
        for s in over:
            target[s] = most * words[s]
            left -= target[s]
            capped.add(s)


@pytest.mark.parametrize("n,inverse", [(1, False), (2, False), (7, False), (1000, False), (1000, True), (4097, True)])
def test_permutations(n, inverse):
    at = np.arange(n)
    p = mix.permute(at, n, 12345)
    assert sorted(p.tolist()) == at.tolist()
    if inverse:
        assert (mix.permute(p, n, 12345, inverse=True) == at).all()
        assert (mix.permute(at, n, 54321) != p).any()


def test_targets(spark):
    r = random.Random(2)
    words = {**{f"s{i}": r.choice([0, 5, 100, 2000, 30_000]) for i in range(25)}, None: 700, "é": 40, "Z": 9}
    want = brute_targets(words)
    got = {x["_src"]: x["target"] for x in mix.targets(spark.createDataFrame(list(words.items()), "_src string, words long")).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_nasty_rows(spark, nasty):
    run = lambda: sorted(map(str, catalog.QUERIES["op8_mix_sources"](spark, nasty).collect()))
    assert run() == run()
    rows = catalog.QUERIES["op8_mix_sources"](spark, nasty).collect()
    size = [len((t or "").encode().split()) for _, t, *_ in nasty_documents()]
    assert sorted(r["size"] for r in rows) == sorted(size) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    words: dict = {}
    for (_, _, _, s, *_), n in zip(nasty_documents(), size, strict=True):
        words[s] = words.get(s, 0) + n
    assert sum(r["taken"] for r in rows) == sum(round(t) for t in brute_targets(words).values())


def test_slots_and_pieces_against_brute_force(spark):
    """Each pass of a source holds its blocks once, in a permutation; the taken words of every
    document follow from the slots."""
    r = random.Random(3)
    docs = [(i, "w " * r.randrange(0, 60), r.choice(["a", "b", None])) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out, pieces = mix.mixture(frame, block=16)
    rows = {x["_row"]: x for x in out.collect()}
    got = pieces.collect()
    taken = dict.fromkeys(rows, 0)
    for p in got:
        taken[p["_row"]] += p["hi"] - p["lo"]
    assert taken == {k: x["taken"] for k, x in rows.items()}
    source = {i: s for i, _, s in docs}
    for s in ("a", "b", None):
        own = [x for x in rows.values() if source[x["_id"]] == s]
        assert sum(x["taken"] for x in own) == round(own[0]["target"])
    at = {x["_row"]: x["at"] for x in mix.stream(frame, "doc_id", "text", "source", ("text",)).collect()}
    filled: dict = {}
    for p in got:
        key = (source[rows[p["_row"]]["_id"]], p["pass"], p["slot"])
        filled.setdefault(key, []).extend(range(at[p["_row"]] + p["lo"], at[p["_row"]] + p["hi"]))
    for (s, e, j), w in filled.items():
        w.sort()
        n = next(x["source_size"] for x in rows.values() if source[x["_id"]] == s)
        key = frame.selectExpr("xxhash64(7, %s, '%s') as k" % (str(s is None).lower(), s or "")).first()["k"]
        block = int(mix.permute(np.array([j]), -(-n // 16), (key + e) & (2**64 - 1))[0])
        assert w == list(range(block * 16, block * 16 + len(w))) and len(w) <= 16


def test_multinomial_counts_by_shard(spark):
    sources = spark.createDataFrame([("a", 40_000, 60_000.0), ("b", 400_000, 100_000.0), ("z", 0, 0.0)], "_src string, words long, target double")
    s = mix.slots(sources, shards=4, seed=1, block=16).toPandas()
    assert s.groupby("_src").n.sum().to_dict() == {"a": 60_000, "b": 100_000}
    assert (s.groupby(["_src", "pass"]).block.nunique() == s.groupby(["_src", "pass"]).size()).all()
    per = s[s._src == "b"].groupby("shard").size()
    assert len(per) == 4 and per.between(1400, 1725).all()


def test_stage_keeps_the_targets_in_whole_documents(spark):
    """Documents of many blocks have about their source's rate; the words of each source come
    near its target all the same, in long documents as in short ones."""
    r = random.Random(4)
    share = {"a": 300_000, "b": 600_000, "c": 1_400_000, "d": 300_000}
    docs, words = [], {}
    for s, n in share.items():
        while words.get(s, 0) < n:
            size = r.choice([r.randrange(1, 200), r.randrange(2000, 5000)])
            docs.append((len(docs), "w " * size, s))
            words[s] = words.get(s, 0) + size
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    sizes = {i: (len(t) // 2, s) for i, t, s in docs}
    target = brute_targets(words)
    got = [x[0] for x in q_mix.stage(spark, frame, "").select("doc_id").collect()]
    for s in share:
        for least, off in ((0, 0.03), (2000, 0.05)):
            own = sum(n for n, t in sizes.values() if t == s and n >= least)
            kept = sum(sizes[i][0] for i in got if sizes[i][1] == s and sizes[i][0] >= least)
            assert abs(kept / own - target[s] / words[s]) < off, (s, least, kept / own, target[s] / words[s])


def test_stage_shares_copies_among_repeated_rows(spark):
    docs = [(1, "w " * 600, "a")] * 5 + [(i, "w " * 300, "a") for i in range(2, 40)] + [(i, "w " * 300, "b") for i in range(40, 400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    taken = sum(x["taken"] for x in mix.mixture(frame, key=("text", "source"))[0].collect() if x["_id"] == 1)
    got = [x[0] for x in q_mix.stage(spark, frame, "").select("doc_id").collect()].count(1)
    assert got in (taken // 600, taken // 600 + 1)
