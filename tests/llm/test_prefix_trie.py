"""List ranking and the prefix trie against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

from nomina.llm import prefix_trie as trie
from nomina.llm.list_rank import list_rank, runs, sums_along
from nomina.llm.q_conversations import op13_prefix_trie, rebuilt
from tests.llm.conftest import nasty_conversations


def brute(rows: list[tuple]) -> dict[tuple, tuple]:
    """Nodes as (conv_id, depth) -> the other columns, from lists in memory."""
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        paths[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    out = {}
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        kids = {q for q in below if len(q) == len(p) + 1}
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[:len(q)] == q for x in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode().split()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p))
        out[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def found(df) -> dict[tuple, tuple]:
    rows = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    out = {r[:2]: r[2:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_trie_against_brute_force(spark, nasty):
    assert found(op13_prefix_trie(spark, nasty)) == brute(nasty_conversations())


def test_bins_of_long_conversations_and_of_many_siblings(spark, nasty, monkeypatch):
    """The same with bins of two turns, four siblings and list groups of eight arcs."""
    monkeypatch.setattr(trie, "PLACE_BITS", 1)
    monkeypatch.setattr(trie, "SIBLING_BITS", 2)
    out = trie.prefix_trie(*rebuilt(spark.read.parquet(f"{nasty}/conversations.parquet")), group=64).toPandas()
    want = brute(nasty_conversations())
    assert {(r.conv, r.depth): (r.n_convs, r.n_children, r.n_leaves, r.saved, r.ends_sha256) for r in out.itertuples()} == {k: v[1:] for k, v in want.items()}
    # the arcs are nested and dense
    assert sorted([*out.enter, *out.exit]) == list(range(2 * len(out)))
    at = {(r.conv, r.depth): (r.enter, r.exit) for r in out.itertuples()}
    for (c, d), (a, b) in at.items():
        if d:
            up = at[want[c, d][0], d - 1]
            assert up[0] < a < b < up[1]


def test_list_ranking_of_any_order(spark):
    r = random.Random(1)
    for order in (list(range(3000)), r.sample(range(3000), 3000)):
        rows = [(a, b) for a, b in zip(order, [*order[1:], -1], strict=True)]
        arcs = spark.createDataFrame(r.sample(rows, len(rows)), "arc long, succ long")
        got = {x.arc: x.pos for x in list_rank(arcs, 3000, group=100, last=200).collect()}
        assert got == {a: i for i, a in enumerate(order)}
    none = spark.createDataFrame([], "arc long, succ long")
    assert list_rank(none, 1).collect() == []


def test_runs_of_one_group():
    import pandas as pd

    got = runs(pd.DataFrame({"arc": [5, 1, 9], "succ": [1, 7, -1], "n": [2, 3, 4]})).set_index("arc")
    assert got.loc[5].tolist() == [5, 0, True, 7, 5] and got.loc[1].tolist()[:3] == [5, 2, False] and got.loc[9].tolist() == [9, 0, True, -1, 4]


def test_sums_along_groups(spark):
    rows = spark.range(50).selectExpr("id as pos", "id * id as v")
    got = {r.pos: r.v for r in sums_along(rows, "pos", ["v"], group=7).collect()}
    assert got == {i: sum(j * j for j in range(i + 1)) for i in range(50)}


def test_one_common_conversation(spark):
    """Hundreds of equal conversations: one chain of nodes, all of them ending at its last."""
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 400) for t in range(4)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = trie.prefix_trie(*rebuilt(d)).toPandas().sort_values("depth")
    ends = hashlib.sha256(",".join(map(str, range(400))).encode()).hexdigest()
    assert out.n_convs.tolist() == [400] * 5 and out.ends_sha256.iloc[-1] == ends and out.saved.iloc[0] == 4 * 2 * 399
