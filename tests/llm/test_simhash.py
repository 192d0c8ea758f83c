"""SimHash fingerprints and components against plain Python."""

import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from nomina.llm.components import components
from nomina.llm.q_simhash import op11_simhash
from nomina.llm.simhash import hashes, links, majority, near_codes
from tests.llm.conftest import nasty_documents


def fingerprint(text) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(codes: list[int], most: int = 3) -> list[int]:
    """The smallest index reachable from each code."""
    c = np.array(codes, np.uint64)
    root = np.arange(len(c))
    while True:
        new = np.array([root[np.bitwise_count(c ^ x) <= most].min() for x in c])
        if (new == root).all():
            return root.tolist()
        root = new


def brute(rows: list[tuple]) -> list[tuple]:
    codes = [fingerprint(r[1]) for r in rows]
    g = groups(codes)
    low = {k: min((r[0] for r, x in zip(rows, g, strict=True) if x == k and r[0] is not None), default=None) for k in set(g)}
    return sorted(((r[0], f"{c:016x}", low[k]) for r, c, k in zip(rows, codes, g, strict=True)), key=str)


def plain(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_nasty_rows(spark, nasty):
    assert plain(op11_simhash(spark, nasty)) == brute(nasty_documents())


def test_driver_rows(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    assert plain(op11_simhash(spark, sf_small)) == brute(rows)


def test_spark_has_the_same_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == int(next(hashes(b"A  b\nC", 3))[0])


def test_majority_over_pieces():
    r = np.random.default_rng(3)
    pieces = [r.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1) for n in (1, 40_000 % 32768, 32768, 2)]
    got = majority(pieces, np.array([0, 2, 2, 3]), 5)
    for i, h in ((0, pieces[0]), (2, np.concatenate(pieces[1:3])), (3, pieces[3])):
        assert int(got[i]) == sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    assert got[1] == got[4] == 0


@pytest.mark.parametrize("crowd", [256, 4])
def test_links_of_crowded_codes(spark, crowd):
    """Codes around few centres, many of them in one segment value: no link between components
    is lost, with short keys and with grown ones."""
    r = random.Random(crowd)
    centres = [r.getrandbits(64) for _ in range(6)]
    codes = {0, 2**64 - 1}
    for c in centres:
        for _ in range(120):
            x = c
            for b in r.sample(range(64), r.randrange(7)):
                x ^= 1 << b
            codes.add(x)
        codes |= {c ^ (r.getrandbits(16) << 3) for _ in range(60)}  # one half equal
    codes = sorted(codes)
    want = groups(codes)
    signed = [c - 2**64 if c >= 2**63 else c for c in codes]
    df = spark.createDataFrame([(c, 1 + i % 3) for i, c in enumerate(signed)], "fp long, rows long")
    found = {x.node: x.root for x in components(links(df, len(codes), crowd=crowd)).collect()}
    root = [found.get(c, c) for c in signed]
    assert pd.Series(root).groupby(want).nunique().max() == 1 and len(set(root)) == len(set(want))


def test_other_columns_empty_and_wrong_bound(spark):
    d = spark.createDataFrame([(1, "a b c d", 9), (2, None, 9), (3, "A b  c d", 9)], "k long, t string, fp long")
    assert {(x._id, x.component) for x in near_codes(d, "k", "t").collect()} == {(1, 1), (2, 2), (3, 1)}
    assert near_codes(d.where("k > 5"), "k", "t").collect() == []
    with pytest.raises(ValueError):
        near_codes(d, "k", "t", most=4)
