"""The pipeline against its parts: SQL for the stages that have it, brute force for the mix."""

import hashlib
import struct
from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from nomina.llm import q_decontaminate, q_mix, q_quality, q_shard, q_similar
from nomina.llm.mix import mixture
from tests.llm.conftest import oracle, rows_of


def _folder(tmp_path, name, docs, spark, sf):
    at = f"{tmp_path}/{name}"
    docs.write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{at}/benchmark.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return at


def _sql(sql, at):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet/*.parquet'")
    return con.execute(sql).df()


def size_class(n: int) -> int:
    """Eight classes an octave."""
    return n.bit_length() * 8 + (n << 3 >> n.bit_length() - 1) % 8


def copies_by_running_sums(plan: list[dict], seed: int = 7, bits: int = 30) -> Counter:
    """Copies of every document, in whole numbers: the fractions of a source's documents are
    added up by size class and hash of the id, and each full one is a copy more."""
    out, rows = Counter(), {}
    for r in plan:
        if r["size"]:
            key = r["_src"], r["_id"], r["_digest"]
            n, taken = rows.get(key, (r["size"], 0))
            rows[key] = n, taken + r["taken"]

    def place(key):
        text = "" if key[1] is None else str(key[1])
        return key[0] or "", size_class(rows[key][0]), int(hashlib.md5(text.encode()).hexdigest()[:15], 16), key[1] or 0, key[2]

    at = {}
    for key in sorted(rows, key=place):
        size, taken = rows[key]
        if key[0] not in at:  # a seeded start for each source: XXH64 of the seed, a null mark and the name
            h = 42
            for part in (struct.pack("<i", seed), struct.pack("<i", key[0] is None), (key[0] or "").encode()):
                h = xxhash.xxh64_intdigest(part, h)
            at[key[0]] = h >> 64 - bits
        before = at[key[0]]
        at[key[0]] += (taken % size << bits) // size
        out[key[1]] += taken // size + (at[key[0]] >> bits) - (before >> bits)
    return out


def test_stages_one_by_one(spark, sf_small, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    cols = docs.columns
    assert [f for _, f in corpus_pipeline.STAGES] == [q_quality.stage, q_similar.stage, q_decontaminate.stage, q_mix.stage, q_shard.stage]

    a = _folder(tmp_path, "a", docs, spark, sf_small)
    kept = q_quality.stage(spark, spark.read.parquet(f"{a}/documents.parquet"), sf_small)
    v = _sql(q_quality.SQL, a)
    assert kept.columns == cols and sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(v[v.kept].doc_id)

    b = _folder(tmp_path, "b", kept, spark, sf_small)
    once = q_similar.stage(spark, spark.read.parquet(f"{b}/documents.parquet"), sf_small)
    v = _sql(q_similar.SQL, b)
    assert once.columns == cols and sorted(r[0] for r in once.select("doc_id").collect()) == sorted(v[(v.doc_id == v.component_id) | (v.n_shingles == 0)].doc_id)

    c = _folder(tmp_path, "c", once, spark, sf_small)
    clean = q_decontaminate.stage(spark, spark.read.parquet(f"{c}/documents.parquet"), sf_small)
    v = _sql(q_decontaminate.SQL, c)
    assert clean.columns == cols and sorted(r[0] for r in clean.select("doc_id").collect()) == sorted(v[~v.contaminated].doc_id)

    d = _folder(tmp_path, "d", clean, spark, sf_small)
    mixed = q_mix.stage(spark, spark.read.parquet(f"{d}/documents.parquet"), sf_small)
    plan = [r.asDict() for r in mixture(spark.read.parquet(f"{d}/documents.parquet"), key=("text", "source"))[0].collect()]
    times = copies_by_running_sums(plan)
    got = mixed.select("doc_id", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("size"), "source").collect()
    assert mixed.columns == cols and Counter(r[0] for r in got) == +times
    for source in {r["_src"] for r in plan}:
        own = [r for r in plan if r["_src"] == source and r["size"]]
        most = {}  # of each class of sizes the sum is right but for one document
        for r in own:
            most[size_class(r["size"])] = max(most.get(size_class(r["size"]), 0), r["size"])
        assert abs(sum(r.size for r in got if r.source == source) - own[0]["target"]) <= sum(most.values()) + 1

    e = _folder(tmp_path, "e", mixed, spark, sf_small)
    last = q_shard.stage(spark, spark.read.parquet(f"{e}/documents.parquet"), sf_small)
    v = _sql(q_shard.SQL, e)
    assert rows_of(last.select(*v.columns).toPandas()) == rows_of(v)
    run = corpus_pipeline.run(spark, sf_small)
    assert run.columns == last.columns and rows_of(run.select(*v.columns).toPandas()) == rows_of(v)


def test_nasty_rows_and_empty_tables(spark, nasty, empty):
    """Every stage on the bad rows: what goes and what stays."""
    docs = spark.read.parquet(f"{nasty}/documents.parquet")
    total = docs.count()
    for stage, sql, keeps in ((q_quality.stage, q_quality.SQL, lambda v: v.kept), (q_decontaminate.stage, q_decontaminate.SQL, lambda v: ~v.contaminated)):
        v = oracle(sql, nasty)
        got = stage(spark, docs, nasty)
        assert got.columns == docs.columns and sorted(str(r[0]) for r in got.collect()) == sorted(str(None if pd.isna(x) else int(x)) for x in v[keeps(v)].doc_id)
    out = q_shard.stage(spark, docs, nasty).collect()
    assert len(out) == total and {r["shard"] for r in out} <= set(range(16))
    sizes = [len((r["text"] or "").encode()) + 1 for r in docs.collect()]
    assert sorted(r["size"] for r in out) == sorted(sizes)
    mixed = q_mix.stage(spark, docs, nasty)
    assert mixed.columns == docs.columns and not [r for r in mixed.collect() if not (r["text"] or "").split()]
    last = corpus_pipeline.run(spark, nasty).collect()
    kept = {(str(r[0]), r[1]) for r in q_quality.stage(spark, docs, nasty).select("doc_id", "text").collect()}
    assert last and {(str(r["doc_id"]), r["text"]) for r in last} <= kept
    per = {}
    for r in last:
        per.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in per.values())
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_repeated_rows_stay_once_after_the_join(spark, nasty):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None), (1, "A b c d e f"), (None, "z")], "doc_id long, text string")
    got = sorted((str(r[0]), str(r[1])) for r in q_similar.stage(spark, docs, nasty).collect())
    assert len([x for x in got if x[0] == "1"]) == 1 and got.count(("3", "None")) == 2 and ("None", "z") in got and not [x for x in got if x[0] == "2"]
