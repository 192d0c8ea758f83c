"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by (hash of the text, hash of the id), so equal texts lie together.
Shard limits are found by counting: each round sums the exact bytes in 4,096 probes of the
intervals that still hold a limit, and narrows those intervals.  Only these sums reach the
driver (15 x 4,096 rows at most for 16 shards).  Then every row knows its shard, and one
exchange brings the rows to their place.

The law is ``bytes``.  A group of equal texts of at most ``tolerance`` of a shard's share
goes whole to the shard that its middle byte falls in; a larger group, such as a third of
all rows, is cut between its rows by the same rule.

Within a shard rows are numbered without gaps in the order (hash bin, text hash, id hash,
id); a bin of more than ``BIN_ROWS`` rows is first split by the id's hash, so that no task
sorts a hot group whole.

Edge cases: a null text counts as empty (size 1, CRC 0), a null id as the empty string;
repeated rows share a key and a shard, each with a slot of its own; an empty table gives an
empty result; a very long text is one row like any other; rows equal in all keys are numbered
in any order; other columns pass through unless they have one of the result's names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomina.llm.common import keep, small

PROBE_BITS = 12
HASH_BITS = 60
BIN_ROWS = 4096
G, R, SIZE = "__g", "__r", "__size"


def hash60(c: Column) -> Column:
    """First 60 bits of the MD5 of a string, as a whole number."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def with_keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.withColumns({G: hash60(F.col(text)), R: hash60(F.col(doc_id)),
                             SIZE: F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 1})


def _probe(rows: DataFrame, spans: list[tuple[int, int, int | None]]) -> dict[int, list]:
    """For each span (lo, hi, group or None): its probes in order, each with bytes, and the
    least and greatest text and id hash.  Spans are on the text's hash, or within a group on
    the id's."""
    which, probe = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (lo, hi, group) in enumerate(spans):
        key = F.col(G) if group is None else F.col(R)
        inside = key.between(lo, hi) if group is None else (F.col(G) == group) & key.between(lo, hi)
        shift = max(0, (hi - lo).bit_length() - PROBE_BITS)
        which = F.when(inside, i).otherwise(which)
        probe = F.when(inside, F.shiftright(key - lo, shift)).otherwise(probe)
    sums = (rows.select(which.alias("i"), probe.alias("p"), SIZE, G, R).where("i is not null").groupBy("i", "p")
            .agg(F.sum(SIZE).alias("bytes"), F.min(G).alias("g0"), F.max(G).alias("g1"), F.min(R).alias("r0"), F.max(R).alias("r1")))
    out: dict[int, list] = {i: [] for i in range(len(spans))}
    for row in sorted(sums.collect(), key=lambda x: x["p"]):
        out[row["i"]].append(row)
    return out


def splitters(rows: DataFrame, shards: int, tolerance_percent: int = 1) -> list[tuple[int, int]]:
    """The first key (text hash, id hash) of each shard but the first."""
    total = rows.agg(F.sum(SIZE)).first()[0]
    if not total:
        return []
    after_group = 1 << HASH_BITS
    open_ = {i: ((0, (1 << HASH_BITS) - 1, None), 0) for i in range(1, shards)}
    found: dict[int, tuple[int, int]] = {}
    while open_:
        spans = list(dict.fromkeys(s for s, _ in open_.values()))
        probes = dict(zip(spans, _probe(rows, spans).values(), strict=True))
        nxt = {}
        for i, (span, before) in open_.items():
            last = None
            for x in probes[span]:
                b, one = x["bytes"], x["g0"] == x["g1"] if span[2] is None else x["r0"] == x["r1"]
                reached = (before + b) * shards >= total * i
                middle = (2 * before + b) * shards >= 2 * total * i
                if span[2] is not None and one:  # a row, or rows of one id, of a large group
                    if middle:
                        found[i] = (span[2], x["r0"])
                elif span[2] is None and one and (b * shards * 100 <= tolerance_percent * total or x["r0"] == x["r1"]):
                    if middle:
                        found[i] = (x["g0"], -1)
                elif reached:
                    nxt[i] = ((x["g0"], x["g1"], None) if not one and span[2] is None
                              else (x["r0"], x["r1"], x["g0"] if span[2] is None else span[2]), before)
                if i in found or i in nxt:
                    break
                before, last = before + b, x
            else:  # the limit is at the span's end: the next key, whatever it is
                found[i] = (last["g1"], after_group if span[2] is None else last["r1"] + 1)
        open_ = nxt
    return [found[i] for i in sorted(found)]


def shard_of(cuts: list[tuple[int, int]]) -> Column:
    out = F.lit(0)
    for g, r in cuts:
        out = out + ((F.col(G) > g) | ((F.col(G) == g) & (F.col(R) >= r))).cast("int")
    return out


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 16, tolerance_percent: int = 1) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    docs = docs.select([c for c in docs.columns if c.lower() not in new])
    keys = keep(with_keys(docs, doc_id, text).select(G, R, SIZE))
    cuts = splitters(keys, shards, tolerance_percent)
    bits = max(0, (max(1, keys.count()) // BIN_ROWS).bit_length())
    place = {"shard": shard_of(cuts), "__b": F.shiftright(G, HASH_BITS - bits)}
    bins = keep(keys.withColumns(place).groupBy("shard", "__b").agg(F.count(F.lit(1)).alias("c")))
    deep = F.greatest(F.lit(0), F.ceil(F.log2(F.col("c") / BIN_ROWS))).cast("int")
    bins = bins.select("shard", "__b", deep.alias("__deep"))

    def binned(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns(place).join(small(bins), ["shard", "__b"])
        return rows.withColumn("__d", F.expr(f"shiftright({R}, {HASH_BITS} - __deep)"))

    counts = binned(keys).groupBy("shard", "__b", "__d").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("shard").orderBy("__b", "__d").rowsBetween(Window.unboundedPreceding, -1)
    first = keep(counts.withColumn("__first", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c"))
    order = Window.partitionBy("shard", "__b", "__d").orderBy(G, R, doc_id)
    out = binned(with_keys(docs, doc_id, text).withColumn("text_crc32", F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    out = out.join(small(first), ["shard", "__b", "__d"]).withColumn("slot", F.col("__first") + F.row_number().over(order) - 1)
    return out.select(*docs.columns, F.col(SIZE).alias("size"), "text_crc32", F.lit("bytes").alias("law"),
                      F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
