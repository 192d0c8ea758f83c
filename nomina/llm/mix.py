"""Mixing sources to target weights, in blocks of a fixed number of words.

The documents of a source, in the order of a hash of their id, are one stream of words, cut
into blocks of ``BLOCK``.  The mix takes a whole number of words from each source (its
target): pass after pass over the stream, the last pass in part.  In pass e, slot j holds
block perm(e, j), a pseudorandom permutation of the block numbers that is computed, not
stored; the last slot is cut to the words still missing.  A source's slots go to output
shards by a multinomial draw, so each shard holds a random share of each source.  Blocks
meet documents by (source, block number).

Everything follows from the seed, the ids, sizes and sources: reruns agree.

Edge cases: a null or empty text has size 0 and is taken 0 times; null is a source of its
own, after all others; a source without words has target 0; repeated rows each take their
own place in the stream; an empty table gives an empty result; a very long document spans as
many blocks as its words need; documents with one hash are ordered by id, size and row;
columns other than the named ones are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nomina.llm.common import keep, small
from nomina.llm.shard import HASH_BITS, hash60

BLOCK = 256
#: Blocks of an output shard, on average.
SHARD_BLOCKS = 4096
#: Documents of a range of hashes, on average, whose sizes one task adds up in order.
BIN_ROWS = 4096
#: Bits of a document's fraction of a copy.
PART_BITS = 30
WEIGHTS = (5, 2, 1)
ROUNDS = 6


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 at ``index``: a Feistel network on the next even
    power of two, walked until it is back below ``n``."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1342543DE82EF95) & (2**64 - 1)) for r in range(ROUNDS)]

    def scramble(x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x + k) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x >> np.uint64(32)) & mask

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        if inverse:
            for k in reversed(keys):
                left, right = right ^ scramble(left, k), left
        else:
            for k in keys:
                left, right = right, left ^ scramble(right, k)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def targets(sources: DataFrame, percent: int = 150, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (_src, words; one row a source) with ``target``: shares of ``percent`` of
    all words by weight, none above ``most`` times its source's words, the excess reshared by
    weight.  Capped sources are those with the least words for their weight."""
    by_name = Window.orderBy(F.col("_src").isNull(), "_src")
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    s = sources.withColumn("_w", w.cast("double")).withColumn("_cap", F.col("words") * F.lit(float(most)))
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_src").isNull(), "_src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("words").over(whole) * percent / 100 - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_level", level).withColumn("_open", F.col("_cap") >= F.col("_w") * F.col("_level"))
    level = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.withColumn("target", F.when(F.col("_cap") <= F.col("_w") * F.coalesce(level, F.lit(0.0)), F.col("_cap"))
                        .otherwise(F.col("_w") * level)).select("_src", "words", "target")


def stream(docs: DataFrame, doc_id: str, text: str, source: str, others: tuple[str, ...]) -> DataFrame:
    """_row, _id, _digest, _src, size and ``at``, the document's first word in its source's
    stream.  Sizes are added up by ranges of the hash first, then within each."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = keep(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("_id"),
                            F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in others]).alias("_digest"),
                            F.col(source).alias("_src"), size.alias("size"), hash60(F.col(doc_id)).alias("_h")))
    bits = (max(1, rows.count()) // BIN_ROWS).bit_length()
    rows = rows.withColumn("_b", F.shiftright("_h", HASH_BITS - bits))
    bins = rows.groupBy("_src", "_b").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("_src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_first", F.coalesce(F.sum("s").over(before), F.lit(0))).select(F.col("_src").alias("_s"), F.col("_b").alias("_bb"), "_first")
    inner = Window.partitionBy("_src", "_b").orderBy("_h", "_id", "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(small(keep(bins), F.col("_s").cast("string")), F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_bb")))
    return rows.select("_row", "_id", "_digest", "_src", "size", (F.col("at") + F.col("_first")).alias("at"))


def slots(sources: DataFrame, shards: int, seed: int, block: int) -> DataFrame:
    """(_src, pass, slot, shard, block, n): every slot of the mix, with the words it takes."""
    n = sources.withColumn("take", F.round("target").cast("long")).withColumn("blocks", F.ceil(F.col("words") / block))
    n = n.where("take > 0").withColumn("_key", F.xxhash64(F.lit(seed), F.col("_src").isNull(), F.coalesce(F.col("_src").cast("string"), F.lit(""))))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for src, words, take, blocks, key in pdf.itertuples(index=False):
                tail = words - (blocks - 1) * block
                for e in range(-(-take // words)):
                    left = min(words, take - e * words)
                    pkey = (int(key) + e) & (2**64 - 1)
                    where = int(permute(np.array([blocks - 1]), blocks, pkey, inverse=True)[0])
                    count = -(-left // block)
                    if where < count:  # the short last block of the stream is among them
                        count = max(where + 1, -(-(left + block - tail) // block))
                    count = min(count, blocks)
                    parts = np.random.Generator(np.random.PCG64([pkey, e])).multinomial(count, np.full(shards, 1 / shards))
                    first = np.cumsum(parts) - parts
                    pick = parts > 0
                    yield pd.DataFrame({"_src": [src] * pick.sum(), "blocks": blocks, "tail": tail, "pkey": int(np.array(pkey, np.uint64).view(np.int64)), "pass": e, "left": left,
                                        "where": where, "shard": np.flatnonzero(pick), "first": first[pick], "n_slots": parts[pick]})

    kind = dict(sources.dtypes)["_src"]
    runs = n.select("_src", "words", "take", "blocks", "_key").mapInPandas(
        draw, f"_src {kind}, blocks long, tail long, pkey long, pass int, left long, where long, shard int, first long, n_slots long")
    # a range of slots a row, small enough for one task, spread over tasks
    step = SHARD_BLOCKS
    runs = runs.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(n_slots - 1) div {step}"))).alias("_k"))
    runs = runs.withColumn("first", F.col("first") + F.col("_k") * step).withColumn("n_slots", F.least(F.lit(step), F.col("n_slots") - F.col("_k") * step))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for src, blocks, tail, pkey, e, left, where, shard, first, count in pdf.itertuples(index=False):
                j = np.arange(first, first + count)
                b = permute(j, blocks, int(pkey) & (2**64 - 1))
                full = np.where(b == blocks - 1, tail, block)
                before = j * block - np.where(j > where, block - tail, 0)
                got = np.clip(left - before, 0, full)
                yield pd.DataFrame({"_src": [src] * count, "pass": e, "slot": j, "shard": shard, "block": b, "n": got})

    # as many tasks as output shards, each with about a shard's slots
    runs = runs.drop("_k").repartition(shards, "_src", "pass", "shard", "first")
    return runs.select("_src", "blocks", "tail", "pkey", "pass", "left", "where", "shard", "first", "n_slots").mapInPandas(
        fill, f"_src {kind}, pass int, slot long, shard int, block long, n long").where("n > 0")


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", percent: int = 150, most: int = 2,
            weights: tuple[int, ...] = WEIGHTS, seed: int = 7, block: int = BLOCK, key: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables.  Documents: _row, _id, _digest, _src, size, source_size, target, taken (words the
    mix takes, repeats counted).  Pieces: shard, pass, slot and for each the words lo..hi of a
    document (_row) that stand there."""
    rows = keep(stream(docs, doc_id, text, source, key or (text,)))
    sizes = rows.groupBy("_src").agg(F.sum("size").alias("words"))
    sources = keep(targets(sizes, percent, most, weights))
    blocks = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0] / block
    taken = slots(sources, int(blocks // SHARD_BLOCKS) + 1, seed, block)
    parts = rows.where("size > 0").select("_row", "_src", "size", "at", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))
    join = F.col("p._src").eqNullSafe(F.col("s._src")) & (F.col("p.block") == F.col("s.block"))
    lo = F.greatest(F.lit(0), F.col("p.block") * block - F.col("at"))
    hi = F.least(F.col("size"), F.col("p.block") * block + F.col("n") - F.col("at"))
    pieces = parts.alias("p").join(taken.alias("s"), join).select("shard", "pass", "slot", "_row", lo.alias("lo"), hi.alias("hi")).where("hi > lo")
    per_doc = pieces.groupBy("_row").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    named = sources.select(F.col("_src").alias("_s"), F.col("words").alias("source_size"), "target")
    out = rows.join(small(named, F.col("_s").cast("string")), F.col("_src").eqNullSafe(F.col("_s"))).join(per_doc, "_row", "left")
    return out.select("_row", "_id", "_digest", "_src", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")), pieces


def whole(out: DataFrame, seed: int = 7) -> DataFrame:
    """The mix in whole documents: _id, _digest, ``n`` rows with this key and ``copies``, the
    times they stand together.  Each has the whole part of taken / size copies; the fractions
    are added up by source, class of size (eight an octave) and hash of the id, and the
    document at which the sum passes a whole number has one more.  A document's copies are
    thus right on average, and those of each class of sizes within one of their sum."""
    rows = keep(out.where("size > 0").groupBy("_src", "_id", "_digest").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.sum("taken").alias("taken"))
                .withColumns({"_f": F.expr(f"((taken % size) << {PART_BITS}) div size"), "_h": hash60(F.col("_id")),
                              "_c": F.expr("length(bin(size)) * 8 + (size << 3 >> length(bin(size)) - 1) % 8")}))
    bits = (rows.count() // (8 * BIN_ROWS)).bit_length()
    rows = rows.withColumn("_b", F.shiftright("_h", HASH_BITS - bits))
    before = Window.partitionBy("_src").orderBy("_c", "_b").rowsBetween(Window.unboundedPreceding, -1)
    # each source starts at a seeded fraction of its own
    start = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("_src").isNull(), F.coalesce(F.col("_src").cast("string"), F.lit(""))), 64 - PART_BITS)
    bins = rows.groupBy("_src", "_c", "_b").agg(F.sum("_f").alias("f"))
    bins = bins.select(F.col("_src").alias("_s"), F.col("_c").alias("_cc"), F.col("_b").alias("_bb"), (F.coalesce(F.sum("f").over(before), F.lit(0)) + start).alias("_first"))
    inner = Window.partitionBy("_src", "_c", "_b").orderBy("_h", "_id", "_digest").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum("_f").over(inner), F.lit(0)))
    same = F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_c") == F.col("_cc")) & (F.col("_b") == F.col("_bb"))
    rows = rows.join(small(keep(bins), F.col("_s").cast("string")), same).withColumn("_at", F.col("_at") + F.col("_first"))
    more = F.shiftright(F.col("_at") + F.col("_f"), PART_BITS) - F.shiftright("_at", PART_BITS)
    return rows.select("_id", "_digest", "n", (F.expr("taken div size") + more).alias("copies")).where("copies > 0")
