"""N-gram Jaccard join: rare-first prefix filtering, and the components of its links.

1.  Shingles are counted in ``BUCKETS`` hash buckets (a bounded table, over all texts).
    (bucket count, hash) is one order of all shingles, rare ones first.
2.  A document's prefix is its first n - ceil(t n) + 1 shingles in that order: two sets with
    Jaccard t or more share a prefix shingle.  Equal sets are one class from here on.
3.  Classes meet on prefix shingles that two classes have.  Length, positional and suffix
    filters drop pairs inside the join; the rest are verified on the whole sets, each pair
    once.  The suffix filter bounds the sets' difference from below: both sets are folded
    to SIGNATURE parity bits, and bits that differ come from shingles that only one has.
4.  First every class meets one pivot of each of its prefix shingles: the class with the fewest
    rarer shingles before it, which has the least text of its own and so the most links.  Pairs
    inside a component found so far cannot change the result, so only shingles that still hold
    several components go on, with new pivots: one of the shingle's largest component and
    PIVOTS of others, drawn anew, those with little of their own likelier.  When these hardly join
    components any more, ever more classes outside the largest component are drawn at random,
    GROWTH times as many a round or, where few pairs pass the filters, more; a drawn class has
    met its shingle's others and leaves it, so every open pair is compared in the end.  When
    the open pairs are no more than a few times the rows, all are.  A group of K near copies
    thus costs about K pairs a round, and no link between components is lost.

Edge cases: null, empty or wordless texts have an empty set and link with nothing; texts
with fewer words than a shingle have one; very long texts are a chunk of their own; ties in
the order of shingles go by the hash; equal rows are one class; columns other than the named
ones are not read; tables may be empty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomina.llm import words
from nomina.llm.common import few, keep, map_batches, small
from nomina.llm.components import components
from nomina.llm.decontaminate import bitmap, passes

BUCKETS = 1 << 20
BLOCK = 1 << 10
SIGNATURE = 512
#: Open pairs a prefix row, on average, that are compared without further pivots.
OPEN_PAIRS = 2
#: Components of a shingle from which a pivot is drawn in a round, besides the largest.
PIVOTS = 3
#: Share of the components that a round of PIVOTS must join for another of as many to follow.
PROGRESS = 0.01
#: Times as many classes of a shingle are drawn in a round as in the one before, from then on.
GROWTH = 4


def bucket_counts(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """Documents by bucket of their distinct shingles: BUCKETS counters, whatever the input."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, total = words.Powers(), np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for _, c in words.chunks(batch.column(0), powers, words.SPACE, words.LOWER):
                h = (c.shingles(k)[1] >> np.uint64(44)).astype(np.int64)
                total += np.bincount(h, minlength=BUCKETS).astype(np.uint32)
        yield _blocks(total.reshape(-1, BLOCK), np.arange(BUCKETS // BLOCK))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[block] = total.get(block, 0) + np.frombuffer(part, np.uint32).astype(np.int64)
        if total:
            yield _blocks(np.minimum(np.stack(list(total.values())), 0xFFFFFFFF).astype(np.uint32), np.array(list(total)))

    schema = "block int, part binary"
    parts = map_batches(map_batches(docs.select(F.col(text).alias("_t")), count, schema).repartition("block"), add, schema)
    out = np.zeros((BUCKETS // BLOCK, BLOCK), np.uint32)
    for block, part in parts.collect():  # BUCKETS counters
        out[block] = np.frombuffer(part, np.uint32)
    return out.ravel()


def _blocks(parts: np.ndarray, blocks: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "part"])


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))


def signatures(docs: DataFrame, doc_id: str, text: str, k: int, percent: int, counts: np.ndarray) -> DataFrame:
    """A row a document: _row, _id, _digest, n (shingles), h1 and h2 (hashes of the set),
    prefix (rare first), bits (parities)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, counts = words.Powers(), shared.value
        for batch in batches:
            cols = [[] for _ in range(6)]
            for _, c in words.chunks(batch.column(3), powers, words.SPACE, words.LOWER):
                d, h = c.shingles(k)
                n = np.bincount(d, minlength=c.n)
                begin = np.concatenate([[0], np.cumsum(n)])
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(words.mix(h ^ np.uint64(x)))]) for x in (0x51, 0xA7F3)]
                order = np.lexsort((h, counts[(h >> np.uint64(44)).astype(np.int64)], d))
                length = np.where(n > 0, n + (-percent * n) // 100 + 1, 0)
                rank = np.arange(len(d)) - begin[d]
                odd = np.bincount(d * SIGNATURE + ((h >> np.uint64(35)).astype(np.int64) & (SIGNATURE - 1)), minlength=c.n * SIGNATURE) & 1
                bits = np.packbits(odd.astype(bool), bitorder="little").view(np.int64)
                for col, v in zip(cols, (n, *((s[begin[1:]] - s[begin[:-1]]).view(np.int64) for s in sums), h[order][rank < length[d]].view(np.int64), length, bits), strict=True):
                    col.append(v)
            n, h1, h2, prefix, length, bits = [np.concatenate(x) if x else np.empty(0, np.int64) for x in cols]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n.astype(np.int64)), pa.array(h1), pa.array(h2), _lists(prefix, length),
                                              _lists(bits, np.full(len(n), SIGNATURE // 64))],
                                             names=["_row", "_id", "_digest", "n", "h1", "h2", "prefix", "bits"])

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("_id"),
                       F.xxhash64(F.struct(F.col(text).isNull(), F.col(text))).alias("_digest"), F.col(text).alias("_text"))
    return map_batches(rows, run, f"_row long, _id {dict(rows.dtypes)['_id']}, _digest long, n long, h1 long, h2 long, "
                                "prefix array<long>, bits array<long>")


def shared_grams(nodes: DataFrame) -> DataFrame:
    """(gram, node, n, pos): the prefix shingles that two classes or more have."""
    grams = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "gram"))
    ends = grams.groupBy("gram").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    twice = keep(ends.where("lo <> hi").select("gram"))
    bits = nodes.sparkSession.sparkContext.broadcast(bitmap(twice.select(F.col("gram").alias("fp"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column(2)
            gram = prefix.flatten().to_numpy(zero_copy_only=False)
            count = np.diff(prefix.offsets.to_numpy())
            own = np.repeat(np.arange(len(count)), count)
            pos = np.arange(len(gram)) - np.repeat(np.cumsum(count) - count, count)
            pick = passes(bits.value, gram.view(np.uint64))
            own = pa.array(own[pick])
            yield pa.RecordBatch.from_arrays([pa.array(gram[pick]), batch.column(0).take(own), batch.column(1).take(own), pa.array(pos[pick])],
                                             names=["gram", "node", "n", "pos"])

    some = map_batches(nodes.select("node", "n", "prefix"), run, "gram long, node long, n long, pos long")
    return keep(some.join(twice, "gram"))


def _near(percent: int) -> Column:
    """Length and positional filters of rows x and y of one shingle."""
    rest = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    return ((100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
            & ((100 + percent) * rest >= percent * (F.col("x.n") + F.col("y.n"))))


def _alike(percent: int) -> Column:
    """Suffix filter of rows x and y: the parity bits that differ are few enough."""
    apart = sum((F.bit_count(F.col(f"x.bits{i}").bitwiseXOR(F.col(f"y.bits{i}"))) for i in range(SIGNATURE // 64)), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * (F.col("x.n") + F.col("y.n"))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of distinct pairs, on whole sets."""
    a, b = (sets.select(F.col("node").alias(x), F.col("grams").alias(f"grams_{x}")) for x in "ab")
    linked = (100 + percent) * F.size(F.array_intersect("grams_a", "grams_b")) >= percent * F.col("total")
    return pairs.join(a, "a").join(b, "b").select("a", "b", linked.alias("linked")).distinct()


def link_classes(nodes: DataFrame, sets_of, percent: int) -> DataFrame:
    """(node, root) of the classes that have links.  ``sets_of(nodes)`` gives whole sets."""
    rows = shared_grams(nodes)
    if not (n_rows := rows.count()):
        return rows.select("node", F.col("node").alias("root"))
    rows = few(rows, n_rows)
    bits = few(nodes, 2 * nodes.count()).select("node", "n", *[F.col("bits")[i].alias(f"bits{i}") for i in range(SIGNATURE // 64)])
    tested, roots, turn, joined, pivots, last = None, None, 0, 1.0, 0, False
    while not last:
        live = rows.withColumn("root", F.col("node"))
        if roots is not None:
            live = rows.join(small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
        # few rarer shingles before this one: little of the text is its own, its links are many
        chance = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20)) + 1
        node = F.struct(((F.col("pos") + 1) * (1 if roots is None else chance)).alias("_p"), chance.alias("_h"), "node", "n", "pos", "root")
        per = live.groupBy("gram", "root").agg(F.min(node).alias("p"), F.count(F.lit(1)).alias("c"))
        if roots is not None:
            # shingles that still hold several components, and the pairs between these; of two
            # classes the one pair has been tested
            per = keep(few(per, n_rows))
            of = per.groupBy("gram").agg(F.sum("c").cast("double").alias("c"), F.sum(F.col("c").cast("double") ** 2).alias("own"), F.count(F.lit(1)).alias("k"),
                                         F.max("c").alias("most"), F.max_by("root", F.struct("c", "root")).alias("top"))
            of = of.where("k > 1" if pivots else "k > 1 and c > 2")
            of = keep(few(of.select("gram", "c", ((F.col("c") ** 2 - F.col("own")) / 2).alias("pairs"), "top", (F.col("c") - F.col("most")).alias("others")), n_rows))
            n_open, left = of.agg(F.sum("pairs"), F.sum("c")).first()
            if not n_open:
                break
            grams = small(of.select("gram", "top", "others"))
            live, per, n_rows = keep(few(live.join(grams, "gram"), n_rows)), per.join(grams, "gram", "left_semi"), int(left)
            rows = live.select("gram", "node", "n", "pos")  # the others never count again
            last = n_open <= OPEN_PAIRS * n_rows
            if pivots or joined < PROGRESS:
                # as many as give about a row's worth of survivors, by those of the last round
                pivots = max(pivots, PIVOTS) * max(GROWTH, n_rows // (GROWTH * (n_pairs + 1)) if pivots else 0)
        ids = (F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"))
        if last or pivots:
            # every open pair has a class outside the shingle's largest component: all of these
            # are drawn in the end.  The suffix filter is in the join: only its survivors come out
            part = F.lit(1.0) if last else pivots / F.col("others")
            drawn = (F.col("root") != F.col("top")) & (F.pmod(F.xxhash64("gram", "node", F.lit(turn)), F.lit(1 << 20)) < part * (1 << 20))
            live = keep(few(live.withColumn("drawn", drawn), n_rows))
            rows = live.where(~F.col("drawn")).select("gram", "node", "n", "pos")  # all pairs of the drawn ones are tested now
            wide = live.join(bits.drop("n"), "node")
            x, y = wide.alias("x"), wide.where("drawn").alias("y")
            pairs = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (~F.col("x.drawn") | (F.col("x.node") > F.col("y.node"))) & (F.col("x.root") != F.col("y.root"))
                           & _near(percent) & _alike(percent)).select(*ids).distinct()
        else:
            if roots is None:
                ends = per.groupBy("gram").agg(F.min("p").alias("p"))
            else:
                drawn = Window.partitionBy("gram").orderBy("p")
                ends = per.groupBy("gram").agg(F.max_by("p", F.struct("c", "root")).alias("p")).union(
                    per.withColumn("k", F.row_number().over(drawn)).where(F.col("k") <= PIVOTS).select("gram", "p")).distinct()
            ends = ends.select("gram", "p.node", "p.n", "p.pos", "p.root")
            x, y = live.alias("x"), ends.alias("y")
            pairs = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.root") != F.col("y.root")) & _near(percent)).select(*ids).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = keep(pairs)
        n_pairs = pairs.count()
        if roots is not None and not n_pairs:
            joined, turn = 0.0, turn + 1
            continue
        x, y = bits.alias("x"), bits.alias("y")
        pairs = few(pairs, n_pairs).join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(_alike(percent))
        pairs = keep(few(pairs.select("a", "b", (F.col("x.n") + F.col("y.n")).alias("total")), 4 * n_pairs))
        sets = keep(sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
        new = keep(_verify(few(pairs, n_pairs), sets, percent))
        tested = new if tested is None else tested.union(new)
        links = few(new.where("linked").select("a", "b"), n_pairs)
        before = live.select("root").distinct().count()
        if roots is not None:
            links = links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = keep(components(links))
        after = live.select("node").join(small(roots), "node", "left").select(F.coalesce("root", "node")).distinct().count()
        joined, turn = 1 - after / before, turn + 1
    return roots


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """One row a document: _row, _id, _digest, n_shingles, component (smallest _id reachable
    by links, itself included)."""
    counts = bucket_counts(docs, text, k)
    sigs = keep(signatures(docs, doc_id, text, k, percent, counts))
    full = sigs.where("n > 0")
    nodes = keep(full.groupBy("h1", "h2", "n").agg(F.min("_row").alias("node"), F.min("_id").alias("low"), *[
        F.min_by(c, "_row").alias(c) for c in ("_id", "_digest", "prefix", "bits")]))

    def sets_of(ids: DataFrame) -> DataFrame:
        own = small(keep(nodes.join(ids, "node", "left_semi").select("node", F.col("_id").alias("_i"), F.col("_digest").alias("_d"))))
        d = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(F.struct(F.col(text).isNull(), F.col(text))).alias("_digest"), F.col(text).alias("_text"))
        found = d.join(own, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_digest") == F.col("_d"))).select("node", "_text")
        return map_batches(found, _sets(k), "node long, grams array<long>")

    roots = link_classes(nodes, sets_of, percent)
    lows = nodes.select("h1", "h2", "n", "node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = keep(lows)
    least = lows.groupBy("root").agg(F.min("low").alias("component"))
    named = lows.join(least, "root").select("h1", "h2", "n", "component")
    out = full.select("_row", "_id", "_digest", "n", "h1", "h2").join(named, ["h1", "h2", "n"])
    alone = sigs.where("n = 0").select("_row", "_id", "_digest", "n", F.col("_id").alias("component"))
    return out.select("_row", "_id", "_digest", "n", "component").union(alone).withColumnRenamed("n", "n_shingles")


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = words.Powers()
        for batch in batches:
            grams, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for _, c in words.chunks(batch.column(1), powers, words.SPACE, words.LOWER):
                d, h = c.shingles(k)
                grams.append(h.view(np.int64))
                counts.append(np.bincount(d, minlength=c.n))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(np.concatenate(grams), np.concatenate(counts))], names=["node", "grams"])
    return run
