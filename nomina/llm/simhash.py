"""SimHash near-duplicates by multi-index hashing.

1.  A text's fingerprint: of the XXH64 hashes of its ``k``-word shingles (repeats included), a
    bit is 1 if more than half the hashes have it.  Rows with one fingerprint are one code
    from here on, so copies cost nothing.
2.  A code is cut into two segments of 32 bits.  Codes at 3 bits or fewer differ by at most
    one bit in one of the segments, so one finds the other in that segment's table by looking
    up the ball of radius 1 around its own segment.  Of two segments that differ in one bit,
    the one that has it looks for the one without it, so half the ball will do.
3.  Matches are verified on all 64 bits inside the join.  First each table key's codes meet
    one of them, the one with most rows; codes joined by that need no further comparison.
4.  Where more than ``CROWD`` codes share a segment, the key grows: the other 32 bits are cut
    into halves, one of which is again within one bit of the partner's.  Codes of a grown key
    share 48 bits but for two, so a key has a bounded number of them.

A component is the set of rows reachable by links.

Edge cases: a null, empty or wordless text has fingerprint zero and is linked like any other;
a text with fewer words than a shingle has its whole sequence as one; repeated rows share a
fingerprint, ties in a bit (exactly half) give 0; null ids count in no minimum, and a
component of null ids only has a null name; very long texts are hashed in pieces; columns
other than the named ones are not read; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomina.llm.common import few, keep, small
from nomina.llm.components import components

SEED, BITS, MOST = 42, 64, 3
#: Shingles whose bits are added up at once: 16-bit lanes hold the counts.
PIECE = 1 << 15
#: Codes of one segment value beyond which the key takes in a further 16 bits.
CROWD = 256


def hashes(text: bytes, k: int) -> Iterator[np.ndarray]:
    """Hashes of the ``k``-word shingles of a text, in pieces of PIECE."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return
    k = min(k, len(words))
    line, stop = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate([[0], stop[:-1] + 1])[:len(words) - k + 1].tolist()
    stop = stop[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(start), PIECE):
        yield np.array([digest(line[a:b], SEED) for a, b in zip(start[i:i + PIECE], stop[i:i + PIECE], strict=True)], np.uint64)


def majority(pieces: list[np.ndarray], own: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of each of ``n`` texts; piece i belongs to text ``own[i]``."""
    counts, total = np.zeros((n, BITS), np.int64), np.zeros(n, np.int64)
    if pieces:
        h, size = np.concatenate(pieces), np.array([len(p) for p in pieces])
        begin = np.cumsum(size) - size
        lanes = np.uint64(0x0001000100010001)
        for bit in range(16):
            part = np.add.reduceat((h >> np.uint64(bit)) & lanes, begin)
            for lane in range(4):
                np.add.at(counts[:, bit + 16 * lane], own, ((part >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))
        np.add.at(total, own, size)
    return ((2 * counts > total[:, None]).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(1, dtype=np.uint64)


def fingerprints(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """_id and fp (64 bits as a long), a row a document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, out = batch.column(1), np.zeros(batch.num_rows, np.uint64)
            pieces, own, first, held = [], [], 0, 0
            for i in range(batch.num_rows):
                for piece in hashes((col[i].as_py() or "").encode(), k):
                    pieces.append(piece)
                    own.append(i - first)
                    held += len(piece)
                if held > 1 << 18 or i == batch.num_rows - 1:  # texts until then are done
                    out[first:i + 1] = majority(pieces, np.array(own, np.int64), i + 1 - first)
                    pieces, own, first, held = [], [], i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["_id", "fp"])

    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, fp long")


def _segment(fp: Column, table: int) -> Column:
    """Bits 0-31 (table 0) or 32-63 (table 1)."""
    return F.shiftrightunsigned(fp, 32 * table).bitwiseAND(F.lit(0xFFFFFFFF))


def _ball(value: Column, bits: int, below: bool) -> Column:
    """``value`` and its neighbours at one bit; ``below`` only those with a bit less."""
    near = F.array(value, *[value.bitwiseXOR(F.lit(1 << b)) for b in range(bits)])
    return F.filter(near, lambda x: x <= value) if below else near


def links(codes: DataFrame, n: int, most: int = MOST, crowd: int = CROWD) -> DataFrame:
    """(a, b): links enough to reach every code from every other of its component.  ``codes``:
    fp, rows (how many share it)."""
    fp = F.col("fp")
    close = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= most
    table = codes.select("fp", "rows", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), _segment(fp, t).alias("v")) for t in (0, 1)])).alias("e")).select("fp", "rows", "e.*")
    table = keep(few(table, 2 * n))
    keys = keep(table.groupBy("t", "v").agg(F.max(F.struct("rows", "fp")).alias("top"), F.count(F.lit(1)).alias("c")).where("c > 1").select("t", "v", "c", F.col("top.fp").alias("fp")))
    first = table.alias("x").join(keys.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.v") == F.col("y.v")) & (F.col("x.fp") != F.col("y.fp")) & close)
    first = keep(first.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct())
    roots = components(first)
    known = keep(codes.select("fp").join(small(keep(roots.withColumnRenamed("node", "fp"))), "fp", "left").withColumn("root", F.coalesce("root", "fp")))

    def other(c: str) -> Column:  # the half that is not in the key
        return _segment(F.col(c), 0) * F.col("t") + _segment(F.col(c), 1) * (1 - F.col("t"))

    table = few(known, n).select("fp", "root", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), _segment(fp, t).alias("v")) for t in (0, 1)])).alias("e")).select("fp", "root", "e.*")
    probes = few(known, n).select("fp", "root", F.explode(F.array(F.lit(0), F.lit(1))).alias("t"))
    probes = probes.withColumn("v", F.explode(_ball(F.when(F.col("t") == 0, _segment(fp, 0)).otherwise(_segment(fp, 1)), 32, True)))
    crowded = small(keep(keys.where(F.col("c") > crowd).select("t", "v")))
    # in crowded keys, one half of the other segment is within one bit too
    halves = [F.struct(F.lit(s).alias("s"), F.shiftright(other("fp"), 16 * s).bitwiseAND(F.lit(0xFFFF)).alias("w")) for s in (0, 1)]
    deep = table.join(crowded, ["t", "v"], "left_semi").withColumn("e", F.explode(F.array(*halves))).select("fp", "root", "t", "v", "e.*")
    deep_probes = probes.join(crowded, ["t", "v"], "left_semi").withColumn("e", F.explode(F.array(*halves))).select(
        "fp", "root", "t", "v", "e.s", F.explode(_ball(F.col("e.w"), 16, False)).alias("w"))
    found = None
    for rows, looks, cols in ((table.join(crowded, ["t", "v"], "left_anti"), probes, ("t", "v")), (deep, deep_probes, ("t", "v", "s", "w"))):
        same = F.lit(True)
        for c in cols:
            same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
        # codes equal in the segment find each other twice: the greater one looks
        order = (F.col("x.v") != _own("x.fp", "x.t")) | (F.col("x.fp") > F.col("y.fp"))
        pairs = looks.alias("x").join(rows.alias("y"), same & (F.col("x.root") != F.col("y.root")) & order & close)
        pairs = pairs.select(F.col("x.root").alias("a"), F.col("y.root").alias("b")).distinct()
        found = pairs if found is None else found.union(pairs)
    return first.union(keep(found))


def _own(fp: str, t: str) -> Column:
    return F.when(F.col(t) == 0, _segment(F.col(fp), 0)).otherwise(_segment(F.col(fp), 1))


def near_codes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, most: int = MOST, crowd: int = CROWD) -> DataFrame:
    """One row a document: _id, fp, component (smallest _id reachable, itself included).

    ``most`` is at most 3, which two segments with balls of radius 1 cover."""
    if not 0 <= most <= 3:
        raise ValueError("two segments with balls of radius 1 find codes at 3 bits or fewer")
    rows = keep(fingerprints(docs, doc_id, text, k))
    codes = keep(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("rows"), F.min("_id").alias("low")))
    n = codes.count()
    roots = components(links(codes.select("fp", "rows"), n, most, crowd))
    named = codes.join(small(keep(roots.withColumnRenamed("node", "fp"))), "fp", "left")
    # a code of one row and without links names itself
    named = keep(named.where("rows > 1 or root is not null").withColumn("root", F.coalesce("root", "fp")))
    least = named.groupBy("root").agg(F.min("low").alias("component"))
    named = small(keep(named.join(least, "root").select("fp", "component", F.lit(True).alias("_named"))))
    out = rows.join(named, "fp", "left")
    return out.select("_id", "fp", F.when(F.col("_named"), F.col("component")).otherwise(F.col("_id")).alias("component"))
