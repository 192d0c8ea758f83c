"""The trie of all prefixes of conversations, with sums over subtrees by an Euler tour.

1.  A prefix is known by the exclusive or of 128-bit hashes of its turns and their places, so
    prefixes of one conversation are running sums and long conversations split into bins.
2.  A node is a distinct prefix.  The nodes that share a smallest member form a chain
    downwards; nodes are numbered chain by chain, so a node's number is the first of its
    chain plus a depth, and most tree neighbours are neighbours in number.
3.  Every node has an arc in and an arc out.  The arc in is followed by the arc into its
    first child (or its own arc out), the arc out by the arc into its next sibling (or its
    parent's arc out).  ``list_rank`` finds each arc's place in that tour.
4.  What a subtree holds is the running sum at the arc out less that before the arc in.

Edge cases: rows with a null conversation id belong to none and go; a null role or text
counts as empty; turns with the same number are ordered by role, then by the MD5 of the
text; repeated rows are turns of their own; very long texts enter as digest and word count;
columns other than the named ones are not read; an empty table has no node, not even a root."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomina.llm.common import keep, small
from nomina.llm.list_rank import list_rank, sums_along

#: Bits of turn numbers and depths within one bin of a conversation, and of node numbers in one bin of siblings.
PLACE_BITS, SIBLING_BITS = 10, 13
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _binned(df: DataFrame, by: str, order: Column, value: dict[str, tuple], bins: DataFrame) -> DataFrame:
    """Running values within (``by``, _bin), plus those of the bins before (``bins``: by, _bin
    and the values).  Only conversations of several bins are joined."""
    before = Window.partitionBy(by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = bins.select(F.col(by).alias("_by"), F.col("_bin").alias("_b"), *[agg(c).over(before).alias(f"_{c}") for c, (agg, _) in value.items()])
    sums = sums.where(" or ".join(f"_{c} is not null" for c in value))
    joined = df.join(sums, (F.col(by) == F.col("_by")) & (F.col("_bin") == F.col("_b")), "left")
    return joined.withColumns({c: add(F.col(c), F.coalesce(F.col(f"_{c}"), F.lit(0))) for c, (_, add) in value.items()}).drop(
        "_by", "_b", "_bin", *[f"_{c}" for c in value])


def ordered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, i (place of the turn in its conversation, from 1), a and b (hashes of role and
    text), words."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("_turn"), r.alias("_role"), F.md5(t.cast("binary")).alias("_md5"),
        F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    rows = rows.withColumn("_bin", F.coalesce(F.shiftright(F.col("_turn").cast("long"), PLACE_BITS), F.lit(-(1 << 62))))
    rows = keep(rows.withColumns({"a": F.xxhash64(F.lit(1), "_role", "_md5"), "b": F.xxhash64(F.lit(2), "_role", "_md5")}))
    inner = Window.partitionBy("conv", "_bin").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_md5")
    bins = rows.groupBy("conv", "_bin").agg(F.count(F.lit(1)).alias("i"))
    rows = rows.withColumn("i", F.row_number().over(inner).cast("long"))
    return _binned(rows, "conv", inner, {"i": (F.sum, lambda x, y: x + y)}, bins).select("conv", "i", "a", "b", "words")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth, words, k1 and k2 (key of the prefix that ends here), p1 and p2 (its
    parent's) from conv, depth (dense, from 1), a, b, words."""
    rows = turns.withColumns({f"h{j}": F.xxhash64(F.lit(j), "depth", "a", "b") for j in (1, 2)}).withColumn("_bin", F.shiftright("depth", PLACE_BITS))
    rows = keep(rows.select("conv", "depth", "words", "h1", "h2", "_bin"))
    inner = Window.partitionBy("conv", "_bin").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    bins = rows.groupBy("conv", "_bin").agg(F.bit_xor("h1").alias("k1"), F.bit_xor("h2").alias("k2"))
    rows = rows.withColumns({f"k{j}": F.bit_xor(f"h{j}").over(inner) for j in (1, 2)})
    rows = _binned(rows, "conv", inner, {c: (F.bit_xor, lambda x, y: x.bitwiseXOR(y)) for c in ("k1", "k2")}, bins)
    return rows.select("conv", "depth", "words", "k1", "k2", *[F.col(f"k{j}").bitwiseXOR(F.col(f"h{j}")).alias(f"p{j}") for j in (1, 2)])


def prefix_trie(turns: DataFrame, convs: DataFrame, group: int | None = None) -> DataFrame:
    """One row a node: node (number), conv (smallest member), depth, parent_conv, n_convs,
    n_children, n_leaves, saved, ends_sha256, enter and exit (places of its arcs in the tour).

    ``turns``: conv, depth, a, b, words; ``convs``: conv, every conversation once.  ``saved``
    sums (n_convs - 1) x words over the subtree.  ``group`` bounds the groups of the list
    ranking (for tests)."""
    size = {"group": group, "last": group} if group else {}
    rows = keep(prefixes(turns))
    root, n_convs = convs.agg(F.min("conv"), F.count(F.lit(1))).first()
    zero = F.lit(0).cast("long")
    nodes = rows.groupBy("depth", "k1", "k2").agg(*[F.min(c).alias(c) for c in ("conv", "p1", "p2", "words")], F.count(F.lit(1)).alias("n_convs"))
    nodes = keep(nodes)
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("_up"))
    below = nodes.where("depth > 1").select("depth", "p1", "p2", "conv", "words", "n_convs").join(up, ["depth", "p1", "p2"])
    top = nodes.where("depth = 1").withColumn("_up", F.lit(root).cast("long"))
    cols = ("conv", "depth", F.col("_up").alias("parent_conv"), "n_convs", "words")
    first = convs.sparkSession.createDataFrame([(root, 0, None, n_convs, 0)] if n_convs else [], "conv long, depth long, parent_conv long, n_convs long, words long")
    nodes = keep(below.select(*cols).union(top.select(*cols)).union(first))

    # chains: the nodes of one smallest member; numbers follow (conv, depth)
    chains = nodes.groupBy("conv").agg(F.min("depth").alias("_d1"), F.count(F.lit(1)).alias("_n"), F.min_by("parent_conv", "depth").alias("_up"))
    chains = keep(chains.repartitionByRange("conv").withColumn("_p", F.spark_partition_id()))
    inner = Window.partitionBy("_p").orderBy("conv").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = chains.groupBy(F.col("_p").alias("_q")).agg(F.sum("_n").alias("_s")).select("_q", F.coalesce(F.sum("_s").over(before), zero).alias("_off"))
    chains = chains.withColumn("_at", F.coalesce(F.sum("_n").over(inner), zero)).join(F.broadcast(keep(offsets)), F.col("_p") == F.col("_q"))
    chains = keep(chains.select("conv", "_d1", "_n", "_up", (F.col("_at") + F.col("_off")).alias("_first")))
    known = small(chains).alias("c")
    nodes = keep(nodes.alias("n").join(known, "conv").select(
        (F.col("_first") + F.col("depth") - F.col("_d1")).alias("node"), "conv", "depth", "parent_conv", "n_convs", "words",
        (F.col("depth") == F.col("_d1")).alias("_is_top"), (F.col("depth") == F.col("_d1") + F.col("_n") - 1).alias("_is_end")))
    span = 2 * nodes.count()

    # tops of chains hang below nodes of other chains, in the order of their numbers
    above = small(chains.select(F.col("conv").alias("_up"), F.col("_d1").alias("_ud"), F.col("_first").alias("_uf")))
    tops = chains.where("_up is not null").join(above, "_up").select(F.col("_first").alias("_t"), (F.col("_uf") + F.col("_d1") - 1 - F.col("_ud")).alias("_u"))
    tops = keep(tops.withColumn("_bin", F.shiftright("_t", SIBLING_BITS)))
    bins = tops.groupBy("_u", "_bin").agg(F.min("_t").alias("_m"), F.max("_t").alias("_t"))
    later = bins.select("_u", "_t", F.lead("_m").over(Window.partitionBy("_u").orderBy("_bin")).alias("_later"))
    following = tops.withColumn("_next", F.lead("_t").over(Window.partitionBy("_u", "_bin").orderBy("_t"))).join(later, ["_u", "_t"], "left")
    none = F.lit(None).cast("long")
    kids = keep(tops.groupBy("_u").agg(F.min("_t").alias("_kid"), F.count(F.lit(1)).alias("_kids")))
    facts = following.select(F.col("_t").alias("node"), none.alias("_kid"), none.alias("_kids"), none.alias("_side"), F.coalesce("_next", "_later").alias("_next"), F.col("_u").alias("_u"))
    facts = facts.union(kids.select("_u", "_kid", "_kids", none, none, none)).union(kids.select(F.col("_u") + 1, none, none, "_kid", none, none))
    facts = facts.groupBy("node").agg(*[F.max(c).alias(c) for c in ("_kid", "_kids", "_side", "_next", "_u")])
    nodes = nodes.join(facts, "node", "left").withColumn("n_children", F.coalesce("_kids", zero) + F.when(F.col("_is_end"), 0).otherwise(1))
    nodes = keep(nodes)
    into, out = F.col("node") * 2, F.col("node") * 2 + 1
    after_in = F.when(~F.col("_is_end"), into + 2).when(F.col("_kid").isNotNull(), F.col("_kid") * 2).otherwise(out)
    sibling = F.when(F.col("_is_top"), F.col("_next")).otherwise(F.col("_side"))
    parent = F.when(F.col("_is_top"), F.col("_u")).otherwise(F.col("node") - 1)
    after_out = F.coalesce(sibling * 2, F.when(F.col("depth") == 0, F.lit(-1).cast("long")).otherwise(parent * 2 + 1))
    arcs = nodes.select(F.explode(F.array(F.struct(into.alias("arc"), after_in.alias("succ")), F.struct(out.alias("arc"), after_out.alias("succ")))).alias("e")).select("e.*")

    # places in the tour, and what lies between a node's two
    tour = keep(list_rank(arcs, span, **size))
    own = nodes.select("node", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("save"))
    tour = tour.select(F.expr("arc div 2").alias("node"), (F.col("arc") % 2 == 0).alias("_in"), "pos").join(own, "node")
    tour = tour.withColumns({c: F.when(F.col("_in"), F.col(c)).otherwise(0) for c in ("leaf", "save")}).withColumns({"own_leaf": F.col("leaf"), "own_save": F.col("save")})
    tour = sums_along(tour, "pos", ["leaf", "save"])
    sign = F.when(F.col("_in"), -1).otherwise(1)
    found = tour.groupBy("node").agg(F.sum(sign * F.col("leaf") + F.col("own_leaf")).alias("n_leaves"), F.sum(sign * F.col("save") + F.col("own_save")).alias("saved"),
                                     F.min("pos").alias("enter"), F.max("pos").alias("exit"))
    ends = last_members(rows, convs)
    return nodes.join(found, "node").join(ends, ["conv", "depth"], "left").select(
        "node", "conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"), "enter", "exit")


def last_members(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256) of the nodes at which conversations end.  Their ids are put
    in order by ranges, written as text range by range, and hashed as a stream."""
    lasts = rows.groupBy("conv").agg(F.max(F.struct("depth", "k1", "k2")).alias("_l"))
    lasts = convs.join(lasts, "conv", "left").select(F.col("conv").alias("_c"), F.coalesce("_l.depth", F.lit(0)).alias("depth"), *[
        F.coalesce(f"_l.k{j}", F.lit(0)).alias(f"k{j}") for j in (1, 2)])
    lasts = keep(lasts.repartitionByRange("_c").withColumn("_p", F.spark_partition_id()))
    low = lasts.groupBy("depth", "k1", "k2", "_p").agg(F.sort_array(F.collect_list("_c")).alias("_ids")).select(
        "depth", "k1", "k2", "_p", F.array_join("_ids", ",").alias("_ids"))
    # a node's smallest member need not end there
    names = rows.groupBy("depth", "k1", "k2").agg(F.min("conv").alias("conv"))
    zero = convs.agg(F.min("conv").alias("conv")).select(*[F.lit(0).cast("long").alias(c) for c in ("depth", "k1", "k2")], "conv")
    low = keep(low.join(names.union(zero), ["depth", "k1", "k2"]).select("conv", "depth", "_p", "_ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, None
        for pdf in batches:
            done = []
            for conv, depth, ids in zip(pdf["conv"], pdf["depth"], pdf["_ids"], strict=True):
                if key != (conv, depth):
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["conv", "depth", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, digest.hexdigest())], columns=["conv", "depth", "ends_sha256"])

    low = low.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "_p").select("conv", "depth", "_ids")
    return low.mapInPandas(run, "conv long, depth long, ends_sha256 string")
