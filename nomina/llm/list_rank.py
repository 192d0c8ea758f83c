"""Positions in a linked list that is spread over a cluster, and running sums along them.

A list of arcs (``arc``, ``succ``; the last has ``succ`` -1) shrinks level by level: arcs
are dealt into groups of bounded size, and inside a group every run of arcs that follow one
another becomes one arc, its head, with the run's length.  Levels deal in turn by ranges of
arc numbers (neighbours in number are mostly neighbours in the list) and by a coin: an arc
with tails goes to its successor's group if that has heads, so a quarter of the arcs are
expected to vanish whatever the order.  The last few form one group.  Going back, an arc's
position is its head's plus its distance from it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nomina.llm.common import few, keep, small

#: Arcs of a group on average, and arcs that the last group may have.
GROUP, LAST = 1 << 15, 1 << 17


def runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """The arcs of one group with the head of their run, their distance from it, and (heads)
    what follows the run and its length."""
    arc, succ, n = pdf["arc"].to_numpy(), pdf["succ"].to_numpy(), pdf["n"].to_numpy()
    order = np.argsort(arc)
    arc, succ, n = arc[order], succ[order], n[order]
    nxt = np.minimum(np.searchsorted(arc, succ), len(arc) - 1)
    nxt = np.where(arc[nxt] == succ, nxt, -1)
    before, head = np.zeros(len(arc), np.int64), np.arange(len(arc))
    has = np.flatnonzero(nxt >= 0)
    head[nxt[has]], before[nxt[has]] = has, n[has]
    while (head[head] != head).any():  # doubling: after step k the 2**k arcs before are added up
        before, head = before + before[head], head[head]
    first = head == np.arange(len(arc))
    out, total = np.full(len(arc), -1), np.zeros(len(arc), np.int64)
    tail = np.flatnonzero(nxt < 0)
    out[head[tail]], total[head[tail]] = succ[tail], before[tail] + n[tail]
    return pd.DataFrame({"arc": arc, "head": arc[head], "dist": before, "first": first, "succ": out, "n": total})


def list_rank(arcs: DataFrame, span: int, group: int = GROUP, last: int = LAST) -> DataFrame:
    """(arc, pos): the position of every arc, from 0.  Arc numbers are below ``span``.

    No arcs give no rows.  The arcs must form one list."""
    level, done, turn = keep(arcs.select("arc", "succ", F.lit(1).cast("long").alias("n"))), [], 0
    n = level.count()
    while n > 1 or not turn:
        groups = -(-n // group)
        if n <= last:
            key = F.lit(0).cast("long")
        elif turn % 2 == 0:
            key = F.expr(f"arc div {-(-span // groups)}")
        else:
            def coin(c: str, turn: int = turn):
                return F.xxhash64(F.lit(turn), F.col(c)).bitwiseAND(F.lit(1)) == 1
            own = F.when(~coin("arc") & coin("succ") & (F.col("succ") >= 0), F.col("succ")).otherwise(F.col("arc"))
            key = F.pmod(F.xxhash64(F.lit(-turn), own), F.lit(groups))
        found = level.withColumn("_g", key).groupBy("_g").applyInPandas(
            lambda pdf: runs(pdf), "arc long, head long, dist long, first boolean, succ long, n long")
        found = keep(found)
        done.append(few(found.select("arc", "head", "dist"), n))
        level = found.where("first").select("arc", "succ", "n")
        n, turn = level.count(), turn + 1
    pos = done.pop().select("arc", F.col("dist").alias("pos"))
    for step in reversed(done):
        heads = small(keep(pos.select(F.col("arc").alias("head"), F.col("pos").alias("_at"))))
        pos = step.join(heads, "head").select("arc", (F.col("_at") + F.col("dist")).alias("pos"))
    return pos


def sums_along(rows: DataFrame, pos: str, values: list[str], group: int = GROUP) -> DataFrame:
    """``rows`` with each of ``values`` replaced by its sum over all positions up to the row's
    own; positions are distinct and dense, so every group of them is bounded."""
    rows = rows.withColumn("_g", F.expr(f"{pos} div {group}"))
    inner = Window.partitionBy("_g").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)  # a row a group
    bins = rows.groupBy("_g").agg(*[F.sum(c).alias(c) for c in values])
    bins = bins.select(F.col("_g").alias("_b"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in values])
    rows = rows.withColumns({c: F.sum(c).over(inner) for c in values}).join(small(keep(bins)), F.col("_g") == F.col("_b"))
    return rows.withColumns({c: F.col(c) + F.col(f"_{c}") for c in values}).drop("_g", "_b", *[f"_{c}" for c in values])
