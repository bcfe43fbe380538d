"""Ranking the nodes of paths: by pointer doubling in arrays where the arcs fit one task, else within buckets first.

An arc (a, b) leads from node a to node b. Every node has at most one arc out; where arcs form paths and cycles, also one in. A node is twice a
code, and 1 if what the code stands for is read forward: a path has a mirror image, whose nodes differ in that bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

ONE_TASK = 1 << 20  # arcs that are ranked in one task: 16 bytes each, and half a dozen arrays of their nodes
BUCKET_ARCS = 1 << 18

_RANKED = "node long, path long, rank long, loose boolean, low long"


def rank_arcs(a: np.ndarray, b: np.ndarray, length: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nodes, the last node of each one's path, its distance from there, whether it is on a cycle instead, and the least node on the way.

    length and low: of each arc, what it is long, and the least node on it, its end left out.
    """
    nodes = np.unique(np.concatenate([a, b]))
    at = np.searchsorted(nodes, a)
    to = np.arange(len(nodes))
    to[at] = np.searchsorted(nodes, b)
    rank, least, last = np.zeros(len(nodes), np.int64), nodes.copy(), np.ones(len(nodes), bool)
    rank[at], least[at], last[at] = length, low, False
    for _ in range(len(nodes).bit_length() + 1):
        if last[to].all():
            break
        least = np.minimum(least, least[to])
        rank = rank + rank[to]
        to = to[to]
    return nodes, nodes[to], rank, ~last[to], least


def opened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The arcs with every cycle cut before its least code: no arc leads into its forward reading, none leaves its other one."""
    *_, loose, least = rank_arcs(a, b, np.ones(len(a), np.int64), a)
    if not loose.any():
        return a, b
    codes = np.unique(least[loose] >> 1)
    keep = ~(np.isin(b, 2 * codes + 1) | np.isin(a, 2 * codes))
    return a[keep], b[keep]


def _whole(batches: Iterator[pa.RecordBatch], columns: int) -> list[np.ndarray]:
    each = list(batches)
    return [np.concatenate([b.column(c).to_numpy() for b in each]) if each else np.zeros(0, np.int64) for c in range(columns)]


def _in_one_task(arcs: DataFrame, cut: bool) -> DataFrame:
    """arcs (a, b, length, low), ONE_TASK rows at most; cut: cycles are opened first."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, length, low = _whole(batches, 4)
        if cut:
            a, b = opened(a, b)
            length, low = np.ones(len(a), np.int64), a
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rank_arcs(a, b, length, low)], names=["node", "path", "rank", "loose", "low"])

    return arcs.select("a", "b", "length", "low").coalesce(1).mapInArrow(rank, _RANKED)


def doubled(arcs: DataFrame, name: str = "paths") -> DataFrame:
    """The same of any number of arcs (a, b, length, low), by joins that double the distance; nodes may have several arcs in.

    Nodes that have reached their end are moved no further; when ONE_TASK or fewer are left, one task ranks them.
    """
    ends = arcs.select(F.col("b").alias("a")).distinct().join(arcs.select("a"), "a", "left_anti")
    left = arcs.select("a", "b", F.col("length").alias("d"), "low")
    done = materialise(ends.select("a", F.col("a").alias("b"), F.lit(0).cast("long").alias("d"), F.col("a").alias("low")), name)
    span, n = 1, arcs.count() + done.count()
    while span <= n and left.count() > ONE_TASK:
        known = done.withColumn("done", F.lit(True)).union(left.withColumn("done", F.lit(False)))
        step = known.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("d").alias("e"), F.col("low").alias("low2"), "done")
        moved = materialise(left.join(step, "b").select("a", F.col("c").alias("b"), (F.col("d") + F.col("e")).alias("d"), F.least("low", "low2").alias("low"), "done"), name)
        done, left = done.union(moved.where("done").drop("done")), moved.where("not done").drop("done")
        span *= 2
    columns = lambda rank, loose: (F.col("a").alias("node"), F.col("b").alias("path"), rank.alias("rank"), F.lit(loose).alias("loose"), "low")
    settled = done.select(*columns(F.col("d"), False))
    if span > n:  # what is left is on cycles
        return settled.union(left.select(*columns(F.col("d"), True)))
    last = materialise(_in_one_task(left.withColumnRenamed("d", "length"), False), name)
    onward = done.select(F.col("a").alias("path"), F.col("b").alias("end"), "d", F.col("low").alias("low2"))
    rest = last.where("not loose and rank > 0").join(onward, "path").select("node", F.col("end").alias("path"), (F.col("rank") + F.col("d")).alias("rank"), "loose", F.least("low", "low2").alias("low"))
    return settled.union(rest).union(last.where("loose"))


def distances(arcs: DataFrame) -> DataFrame:
    """node, rank: how many arcs (a, b) lead on from each node; nodes may have several arcs in, and there are no cycles."""
    full = arcs.select("a", "b", F.lit(1).cast("long").alias("length"), F.col("a").alias("low"))
    return (_in_one_task(full, False) if arcs.count() <= ONE_TASK else doubled(full)).select("node", "rank")


def chains(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Arcs as chains: each node but a chain's last, with the chain's head, the place from there, and the last node, length and least node."""
    a, b = opened(a, b)
    nodes, last, rank, _, least = rank_arcs(a, b, np.ones(len(a), np.int64), a)
    inner = np.isin(nodes, a, assume_unique=True)
    is_head = inner & ~np.isin(nodes, b)
    order = np.argsort(last[is_head])
    head = nodes[is_head][order]
    of = np.searchsorted(last[is_head][order], last[inner])  # a chain's last node tells the chain
    size = rank[is_head][order]
    return nodes[inner], head[of], size[of] - rank[inner], last[inner], size[of], least[is_head][order][of]


def _chains(group: pa.Table) -> pa.Table:
    """A bucket's arcs as chains."""
    return pa.table(list(chains(group["a"].to_numpy(), group["b"].to_numpy())), names=["node", "head", "at", "tail", "length", "low"])


def chain_ranks(arcs: DataFrame) -> DataFrame:
    """node, path (its last node), rank (the distance from there), loose (it is on a cycle instead) and low (then the least node) of arcs (a, b, length, low), in a written table."""
    return materialise(_in_one_task(arcs, False) if arcs.count() <= ONE_TASK else doubled(arcs), "paths")


def path_ranks(arcs: DataFrame) -> DataFrame:
    """node, path (its last node), rank (the distance from there) of arcs (a, b, key), which form paths and cycles.

    More than ONE_TASK arcs are walked within buckets of `key` first, and only chains are ranked together. A key for
    which most arcs meet those that they continue makes long chains; any key gives the same result. Cycles are cut before their least
    code. `arcs` is read several times and should be a written table.
    """
    n = arcs.count()
    if n <= ONE_TASK:
        return _in_one_task(arcs.select("a", "b", F.lit(1).cast("long").alias("length"), F.col("a").alias("low")), True).select("node", "path", "rank")
    for _ in range(2):
        # keys that alone fill a bucket are dealt out by node: their arcs meet fewer others, and no task gets them all
        hot = [r["key"] for r in arcs.groupBy("key").count().where(F.col("count") > BUCKET_ARCS).collect()]  # n / BUCKET_ARCS rows at most
        spread = F.when(F.col("key").isin(hot), F.xxhash64("a")).otherwise(F.xxhash64("key")) if hot else F.xxhash64("key")
        dealt = arcs.select("a", "b", F.pmod(spread, F.lit(-(-2 * n // BUCKET_ARCS))).alias("bucket"))
        chains = materialise(dealt.groupBy("bucket").applyInArrow(_chains, "node long, head long, at long, tail long, length long, low long"), "chains")
        joined = chains.where("at = 0").select(F.col("head").alias("a"), F.col("tail").alias("b"), "length", "low")
        ranked = chain_ranks(joined)
        cuts = ranked.where("loose").select(F.shiftright("low", 1).alias("code")).distinct()
        if cuts.isEmpty():
            heads = ranked.select(F.col("node").alias("head"), "path", "rank")
            inside = chains.where("at > 0").join(heads, "head").select("node", "path", (F.col("rank") - F.col("at")).alias("rank"))
            return ranked.select("node", "path", "rank").union(inside)
        cuts = materialise(cuts, "cuts")
        arcs = materialise(arcs.join(cuts.select((2 * F.col("code") + 1).alias("b")), "b", "left_anti").join(cuts.select((2 * F.col("code")).alias("a")), "a", "left_anti").select("a", "b", "key"), "arcs")
    raise AssertionError("cycles remain after their cut")
