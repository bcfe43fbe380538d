"""N-gram Jaccard join by signature trees.

Each text becomes the set of 64-bit hashes of its word shingles. Texts with one set are a class. A tree of signatures
over the classes is traversed against itself, and its node pairs are pruned by the largest overlap they allow:

* The upper nodes are keyed by a size range and one slice of the token space with the tokens it holds. Two sets that reach the
  threshold differ in at most D tokens, D fixed by the size range; cut into more than D slices they agree in one
  at least, so node pairs with different content of all slices need no visit, and the dual traversal of the upper
  levels is a grouping by (range, slice, content). (D + 1 + E slices are made, so E agreeing ones may be left out: every
  set leaves out its first E empty slices, which say nothing.)
* Below such a node, nodes hold the OR of their members' token bitmaps, their range of sizes and the most tokens
  that share a bit in one member. A pair of nodes allows at most (that excess + the common bits) tokens in common; it is
  pruned where the sizes' ratio or that bound can't reach the threshold.
* Pairs of sets that survive are compared token by token.

A first pass compares each class with the smallest class it shares a node with, and then (HUB_ROUNDS times) the members of a node with
its hub, the member with most links so far, where those are still apart: this ties large groups of near copies together with about
as many pairs as members, since copies of one text link to those nearest to it. The tree below a node is traversed only where the node then still holds several
components, in blocks of bounded size, and node pairs inside one component are pruned too. Links missing from such a
component join what is already joined, so the components are those of all links. Components come from star contraction,
tables of edges that shrink step by step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bits import bit_filter, can_hold, kept, passing
from .shared import materialise, table
from .shared import passing as scratch
from .words import ASCII_LOWER, U, chunks, encoded, mix, shingles, slices, words

GROWTH = 1.3  # of a size range
BLOCK = 1024  # members of a node that one task takes in on either side
FAN_OUT = 8
KEYS_LISTED = 64
HUB_ROUNDS = 1


def size_ranges(num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower bounds of the size ranges, and for each its number of slices and of empty ones left out (0, 0: only equal sets link)."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, int(low[-1] * GROWTH)))
    slices, spare = [], []
    for lo, hi in zip(low, [*(x - 1 for x in low[1:]), low[-1] * 2], strict=True):
        differ = (hi + hi * den // num) * (den - num) // (den + num)
        e, m = 0, differ + 1
        for _ in range(20 if differ else 0):  # half as many again as the smallest sets of the range leave empty on average
            e = 2 + int(1.5 * m * math.exp(-lo / m))
            m = differ + 1 + e
        slices.append(m if differ else 0)
        spare.append(e)
    return np.array(low), np.array(slices), np.array(spare)


def bitmap_bits(n: int) -> int:
    """Bits of a set's bitmap: a power of two of at least eight times its size, from 64 to 2^19."""
    return 1 << min(19, max(6, int(8 * n - 1).bit_length()))


def token_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin (one more entry).

    A text of fewer than n words but at least one has its whole word sequence as its only shingle.
    """
    w = words(texts, ASCII_LOWER)
    h, at = shingles(w, n)
    owner = np.searchsorted(w.first, at, "right") - 1
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = []
        for d in short:
            x = U(count[d])
            for word in w.hashes[w.first[d] : w.first[d + 1]]:
                x = mix(np.array([x ^ word], U))[0]
            extra.append(x)
        h, owner = np.concatenate([h, np.array(extra, U)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    h = h.copy()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[keep], np.searchsorted(owner[keep], np.arange(len(texts) + 1))


def set_keys(tokens: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set: two sums over differently mixed tokens."""
    with np.errstate(over="ignore"):
        a = np.concatenate([np.zeros(1, U), np.cumsum(mix(tokens ^ U(0xA0761D6478BD642F)))])
        b = np.concatenate([np.zeros(1, U), np.cumsum(mix(tokens ^ U(0xE7037ED1A0B428DB)))])
        return (a[cuts[1:]] - a[cuts[:-1]]).view(np.int64), (b[cuts[1:]] - b[cuts[:-1]]).view(np.int64)


def slice_signatures(tokens: np.ndarray, n: int, num: int, den: int, ranges) -> np.ndarray:
    """Keys of the upper nodes that one set of sorted tokens stands under."""
    low, slices, spare = ranges
    own = int(np.searchsorted(low, n, "right")) - 1
    out = []
    for k in range(own, -1, -1):
        # a smaller partner in a range below looks at this set with that range's slices
        if k < own and (low[k + 1] - 1) * den < num * n:
            break
        if not slices[k]:
            continue
        m = U(slices[k])
        part = ((tokens >> U(32)) * m) >> U(32)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        with np.errstate(over="ignore"):
            content = np.add.reduceat(mix(tokens ^ U(0x8EBC6AF09C88C6E3)), starts)
            place = part[starts] + U(int(k) << 40)
            out.append(mix(content ^ mix(place)))
            missing = int(m) - len(starts) - int(spare[k])
            if missing > 0:
                empty = np.setdiff1d(np.arange(int(m), dtype=U), part[starts])[-missing:]
                out.append(mix(mix(empty + U(int(k) << 40)) ^ U(0x589965CC75374CC3)))
    return np.concatenate(out) if out else np.zeros(0, U)


def _sets(batch: pa.RecordBatch, column: int, n: int):
    for at, run in chunks(encoded(batch.column(column))):
        tokens, cuts = token_sets(run, n)
        yield at, tokens, cuts


def set_table(df: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (the set's name) and signatures, the keys of its upper nodes."""
    ranges = size_ranges(num, den)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_tokens, k1, k2, keys = [], [], [], []
            for _, tokens, cuts in _sets(batch, 1, n):
                a, b = set_keys(tokens, cuts)
                k1.append(a)
                k2.append(b)
                n_tokens.append(np.diff(cuts))
                keys += [slice_signatures(tokens[x:y], int(y - x), num, den, ranges).view(np.int64) if y > x else np.zeros(0, np.int64) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in keys])]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), cat(n_tokens), cat(k1), cat(k2), pa.ListArray.from_arrays(offsets, cat(keys))], names=["doc_id", "n_shingles", "k1", "k2", "signatures"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(cut, "doc_id long, n_shingles long, k1 long, k2 long, signatures array<long>")


def upper_nodes(rows: DataFrame, wanted: Broadcast, sigs: Broadcast | None = None) -> DataFrame:
    """sig, k1: a row for each upper node that a set_table's rows stand under, of the rows and nodes that the bit arrays let through."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (kept(b, 0, wanted) for b in slices(batches)):
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            sig, k1 = lists.values.to_numpy()[offsets[0] : offsets[-1]], np.repeat(batch.column(1).to_numpy(), np.diff(offsets))
            if sigs is not None:
                there = can_hold(sig, sigs.value)
                sig, k1 = sig[there], k1[there]
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(k1, pa.int64())], names=["sig", "k1"])

    return rows.select("doc_id", "k1", "signatures").mapInArrow(cut, "sig long, k1 long")


def token_table(df: DataFrame, n: int, id_col: str, text_col: str, wanted: Broadcast) -> DataFrame:
    """node (the id), n_shingles, tokens, bitmap and sketch (the bitmap folded to an eighth) of the rows whose id can be a wanted one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(kept(b, 0, wanted) for b in batches):
            for at, tokens, cuts in _sets(batch, 1, n):
                bitmaps, sketches = [], []
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    bits = np.zeros(bitmap_bits(int(y - x)), np.uint8)
                    bits[(tokens[x:y] & U(len(bits) - 1)).astype(np.int64)] = 1
                    packed = np.packbits(bits, bitorder="little")
                    bitmaps.append(packed.tobytes())
                    sketches.append(fold(packed, max(8, len(packed) // 8)).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(cuts) - 1), pa.array(np.diff(cuts), pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(tokens.view(np.int64))), pa.array(bitmaps, pa.binary()), pa.array(sketches, pa.binary())],
                    names=["node", "n_shingles", "tokens", "bitmap", "sketch"],
                )

    return df.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).mapInArrow(cut, "node long, n_shingles long, tokens array<long>, bitmap binary, sketch binary")


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """OR a bitmap (bytes, along the last axis) down to `width` bytes; a token's bit modulo the width stays its bit."""
    return np.bitwise_or.reduce(bits.reshape(*bits.shape[:-1], -1, width), axis=-2)


def most_common(a: int, b: int, x: np.ndarray, y: np.ndarray) -> int:
    """The largest overlap that two sets of sizes a and b with bitmaps x and y can have."""
    width = min(len(x), len(y))
    x, y = fold(x, width), fold(y, width)
    return min(a - int(np.bitwise_count(x & ~y).sum()), b - int(np.bitwise_count(y & ~x).sum()))


def possible(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of (a, b, n_a, n_b, bits_a, bits_b) whose sizes and bitmaps allow a link, as (a, b)."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            xa, xb = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            keep = [
                i
                for i in range(len(na))
                if min(na[i], nb[i]) * den >= max(na[i], nb[i]) * num
                and most_common(na[i], nb[i], np.frombuffer(xa[i], np.uint8), np.frombuffer(xb[i], np.uint8)) * (num + den) >= num * (na[i] + nb[i])
            ]
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(prune, "a long, b long")


def linked(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of (a, b, tokens_a, tokens_b) whose Jaccard similarity reaches num / den, as (a, b)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            xo, yo = x.offsets.to_numpy(), y.offsets.to_numpy()
            xv, yv = x.values.to_numpy(), y.values.to_numpy()
            keep = []
            for i in range(batch.num_rows):
                s, t = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
                both = np.sort(np.concatenate([s, t]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if den * common >= num * (len(s) + len(t) - common):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return pairs.select("a", "b", "tokens_a", "tokens_b").mapInArrow(compare, "a long, b long")


def _needed(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of sets that pairs (a, b) name, and few others: what the joins then shuffle follows the pairs."""
    return passing(sets, "node", bit_filter(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), "node"))


def check_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links among distinct candidate pairs (a, b): the bound of the sketches, then of the bitmaps, then the tokens of what is left."""
    side = lambda df, s, **cols: df.select(F.col("node").alias(s), *(F.col(c).alias(f"{as_}_{s}") for c, as_ in cols.items()))
    left = materialise(pairs, "pairs")
    for bits in ("sketch", "bitmap"):
        light = _needed(sets.select("node", "n_shingles", bits), left)
        named = {"n_shingles": "n", bits: "bits"}
        left = materialise(possible(left.join(side(light, "a", **named), "a").join(side(light, "b", **named), "b"), num, den).distinct(), "possible")
    full = _needed(sets.select("node", "tokens"), left)
    return linked(left.join(side(full, "a", tokens="tokens"), "a").join(side(full, "b", tokens="tokens"), "b"), num, den)


class Tree:
    """A signature tree over some sets: levels of nodes, each with OR bitmap, size range, excess and component range."""

    def __init__(self, sizes: np.ndarray, bitmaps: list[np.ndarray], components: np.ndarray, width: int):
        self.order = np.lexsort((sizes, components))
        size, comp = sizes[self.order], components[self.order]
        folded = [fold(bitmaps[i], min(width, len(bitmaps[i]))) for i in self.order]
        excess = size - np.array([int(np.bitwise_count(x).sum()) for x in folded])
        # a narrower bitmap is repeated: each token's bit in the full width is then among those set
        bits = np.stack([np.tile(x, width // len(x)) for x in folded]).view(U)
        self.levels = [(bits, size, size, excess, comp, comp)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, e, c0, c1 = self.levels[-1]
            at = np.arange(0, len(b), FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(e, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node of a level its children below, with the node's place in the argument."""
        kids = node[:, None] * FAN_OUT + np.arange(FAN_OUT)
        which, kid = np.repeat(np.arange(len(node)), FAN_OUT), kids.ravel()
        there = kid < len(self.levels[level - 1][0])
        return which[there], kid[there]


def _allowed(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which node pairs can hold a link between different components."""
    ok = (x[2][i] * den >= num * y[1][j]) & (y[2][j] * den >= num * x[1][i])
    ok &= ~((x[4][i] == x[5][i]) & (y[4][j] == y[5][j]) & (x[4][i] == y[4][j]))
    left = np.flatnonzero(ok)
    for part in np.array_split(left, max(1, len(left) * x[0].shape[1] >> 21)):
        common = np.bitwise_count(x[0][i[part]] & y[0][j[part]]).sum(axis=1, dtype=np.int64)
        most = common + np.minimum(x[3][i[part]], y[3][j[part]])
        ok[part] = most * (num + den) >= num * (x[1][i[part]] + y[1][j[part]])
    return ok


def traverse(x: Tree, y: Tree, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members (places in either input) that no node pair's bound rules out; each level descends both trees."""
    a, b = len(x.levels) - 1, len(y.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        ok = _allowed(x.levels[a], i, y.levels[b], j, num, den)
        i, j = i[ok], j[ok]
        if not len(i) or (a == 0 and b == 0):
            return x.order[i], y.order[j]
        if a >= b:
            which, i = x.children(a, i)
            j, a = j[which], a - 1
        else:
            which, j = y.children(b, j)
            i, b = i[which], b - 1


def tree_pairs(members: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs below upper nodes; members: sig, p, q (blocks), blk, node, n_shingles, bitmap, comp, sigs.

    A pair that also meets below a smaller key, as far as the members' lists of keys (sigs) tell, is left to that one.
    """

    def pairs(frame: pd.DataFrame) -> pd.DataFrame:
        p, q = int(frame["p"].iloc[0]), int(frame["q"].iloc[0])
        width = int(np.median([len(x) for x in frame["bitmap"]]))
        width = 1 << (width.bit_length() - 1)

        here = int(frame["sig"].iloc[0])

        def of(block: int) -> tuple[Tree, np.ndarray, list[frozenset]]:
            part = frame[frame["blk"] == block]
            smaller = [frozenset(x[: np.searchsorted(x, here)].tolist()) for x in part["sigs"]]
            return Tree(part["n_shingles"].to_numpy(), [np.frombuffer(x, np.uint8) for x in part["bitmap"]], part["comp"].to_numpy(), width), part["node"].to_numpy(), smaller

        (x, ids, s), (y, others, t) = of(p), of(q)
        i, j = traverse(x, y, num, den)
        a, b = ids[i], others[j]
        keep = a < b if p == q else a != b
        keep[keep] = [s[u].isdisjoint(t[v]) for u, v in zip(i[keep].tolist(), j[keep].tolist(), strict=True)]
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]}).drop_duplicates()

    return members.groupBy("sig", "p", "q").applyInPandas(pairs, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node joined to it) for all nodes of edges (a, b), by large-star and small-star steps.

    Every step joins the edges with a minimum that is aggregated before the shuffle; edges live in written tables.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = near.join(least, "a")
        if large:
            return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        now = materialise(star(star(now, True), False), "edges")
        after = mark(now)
        if after == seen:
            break
        seen = after
    return materialise(now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct(), "components")


def hub_pairs(labelled: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct (a, b): each member (sig, node, comp) of an upper node and the node's hub, where a component doesn't hold both."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    ranked = labelled.join(degree, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    hubs = ranked.groupBy("sig").agg(F.max(F.struct("n", (-F.col("node")).alias("less"), "comp")).alias("h"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    apart = labelled.join(hubs.select("sig", (-F.col("h.less")).alias("hub"), F.col("h.comp").alias("of")), "sig").where(F.col("comp") != F.col("of"))
    return _in_order(apart.select(F.col("node").alias("a"), F.col("hub").alias("b")))


def in_blocks(members: DataFrame) -> DataFrame:
    """Adds blk, the block of each member (sig, comp, node) in its upper node: of about BLOCK members.

    A component of BLOCK members or more under the node has blocks of its own, which no block pair need compare with each
    other; smaller components share blocks. Counts are summed up before the shuffle, and nothing orders a node's members.
    """
    per = members.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("n_comp"))
    small = per.where(F.col("n_comp") < BLOCK).groupBy("sig").agg(F.sum("n_comp").alias("n_small"))
    parts = lambda n: F.ceil(F.col(n) / BLOCK)
    own = F.xxhash64("comp", F.pmod(F.xxhash64("node"), parts("n_comp")))
    shared = F.xxhash64(F.lit("shared"), F.pmod(F.xxhash64("comp"), parts("n_small")))
    return members.join(per, ["sig", "comp"]).join(small, "sig", "left").withColumn("blk", F.when(F.col("n_comp") >= BLOCK, own).otherwise(shared)).drop("n_comp", "n_small")


def _in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_groups(df: DataFrame, n: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The class of each row under "reachable by links": doc_id, n_shingles, component_id (the smallest id in it).

    Rows link when the Jaccard similarity of their sets of n-word shingles is at least the ratio `similarity`. A-Z are
    lower-cased, words end at ASCII white space; a text of fewer than n words has its word sequence as its one
    shingle. Null, empty and wordless texts have the empty set and are a class by themselves. Rows with a null id link nothing
    and have a null class; rows with one id are one document, which links as each of them does; an empty table gives an empty result; other columns
    aren't read. Ids must cast to long.
    """
    num, den = similarity
    rows = materialise(set_table(df, n, num, den, id_col, text_col), "sets")
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("node"))

    # upper nodes with two classes or more, each with its smallest class; one row of a class stands for it
    first_rows = bit_filter(classes, "node")
    pivots = materialise(upper_nodes(rows, first_rows).groupBy("sig").agg(F.min("k1").alias("pivot"), F.max("k1").alias("last")).where("pivot < last").select("sig", "pivot"), "pivots")
    held = materialise(upper_nodes(rows, first_rows, bit_filter(pivots, "sig")).join(pivots, "sig").distinct().select("sig", "k1", "pivot"), "nodes")

    # token sets and bitmaps of the classes under them; equal first halves of names only add candidates
    names = materialise(classes.join(held.select("k1").distinct(), "k1").select("k1", "node"), "names")
    sets = materialise(token_table(df, n, id_col, text_col, bit_filter(names, "node")), "tokens")

    # first pass: every class against the smallest class it shares a node with, then nodes' members against their hubs
    near = held.where("k1 <> pivot").groupBy("k1").agg(F.min("pivot").alias("pivot")).join(names.select("k1", F.col("node").alias("a")), "k1").join(names.select(F.col("k1").alias("pivot"), F.col("node").alias("b")), "pivot")
    tried = materialise(_in_order(near.where("a <> b").select("a", "b")), "tried")
    first = materialise(check_pairs(tried, sets, num, den), "links")
    comps = components(first)
    under = materialise(held.join(names, "k1").select("sig", "node"), "under")
    relabel = lambda: materialise(under.join(comps, "node", "left").select("sig", "node", F.coalesce("comp", "node").alias("comp")), "members")
    for _ in range(HUB_ROUNDS):
        more = materialise(hub_pairs(relabel(), first).join(tried, ["a", "b"], "left_anti"), "hubs")
        tried = tried.union(more)
        first = materialise(first.union(check_pairs(more, sets, num, den)), "links")
        comps = components(first)

    # second pass: below nodes whose members still are in several components
    labelled = relabel()
    mixed = labelled.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig", "n")
    members = materialise(labelled.join(mixed, "sig"), "mixed")
    # a node of one leaf: its few pairs are what a traversal would come to
    leaf = members.where(F.col("n") <= FAN_OUT)
    x, y = leaf.alias("x"), leaf.alias("y")
    few = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    light = sets.select("node", "n_shingles", "bitmap")
    deep = materialise(in_blocks(members.where(F.col("n") > FAN_OUT)), "blocks")
    blocks = deep.join(light.select("node", "n_shingles"), "node").groupBy("sig", "blk").agg(F.min("n_shingles").alias("n0"), F.max("n_shingles").alias("n1"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    x, y = blocks.alias("x"), blocks.alias("y")
    pairs = x.join(y, F.col("x.sig") == F.col("y.sig")).where(
        (F.col("x.blk") <= F.col("y.blk"))
        & (F.col("x.n1") * den >= F.col("y.n0") * num) & (F.col("y.n1") * den >= F.col("x.n0") * num)
        & (F.least("x.c0", "y.c0") < F.greatest("x.c1", "y.c1"))
    ).select(F.col("x.sig").alias("sig"), F.col("x.blk").alias("p"), F.col("y.blk").alias("q"))
    sides = pairs.select("sig", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("blk"))
    keys = deep.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, KEYS_LISTED).alias("sigs"))  # no more than a text has slices
    second = few.union(tree_pairs(sides.join(deep, ["sig", "blk"]).join(light, "node").join(keys, "node"), num, den)).distinct()
    links = materialise(check_pairs(second, sets, num, den), "links")
    comps = components(first.union(links)) if links.take(1) else comps

    named = classes.join(comps, "node", "left").select("n_shingles", "k1", "k2", F.coalesce("comp", "node").alias("component_id"))
    with_class = rows.join(named, ["n_shingles", "k1", "k2"], "left")
    return with_class.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one_of_each(df: DataFrame, n: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of df that have the smallest id of their class, with their columns as they are.

    Rows without an id stay, and so do those without a word, which are copies of nothing. Rows that share an id are one document:
    all of them stay if that id does. An empty table gives an empty one.
    """
    with scratch(df.sparkSession):
        keep = materialise(similar_groups(df, n, similarity).where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "copies", keep=True)
    return df.join(keep, df["doc_id"] == keep["_gone"], "left_anti")


def op9_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), n=4, similarity=(85, 100))
