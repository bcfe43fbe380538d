"""Ranked lexical search by MaxScore with bounds of term pairs.

The index is cut by documents: an Arrow task turns what it reads into blocks of up to BLOCK documents with their own posting lists, so
building it moves nothing. Items are taken in runs of bounded size, and a run's terms and thresholds are broadcast.

1. Posting lists of the run's terms, by block, with the counts that weights need: documents, terms, documents of each term.
2. With the weights known, postings become impacts. Each block stores the maximum impact of each term and, for every two terms that
   are neighbours in an item's order of weight, the maximum joint impact over the intersection of their lists. Some documents that hold
   an item's heaviest pairs are scored in full; the k-th best of those scores over all blocks is the item's first threshold.
3. Search, block by block. No document can score more from an item's t lightest terms than the least sum over ways to take
   them alone (the term's maximum) or as neighbouring pairs (the larger of the pair's joint maximum and of both terms' own, for documents that have
   one of them). If that bound of all terms is below the threshold, the block is skipped for the item; else only documents that hold
   a term beyond the longest prefix below the threshold are candidates, and a candidate goes as soon as its score and the bound of what is left are below it.
   Thresholds rise within a task. Each task sends at most k documents for each item.

Blocks are rows of written tables. Scores are 64-bit integers; equal scores rank by ascending id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import numbered, running_sums
from .shared import materialise, table
from .words import ASCII_LOWER, U, Words, chunks, encoded, same_words, slices, word_hashes

BLOCK = 4096
BLOCK_POSTINGS = 1 << 20
ITEM_BYTES = 4 << 20  # of the texts of a run of items; a longer text is a run of its own
SALTS = 64

_TERM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_INDEX = pa.schema([
    ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())), ("values", pa.list_(pa.int64())),
])
_POSTINGS_SCHEMA = "ids array<long>, sizes array<long>, terms array<int>, lengths array<int>, docs array<int>, values array<long>"
_IMPACT_SCHEMA = _POSTINGS_SCHEMA + ", joint array<long>, seed_items array<int>, seed_scores array<long>"


def terms_of(texts: list[bytes]) -> Words:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case."""
    buffer = (b" ".join(texts) + b" " * 8).translate(ASCII_LOWER)
    inside = _TERM[np.frombuffer(buffer, np.uint8)]
    step = np.diff(inside.view(np.int8), prepend=0)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]) if texts else np.zeros(1, np.int64)
    return Words(buffer, starts, ends, word_hashes(buffer, starts, ends), np.searchsorted(starts, offsets))


@dataclass
class Vocabulary:
    """Distinct terms, numbered in order of their hashes."""

    terms: list[bytes]
    hashes: np.ndarray
    numbers: dict[bytes, int]

    @staticmethod
    def of(terms: set[bytes]) -> Vocabulary:
        buffer = b" ".join(terms) + b" " * 8
        ends = np.cumsum([len(t) + 1 for t in terms]) - 1 if terms else np.zeros(0, np.int64)
        each = list(terms)
        hashes = word_hashes(buffer, ends - np.array([len(t) for t in each], np.int64), ends)
        order = np.argsort(hashes, kind="stable")
        each = [each[i] for i in order]
        return Vocabulary(each, hashes[order], {t: i for i, t in enumerate(each)})

    def find(self, w: Words) -> np.ndarray:
        """Each word's number, -1 for words outside. Hashes find, bytes decide."""
        at = np.minimum(np.searchsorted(self.hashes, w.hashes), max(0, len(self.hashes) - 1))
        if not len(self.hashes) or not len(w.hashes):
            return np.full(len(w.hashes), -1)
        out = np.where(self.hashes[at] == w.hashes, at, -1)
        hit = np.flatnonzero(out >= 0)
        found, first, which = np.unique(out[hit], return_index=True, return_inverse=True)
        part = Words(w.buffer, w.starts[hit], w.ends[hit], w.hashes[hit], w.first)
        sure = len(np.unique(self.hashes)) == len(self.hashes) and same_words(part, first[which])
        if not sure or any(self.terms[i] != part.bytes(j) for i, j in zip(found.tolist(), first.tolist(), strict=True)):
            return np.array([self.numbers.get(w.bytes(i), -1) for i in range(len(w.hashes))])
        return out


@dataclass
class Items:
    """A run of items: each a list of term numbers, lightest first once weights are known."""

    terms: list[list[int]]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    documents: int = 0
    total: int = 0

    def __post_init__(self):
        w = self.weights
        self.ordered = [sorted(t, key=lambda i: (w[i] if len(w) else 0, i)) for t in self.terms]
        width = max(map(len, self.ordered), default=0)
        self.matrix = np.full((len(self.ordered), width), -1, np.int64)  # padded in front, so that heavy terms line up
        for i, t in enumerate(self.ordered):
            self.matrix[i, width - len(t) :] = t
        pairs = np.unique(np.array([(a, b) for t in self.ordered for a, b in zip(t, t[1:])], np.int64).reshape(-1, 2), axis=0)
        self.pairs = pairs
        number = {(a, b): k for k, (a, b) in enumerate(pairs.tolist())}
        self.pair_at = np.full((len(self.ordered), max(0, width - 1)), -1, np.int64)
        for i, t in enumerate(self.ordered):
            for k, p in enumerate(zip(t, t[1:])):
                self.pair_at[i, width - len(t) + k] = number[p]

    def length_terms(self, sizes: np.ndarray) -> np.ndarray:
        """m of each document size, exact for any counts."""
        distinct, which = np.unique(sizes, return_inverse=True)
        return np.array([50 + (50 * int(n) * self.documents) // self.total for n in distinct] if self.total else [50] * len(distinct), np.int64)[which]


def _blocks(df: DataFrame, id_col: str, text_col: str, vocabulary) -> DataFrame:
    """Posting lists by block: document ids and sizes, and for each term the documents' numbers and its occurrences in them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        ids, sizes, found = [], [], []  # found: (document's number, term, occurrences)
        postings = 0

        def block() -> pa.RecordBatch:
            doc, term, tf = (np.concatenate([f[i] for f in found]) for i in range(3))
            order = np.lexsort((doc, term))
            terms, lengths = np.unique(term, return_counts=True)
            columns = [[x for part in ids for x in part], np.concatenate(sizes), terms.astype(np.int32), lengths.astype(np.int32), doc[order].astype(np.int32), tf[order]]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, _INDEX, strict=True)], schema=_INDEX)

        n = 0
        for batch in slices(batches):
            texts = encoded(batch.column(1))
            for at, run in chunks(texts):
                w = terms_of(run)
                number = v.find(w)
                hit = np.flatnonzero(number >= 0)
                owner = np.repeat(np.arange(len(run)), np.diff(w.first))
                key, tf = np.unique(owner[hit] * max(1, len(v.terms)) + number[hit], return_counts=True)
                begin = 0
                while begin < len(run):  # a block takes as many of the run's documents as it has room for
                    take = min(len(run) - begin, BLOCK - n)
                    lo, hi = np.searchsorted(key, np.array([begin, begin + take]) * max(1, len(v.terms)))
                    found.append((key[lo:hi] // max(1, len(v.terms)) - begin + n, key[lo:hi] % max(1, len(v.terms)), tf[lo:hi]))
                    ids.append(batch.column(0).slice(at + begin, take).to_pylist())
                    sizes.append(np.diff(w.first)[begin : begin + take])
                    n, begin, postings = n + take, begin + take, postings + hi - lo
                    if n >= BLOCK or postings >= BLOCK_POSTINGS:
                        yield block()
                        ids, sizes, found, n, postings = [], [], [], 0, 0
        if n:
            yield block()

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, _POSTINGS_SCHEMA)


class Block:
    """One block's lists as arrays; values are impacts."""

    def __init__(self, terms: np.ndarray, lengths: np.ndarray, docs: np.ndarray, values: np.ndarray, n: int):
        self.docs, self.values, self.n = docs, values, n
        self.place = {t: k for k, t in enumerate(terms.tolist())}
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.top = np.maximum.reduceat(values, self.starts) if len(terms) else np.zeros(0, np.int64)

    def list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        k = self.place.get(term)
        return (self.docs[:0], self.values[:0]) if k is None else (self.docs[self.starts[k] : self.ends[k]], self.values[self.starts[k] : self.ends[k]])

    def most(self, terms: np.ndarray) -> np.ndarray:
        """The maximum impact of each term, 0 for terms that the block hasn't."""
        return np.array([self.top[self.place[t]] if t in self.place else 0 for t in terms.reshape(-1).tolist()], np.int64).reshape(terms.shape)

    def joint(self, pairs: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """The maximum joint impact of each pair, 0 where no document has both; the documents of non-empty intersections, best first."""
        out, both = np.zeros(len(pairs), np.int64), {}
        row = np.zeros(self.n, np.int64)
        last = None
        for p, (a, b) in enumerate(pairs.tolist()):  # pairs are sorted: the first term's row is spread once
            if a not in self.place or b not in self.place:
                continue
            docs, values = self.list(a)
            if a != last:
                row[:] = 0
                row[docs] = values
                last = a
            docs, values = self.list(b)
            held = row[docs] > 0
            if held.any():
                total = row[docs[held]] + values[held]
                out[p] = total.max()
                both[p] = docs[held][np.argsort(-total, kind="stable")]
        return out, both

    def score(self, docs: np.ndarray, terms: list[int]) -> np.ndarray:
        """The impacts of terms added up for documents in ascending order."""
        out = np.zeros(len(docs), np.int64)
        for t in terms:
            held, values = self.list(t)
            if len(held):
                at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
                out += np.where(held[at] == docs, values[at], 0)
        return out


def bounds(most: np.ndarray, joint: np.ndarray | None) -> np.ndarray:
    """For each item, the most that its first t terms can score together, t from 0 on; joint: of each two neighbours, None for no pairs."""
    out = np.zeros((len(most), most.shape[1] + 1), np.int64)
    for t in range(most.shape[1]):
        out[:, t + 1] = out[:, t] + most[:, t]
        if joint is not None and t:
            pair = np.maximum(joint[:, t - 1], np.maximum(most[:, t - 1], most[:, t]))
            out[:, t + 1] = np.minimum(out[:, t + 1], out[:, t - 1] + pair)
    return out


@dataclass
class Found:
    """The best k of each item so far."""

    k: int
    threshold: np.ndarray
    kept: dict[int, list[tuple]] = field(default_factory=dict)
    skipped: int = 0  # (item, block)
    candidates: int = 0
    scored: int = 0  # postings looked up for candidates

    def add(self, item: int, ids: list, scores: np.ndarray) -> None:
        every = self.kept.get(item, []) + [(-s, i is None, i or 0, i) for s, i in zip(scores.tolist(), ids, strict=True)]
        every = sorted(every, key=lambda x: x[:3])[: self.k]
        self.kept[item] = every
        if len(every) == self.k:
            self.threshold[item] = max(self.threshold[item], -every[-1][0])


def search_block(block: Block, ids: list, items: Items, joint: np.ndarray | None, found: Found) -> None:
    """Add a block's best documents for each item; joint: the block's joint maxima, None to search without pairs."""
    most = block.most(items.matrix)
    pair = None if joint is None else np.where(items.pair_at >= 0, np.append(joint, 0)[items.pair_at], 0)
    bound = bounds(most, pair)
    light = np.sum(bound < found.threshold[:, None], axis=1) - 1  # terms of the longest prefix below the threshold (bounds never fall)
    width = items.matrix.shape[1]
    found.skipped += int(np.sum(light >= width))
    total = np.zeros(block.n, np.int64)
    for i in np.flatnonzero(light < width).tolist():
        need, row = int(found.threshold[i]), items.matrix[i]
        total[:] = 0
        for t in row[light[i] :].tolist():
            docs, values = block.list(t)
            total[docs] += values
        at = np.flatnonzero(total)
        found.candidates += len(at)
        for t in range(int(light[i]) - 1, -1, -1):
            at = at[total[at] + bound[i, t + 1] >= need]
            if not len(at) or row[t] < 0:
                break
            found.scored += len(at)
            total[at] += block.score(at, [int(row[t])])
        at = at[total[at] >= need]
        if len(at):
            if len(at) > found.k:  # ties at the k-th score stay, so that ids decide
                at = at[total[at] >= np.partition(total[at], len(at) - found.k)[len(at) - found.k]]
            found.add(i, [ids[d] for d in at.tolist()], total[at])


def _numpy(column, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


def _impacts(index: DataFrame, items, k: int) -> DataFrame:
    """The index with impacts and joint maxima; a task's last row has no documents but the best of its full scores."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, best = items.value, Found(k, np.zeros(len(items.value.terms), np.int64))
        kinds = [*(f.type for f in _INDEX), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = [*_INDEX.names, "joint", "seed_items", "seed_scores"]
        row = lambda *c: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(c, kinds, strict=True)], names=names)
        for batch in batches:
            for r in range(batch.num_rows):
                ids, sizes, terms, lengths, docs, tf = (_numpy(batch.column(c), r) if c else batch.column(0)[r].as_py() for c in range(6))
                weight = np.repeat(run.weights[terms], lengths)
                values = weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * run.length_terms(sizes)[docs]))
                block = Block(terms, lengths, docs, values, len(ids))
                joint, both = block.joint(run.pairs)
                for i, t in enumerate(run.ordered):
                    some: list[int] = []
                    for p in run.pair_at[i][run.pair_at[i] >= 0][::-1].tolist():  # heaviest first
                        some += both.get(p, [])[:k].tolist() if p in both else []
                        if len(some) >= k:
                            break
                    if len(some) < k and t:
                        some += block.list(t[-1])[0][:k].tolist()
                    at = np.unique(np.array(some, np.int64))
                    if len(at):
                        best.add(i, [None] * len(at), block.score(at, t))
                yield row(ids, sizes, terms, lengths, docs, values, joint, [], [])
        seeds = [(i, -x[0]) for i, every in best.kept.items() for x in every]
        yield row(*([],) * 7, [i for i, _ in seeds], [s for _, s in seeds])

    return index.mapInArrow(weigh, _IMPACT_SCHEMA)


def _best(df: DataFrame, key: str, order: list, spread: str, k: int) -> DataFrame:
    """The first k rows of each key, with rank from 1; first among the rows of each key and salt, so no key's rows meet in one task before."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    some = salted.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))).where(F.col("_n") <= k).drop("_n", "_salt")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def _search(impacts: DataFrame, items, thresholds, k: int, with_pairs: bool = True) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, found = items.value, Found(k, thresholds.value.copy())
        for batch in batches:
            for r in range(batch.num_rows):
                ids, terms, lengths, docs, values, joint = (_numpy(batch.column(c), r) if c else batch.column(0)[r].as_py() for c in range(6))
                if ids:
                    search_block(Block(terms, lengths, docs, values, len(ids)), ids, run, joint if with_pairs else None, found)
        rows = [(i, x[3], -x[0]) for i, every in found.kept.items() for x in every]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["item", "doc_id", "score"])

    return impacts.select("ids", "terms", "lengths", "docs", "values", "joint").mapInArrow(search, "item int, doc_id long, score long")


def _runs(items: DataFrame) -> Iterator[list]:
    """The items (item_id, text) in runs of ITEM_BYTES of text or so, or one item."""
    sized = items.withColumn("_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8)
    if (sized.agg(F.sum("_bytes")).first()[0] or 0) <= ITEM_BYTES:
        yield items.collect()
        return
    summed = materialise(running_sums(numbered(sized, ["item_id"]), "number", ["_bytes"]).withColumn("_run", F.expr(f"(sum__bytes - 1) div {ITEM_BYTES}")).select("item_id", "text", "_run"), "items")
    for r in range(summed.agg(F.max("_run")).first()[0] + 1):
        yield summed.where(F.col("_run") == r).select("item_id", "text").collect()


def rank_documents(df: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id (its type kept), rank, doc_id (long), score: each item's k best documents with a score above 0.

    Null and empty texts have no terms: such documents are never found and such items find nothing. Document ids must cast to long; of equal scores null ids
    come last, and repeated rows each take a rank. Items are rows: rows of one id are ranked each by itself. Empty tables give
    an empty result; other columns aren't read.
    """
    spark = df.sparkSession
    out = None
    for rows in _runs(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))):
        one = _rank_run(df, rows, k, id_col, text_col)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {items.schema[item_id].dataType.simpleString()}")
        ranked = one.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.union(ranked)
    return out


def index_impacts(df: DataFrame, rows: list, k: int, id_col: str, text_col: str) -> tuple[DataFrame, Items]:
    """The written index of a run of items (rows with item_id and text), and the run with its weights."""
    context = df.sparkSession.sparkContext
    w = terms_of([(r["text"] or "").encode() for r in rows])
    each = [{w.bytes(j) for j in range(w.first[i], w.first[i + 1])} for i in range(len(rows))]
    vocabulary = Vocabulary.of(set().union(*each))
    index = materialise(_blocks(df, id_col, text_col, context.broadcast(vocabulary)), "postings")
    held = F.filter("sizes", lambda n: n > 0)
    counts = index.agg(F.sum(F.size(held)).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n)).alias("l")).first()
    n, total = counts["n"] or 0, counts["l"] or 0
    df_rows = index.select(F.explode(F.arrays_zip("terms", "lengths")).alias("t")).groupBy("t.terms").agg(F.sum("t.lengths").alias("df")).collect()  # a row for each of the run's terms
    weights = np.zeros(len(vocabulary.terms), np.int64)
    for r in df_rows:
        weights[r["terms"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1)))
    run = Items([[vocabulary.numbers[t] for t in terms] for terms in each], weights, n, total)
    return materialise(_impacts(index, context.broadcast(run), k), "impacts"), run


def first_thresholds(impacts: DataFrame, run: Items, k: int) -> np.ndarray:
    seeds = impacts.select(F.explode(F.arrays_zip("seed_items", "seed_scores")).alias("s")).select(F.col("s.seed_items").alias("item"), F.col("s.seed_scores").alias("score"))
    out = np.ones(len(run.terms), np.int64)
    spread = seeds.withColumn("place", F.monotonically_increasing_id())
    for r in _best(spread, "item", [F.desc("score")], "place", k).where(F.col("rank") == k).collect():  # a row for each item
        out[r["item"]] = max(1, r["score"])
    return out


def _rank_run(df: DataFrame, rows: list, k: int, id_col: str, text_col: str) -> DataFrame:
    context = df.sparkSession.sparkContext
    impacts, run = index_impacts(df, rows, k, id_col, text_col)
    found = _search(impacts, context.broadcast(run), context.broadcast(first_thresholds(impacts, run, k)), k)
    return _best(found, "item", [F.desc("score"), F.asc_nulls_last("doc_id")], "doc_id", k)


def op12_pair_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
