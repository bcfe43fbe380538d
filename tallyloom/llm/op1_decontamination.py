"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The benchmark's items are cut into gapped grams: two runs of n / 2 words with 0 to GAP words of any kind between them
   (items of fewer than n words: their whole sequence). A gram's hash doesn't say how wide its gap is, so words changed, added or
   left out between the runs don't hide it. Each gram's documents are counted over the whole corpus. What counts as a copy
   keeps at least 1 / KEPT of an item's grams (t of G). Any such copy then holds one of the G - t + 1 rarest: these are the item's seeds, and the most frequent t - 1,
   which match half the corpus in vain, are none. An item whose grams are all frequent still has its rarest.
2. Corpus tasks look grams up in bit arrays, of all grams and of the seeds, one pair for each class of item lengths. A
   stretch of hits of one class with at least t distinct grams and a seed is a passage, as wide to either side as the class's
   longest item, so a long item doesn't widen the others' passages. The arrays' sizes have a fixed bound, whatever the
   benchmark, and only pre-select: passages are joined to items by the seeds' 64-bit hashes.
3. Pairs of passage and item that share a seed are bounded by the item's words that the passage holds at all, which loses
   none: a stock phrase alone reaches no threshold. The rest are aligned by words (Smith-Waterman: match 2, mismatch -1,
   gap -1); the score over that of the whole item is the coverage, and pairs that reach the threshold are contaminated.

Words are lower-cased runs of characters other than ASCII white space and punctuation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bits import bit_filters, can_hold
from .shared import materialise, passing, table
from .words import U, Words, chunks, mix, shingles, slices, words

N = 4
GAP = 3
KEPT = 16
MIN_COVERAGE = 0.5
MATCH, MISMATCH, SKIP = 2, 1, 1
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TABLE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


def _lowered(column) -> list[bytes]:
    return [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in column.to_pylist()]


def _words(texts: list[bytes]) -> Words:
    return words(texts, _TABLE)


def gapped(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all pairs of word runs, of n words together, with 0 to GAP words between them within one text, and the number of
    the word each begins with; in order of that."""
    half, size = n // 2, len(w.hashes)
    runs = {k: np.zeros(max(0, size - k + 1), U) for k in {half, n - half}}
    for k, h in runs.items():
        for j in range(k):
            with np.errstate(over="ignore"):
                h[:] = mix(h * U(0xFF51AFD7ED558CCD) + w.hashes[j : j + len(h)])
    owner = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    found, first = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for gap in range(GAP + 1):
        count = size - n - gap + 1
        if count > 0:
            at = np.flatnonzero(owner[:count] == owner[n + gap - 1 :])
            with np.errstate(over="ignore"):
                found.append(mix(runs[half][at] * U(0xC4CEB9FE1A85EC53) + runs[n - half][at + half + gap]))
            first.append(at)
    order = np.argsort(np.concatenate(first), kind="stable")
    return np.concatenate(found)[order], np.concatenate(first)[order]


def _least_kept(grams):
    """t: the distinct grams of an item's `grams` that a copy of it holds at least."""
    return F.greatest(F.lit(1), F.floor(grams / KEPT)).cast("int")


def item_grams(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct grams of the items: item_id, gram, n (the gram's words), item_words, and grams (the item's number of them)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            items, grams, sizes, widths = [], [], [], []
            for at, run in chunks(_lowered(batch.column(1))):
                w = _words(run)
                count = np.diff(w.first)
                for k in range(1, n + 1):
                    h, first = shingles(w, k) if k < n else gapped(w, n)
                    owner = np.searchsorted(w.first, first, "right") - 1
                    mine = count[owner] >= n if k == n else count[owner] == k
                    items.append(owner[mine] + at)
                    grams.append(h[mine])
                    sizes.append(count[owner[mine]])
                    widths.append(np.full(int(mine.sum()), k))
            cat = lambda x, t=pa.int64(): pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), t)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(cat(items)), cat([g.view(np.int64) for g in grams]), cat(widths), cat(sizes)],
                names=["item_id", "gram", "n", "item_words"],
            )

    found = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col)).mapInArrow(cut, "item_id long, gram long, n long, item_words long").distinct()
    # repeated rows of one item are one item; different texts under one id count together
    return found.withColumn("grams", F.count(F.lit(1)).over(Window.partitionBy("item_id", "item_words")))


@dataclass
class LengthClass:
    """Items of about one length: the words in a gram, whether it has a gap, the longest item, t, and the bits of all grams and of the seeds."""

    n: int
    gaps: bool
    longest: int
    least: int
    grams: Broadcast
    seeds: Broadcast | None = None


def _class(n: int):
    """A number for the items of each length below n words, and for each doubling beyond."""
    words = F.col("item_words")
    return F.when(words < n, words).otherwise(n + F.floor(F.log2(words.cast("double")))).cast("int")


def length_classes(grams: DataFrame, n: int) -> dict[int, LengthClass]:
    """Classes of the items in `grams`, which has a column class: one for each doubling of the length."""
    rows = grams.groupBy("class").agg(F.max("n").alias("n"), F.max("item_words").alias("longest"), F.min(_least_kept(F.col("grams"))).alias("least")).collect()  # about log2 of the longest item
    bits = bit_filters(grams, "class", "gram")
    return {r["class"]: LengthClass(r["n"], r["n"] == n, r["longest"], r["least"], bits[r["class"]]) for r in rows}


def _hits(w: Words, hashed: dict[int, tuple[np.ndarray, np.ndarray]], c: LengthClass) -> tuple[np.ndarray, np.ndarray]:
    if c.n not in hashed:
        hashed[c.n] = gapped(w, c.n) if c.gaps else shingles(w, c.n)
    h, first = hashed[c.n]
    at = np.flatnonzero(can_hold(h, c.grams.value)) if len(h) else np.zeros(0, np.int64)
    return h[at], first[at]


def document_counts(df: DataFrame, text_col: str, classes: list[LengthClass]) -> DataFrame:
    """gram, n_docs: in how many rows of df each gram is that the bit arrays let through; summed up in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [np.zeros(0, U)]
            for _, run in chunks(_lowered(batch.column(0))):
                w, hashed = _words(run), {}
                for c in classes:
                    h, first = _hits(w, hashed, c)
                    owner = np.searchsorted(w.first, first, "right")
                    order = np.lexsort((h, owner))
                    h, owner = h[order], owner[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                    found.append(h[new])
            grams, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], names=["gram", "n"])

    return df.select(text_col).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n_docs"))


def rare_seeds(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """Of each item's grams (item_id, gram, grams, ...) the grams - t + 1 in fewest documents."""
    rank = F.row_number().over(Window.partitionBy("item_id", "item_words").orderBy(F.coalesce("n_docs", F.lit(0)), "gram"))
    return grams.join(counts, "gram", "left").withColumn("_rank", rank).where(F.col("_rank") <= F.col("grams") - _least_kept(F.col("grams")) + 1).drop("_rank", "n_docs")


_PASSAGE = "doc_id long, key long, first_word long, passage string, grams array<long>, places array<int>"


def passages(df: DataFrame, id_col: str, text_col: str, classes: list[LengthClass]) -> DataFrame:
    """Stretches of words around the hits of each text, with their seeds and those's places in the stretch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, first_words, text, grams, places = [], [], [], [], []
            for at, run in chunks(_lowered(batch.column(2))):
                w, hashed = _words(run), {}
                for c in classes:
                    g, p = _hits(w, hashed, c)
                    if not len(g):
                        continue
                    owner = np.searchsorted(w.first, p, "right") - 1
                    edges = np.flatnonzero((np.diff(owner) > 0) | (np.diff(p) > c.longest)) + 1
                    seed = can_hold(g, c.seeds.value)
                    for a, b in zip([0, *edges], [*edges, len(p)], strict=True):
                        mine = a + np.flatnonzero(seed[a:b])
                        if not len(mine) or b - a < c.least or len(np.unique(g[a:b])) < c.least:
                            continue
                        doc = owner[a]
                        lo, hi = max(w.first[doc], p[mine[0]] - c.longest), min(w.first[doc + 1], p[mine[-1]] + c.n + GAP + c.longest)
                        rows.append(at + doc)
                        first_words.append(lo - w.first[doc])
                        text.append(w.text(lo, hi))
                        grams.append(g[mine].view(np.int64))
                        places.append((p[mine] - lo).astype(np.int32))
            where = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(where), batch.column(1).take(where), pa.array(first_words, pa.int64()), pa.array(text, pa.string()), pa.array(grams, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                names=["doc_id", "key", "first_word", "passage", "grams", "places"],
            )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col)).mapInArrow(cut, _PASSAGE)


def smith_waterman(a: np.ndarray, b: np.ndarray) -> int:
    """The best local alignment score of two word sequences; one row of the table at a time."""
    best, slope = 0, SKIP * np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        step = np.maximum(row - SKIP, 0)
        step[1:] = np.maximum(step[1:], row[:-1] + np.where(b == x, MATCH, -MISMATCH))
        row = np.maximum.accumulate(step + slope) - slope
        best = max(best, int(row.max()))
    return best


def align(pairs: DataFrame, min_coverage: float = 0.0) -> DataFrame:
    """Scores for rows of doc_id, key, item_id, item_text, passage, first_word, lo, hi, n_seeds.

    Pairs whose coverage must be below min_coverage, since the passage lacks too many of the item's words, get 0.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            texts, items = _lowered(c["passage"]), _lowered(c["item_text"])
            lo, hi = c["lo"].to_pylist(), c["hi"].to_pylist()
            got, size = [], []
            known = {t: _words([t]).hashes for t in set(items)}
            for i in range(len(texts)):
                p, t = _words([texts[i]]).hashes, known[items[i]]
                p = p[max(0, lo[i] - len(t)) : hi[i] + len(t)]
                most = int(np.isin(t, p).sum())
                got.append(smith_waterman(t, p) if most >= min_coverage * len(t) else 0)
                size.append(len(t))
            got, size = np.array(got, np.int64), np.array(size, np.int64)
            yield pa.RecordBatch.from_arrays(
                [c["doc_id"], c["key"], c["item_id"], c["n_seeds"], pa.array(got), pa.array(got / np.maximum(1, MATCH * size)), c["first_word"]], names=["doc_id", "key", "item_id", "n_seeds", "score", "coverage", "passage_start"]
            )

    return pairs.select("doc_id", "key", "item_id", "n_seeds", "passage", "item_text", "first_word", "lo", "hi").mapInArrow(score, "doc_id long, key long, item_id long, n_seeds long, score long, coverage double, passage_start long")


def contaminated(df: DataFrame, benchmark: DataFrame, n: int = N, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of text and benchmark item whose alignment covers at least `min_coverage` of the item.

    Returns one row for each id, text and item: doc_id, key (the text's xxhash64), item_id, n_seeds, score, coverage,
    passage_start (in words), of the best passage. An item of fewer than n words is found where all its words stand in a
    row. A copy that keeps fewer than 1 / KEPT of an item's gapped grams isn't found: a test holds the share of those against alignment alone. Null or empty texts and items match nothing; null ids
    are kept; repeated rows give one row; empty tables give none; other columns aren't read. Ids of both tables must cast to long.
    """
    grams = materialise(item_grams(benchmark, n, item_col, item_text_col).withColumn("class", _class(n)), "grams")
    by_class = length_classes(grams, n)
    classes = list(by_class.values())
    seeds = materialise(rare_seeds(grams, document_counts(df, text_col, classes)), "seeds")
    for k, bits in bit_filters(seeds, "class", "gram").items():
        by_class[k].seeds = bits
    found = materialise(passages(df, id_col, text_col, classes).withColumn("p", F.monotonically_increasing_id()), "passages")
    hits = found.select("p", F.explode(F.arrays_zip("grams", "places")).alias("g")).select("p", F.col("g.grams").alias("gram"), F.col("g.places").alias("place"))
    pairs = hits.join(seeds.select("gram", "item_id").distinct(), "gram").groupBy("p", "item_id").agg(F.count_distinct("gram").alias("n_seeds"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("item_text")).distinct()
    full = pairs.join(found.drop("grams", "places"), "p").join(items, F.col("item_id").eqNullSafe(F.col("item")))
    best = align(full, min_coverage).where(F.col("coverage") >= min_coverage).groupBy("doc_id", "key", "item_id").agg(F.max(F.struct("coverage", "score", "n_seeds", "passage_start")).alias("b"))
    return best.select("doc_id", "key", "item_id", "b.n_seeds", "b.score", "b.coverage", "b.passage_start")


def drop_contaminated(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of df that hold no benchmark item, with their columns as they are.

    Rows with a null or empty text stay, and so do rows with a null id that hold no item; repeated rows stay or go together;
    an empty table gives an empty one.
    """
    with passing(df.sparkSession):
        found = materialise(contaminated(df, benchmark).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "leaks", keep=True)
    return df.join(found, df["doc_id"].eqNullSafe(found["_id"]) & F.xxhash64(df["text"]).eqNullSafe(found["_key"]), "left_anti")


def op1_seeded_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_seeds", "score", F.round("coverage", 6).alias("coverage"), "passage_start")
