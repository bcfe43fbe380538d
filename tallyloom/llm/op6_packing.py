"""Best-fit packing planned on the histogram of lengths.

1. Every text is tokenised in Arrow tasks and cut into pieces of at most `capacity` ids; a piece is five numbers.
2. The histogram of piece lengths has at most `capacity` rows whatever the corpus. Best-fit decreasing runs over its
   counts on the driver: sequences with the same free space are one entry of the plan, and a run of equal pieces goes
   to the fullest sequences that still take it. The plan is a list of runs (length, first rank, sequences, pieces in
   each, first sequence, first offset); it follows the lengths that occur, not the number of documents.
3. Pieces get their rank within their length (a global row number in order of length, less the number of pieces of
   other lengths before it, so that no length is gathered in one task) and join the plan on length and rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, table, with_row_number
from .words import ASCII_LOWER, U, chunks, encoded, same_words, slices, words

CACHE_WORDS = 600_000
MAX_BROADCAST_RUNS = 200_000  # 48 bytes each
_PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLAN_SCHEMA = "length long, first_rank long, sequences long, each long, first_sequence long, first_offset long"


class WordIds:
    """Token ids of single words, kept in sorted arrays. Bounded: it starts anew beyond CACHE_WORDS words."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self) -> None:
        self.hashes, self.offset, self.length, self.ids = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.bytes: dict[int, bytes] = {}  # of each hash

    def _add(self, hashes: np.ndarray, found: list[bytes]) -> None:
        self.bytes.update(zip(hashes.tolist(), found, strict=True))
        each = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "surrogatepass") for t in found], add_special_tokens=False)]
        length = np.fromiter(map(len, each), np.int64, len(each))
        offset = len(self.ids) + np.cumsum(length) - length
        self.ids = np.concatenate([self.ids, np.fromiter((i for e in each for i in e), np.uint32, int(length.sum()))])
        h = np.concatenate([self.hashes, hashes])
        order = np.argsort(h, kind="stable")
        self.hashes, self.offset, self.length = h[order], np.concatenate([self.offset, offset])[order], np.concatenate([self.length, length])[order]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text; words that recur are tokenised once.

        A word here ends at white space, and before punctuation that follows an ASCII letter or digit: the tokenizer's
        own pattern splits there too, and it lower-cases, so joining the words' ids gives the text's ids. A text with
        a special token's "<|" is tokenised whole. Hashes only find words: where two words of the chunk, or one of it and a
        known one, share a hash and not their bytes, all the chunk's texts are tokenised whole.
        """
        w = words(texts, ASCII_LOWER, cut_after_alnum=True)
        distinct, first, which = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_WORDS:
            self.clear()
        at = np.searchsorted(self.hashes, distinct)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == distinct[known]
        if not same_words(w, first[which]) or any(self.bytes[h] != w.bytes(i) for h, i in zip(distinct[known].tolist(), first[known], strict=True)):
            return [self._whole(t) for t in texts]
        new = np.flatnonzero(~known)
        if len(new):
            self._add(distinct[new], [w.bytes(i) for i in first[new]])
            at = np.searchsorted(self.hashes, distinct)
        length = self.length[at][which]
        total = np.concatenate([[0], np.cumsum(length)])
        flat = self.ids[np.repeat(self.offset[at][which] - total[:-1], length) + np.arange(total[-1])]
        cuts = total[w.first]
        out = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i, t in enumerate(texts):
            if b"<|" in t:
                out[i] = self._whole(t)
        return out

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    return WordIds(Tokenizer.from_file(path))


def token_pieces(df: DataFrame, capacity: int, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts and cut them into pieces: doc_id, piece, start, length, ids_crc32.

    `vocabulary` is a path, or the bare name of a file of the installed public vocabularies, resolved on the executors.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _word_ids(vocabulary)
        for batch in slices(batches):
            texts = encoded(batch.column(1))
            rows: list[tuple] = []
            for at, run in chunks(texts):
                for i, x in enumerate(ids.encode(run), at):
                    x = np.append(x, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(x), capacity)):
                        part = x[start : start + capacity]
                        rows.append((i, piece, start, len(part), zlib.crc32(part.tobytes())))
            c = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(c[0], pa.int64())), pa.array(c[1], pa.int32()), *(pa.array(x, pa.int64()) for x in c[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(cut, _PIECE_SCHEMA)


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs of (length, first rank, sequences, each, first sequence, first offset)."""
    free: dict[int, list[tuple[int, int]]] = {}  # free space: runs of (first sequence, sequences)
    spaces = np.zeros(capacity + 1, bool)
    made, plan = 0, []

    def put(space: int, first: int, count: int) -> None:
        free.setdefault(space, []).append((first, count))
        spaces[space] = True

    for length in sorted((n for n in histogram if n > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            fits = np.flatnonzero(spaces[length:])
            if len(fits):
                space = length + int(fits[0])
                first, count = free[space].pop()
                if not free[space]:
                    del free[space]
                    spaces[space] = False
                # as many as one sequence takes: after the first, it is itself the fullest that still fits
                each = min(space // length, left)
                used = min(count, left // each)
                if used < count:
                    put(space, first + used, count - used)
            else:
                space, each = capacity, min(capacity // length, left)
                used = left // each
                first, made = made, made + used
            plan.append((length, rank, used, each, first, capacity - space))
            rank, left = rank + used * each, left - used * each
            if space > each * length:
                put(space - each * length, first, used)
    return plan


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give each piece (doc_id, piece, length, ...) a sequence_id and an offset in it.

    Pieces that tie in all columns take neighbouring places in any order. No pieces give an empty result.
    """
    spark = pieces.sparkSession
    kept = materialise(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = plan_best_fit(histogram, capacity)
    before, starts = 0, {}
    for length in sorted(histogram):
        starts[length], before = before, before + histogram[length]
    runs = spark.createDataFrame([(n, starts[n] + r, u, e, s, o) for n, r, u, e, s, o in plan], _PLAN_SCHEMA)
    ranked = with_row_number(kept, ["length", "doc_id", "piece"], "rank")
    inside = (F.col("p.length") == F.col("r.length")) & (F.col("p.rank") >= F.col("r.first_rank")) & (F.col("p.rank") < F.col("r.first_rank") + F.col("r.sequences") * F.col("r.each"))
    nth = F.col("p.rank") - F.col("r.first_rank")
    # a plan has a few runs for each length; a longer one than that is joined without the hint
    side = F.broadcast(runs) if len(plan) <= MAX_BROADCAST_RUNS else runs
    return ranked.alias("p").join(side.alias("r"), inside).select(
        "p.*",
        (F.col("r.first_sequence") + F.expr("(p.rank - r.first_rank) div r.each")).alias("sequence_id"),
        (F.col("r.first_offset") + (nth % F.col("r.each")) * F.col("r.length")).alias("offset"),
    )


def pack_documents(df: DataFrame, capacity: int = 4096, vocabulary: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Tokenise df's texts (null: empty) and pack them into sequences of at most `capacity` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset; every document gives at least one piece,
    since each ends with `end_id`. Repeated rows are packed as often as they occur; an empty table gives no rows; other
    columns aren't read. Ids must cast to long.
    """
    return pack(token_pieces(df, capacity, vocabulary, end_id), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
