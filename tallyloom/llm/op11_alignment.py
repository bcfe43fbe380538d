"""Cross-tokenizer alignment, with pair counts in dense vectors under a minimal perfect hash.

Two tokenizers cut the same bytes. Token A and token B are linked where their byte ranges overlap; a group ends where
tokens of both end. How many documents hold an id pair linked is a statistic of the whole corpus:

1. First pass: Arrow tasks align documents and sum up (pair, documents) for what they have read; these partial sums are written.
2. The distinct pairs fall into buckets by a hash. Each bucket's minimal perfect hash is built in its own task, and a pair's index is
   its bucket's first index and its slot there. The keys, in index order, verify every lookup.
3. Tasks add their partial sums into a dense vector by index and send the segments that they touched; segments are summed as a
   tree, TREE vectors at a time, so no task holds more than TREE of them.
4. Second pass: documents are aligned again and every link's count is looked up by its index.

Vectors and hash functions are broadcast in rounds of at most `max_keys` pairs, which bounds what a task holds: a corpus with more
distinct pairs takes more rounds of step 3 and 4, and each document's sums are added up over the rounds.

A unit is a stretch of text that begins with a space after something other than white space. Neither tokenizer has a token across
such a place, so a unit's groups don't depend on its document, and those of units that recur are computed once. Texts
with white space other than ASCII's, or whose units don't give back their bytes, are aligned as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, table
from .words import U, Words, blocks, chunks, mix, same_words, slices, word_hashes

VOCABULARIES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
CACHE_UNITS = 400_000
TOGETHER = 2000
SHORT = 1000
WHITE = b" \t\n\r\x0b\x0c"
MAX_KEYS = 1 << 22
BUCKET_KEYS = 1 << 14
SEGMENT = 1 << 16
TREE = 16
PENDING = 1 << 20  # partial sums that a task of the first pass holds
ID_BITS = 32  # of the second id of a pair's key

_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")  # white space beyond WHITE


def _path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a: str, b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(_path(a))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=_path(b))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet: these stand for themselves
        letters = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(plain))}
        names = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [bytes(letters[c] for c in names[i]) if all(c in letters for c in names.get(i, "\0")) else b"" for i in range(max(names) + 1)]
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        # the same vocabulary and pattern in the quicker of two libraries, for many short units at once
        self.units = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.a_bytes) if t}, special_tokens={})
        self.a_size, self.b_size = np.array([len(t) for t in self.a_bytes]), np.array([len(t) for t in self.b_bytes])
        # each id in decimal with what can follow it: A's ids "," or "|", B's "," or ";"
        self.written = [b"%d%s" % (i, e) for i in range(len(self.a_bytes)) for e in (b",", b"|")] + [b"%d%s" % (i, e) for i in range(len(self.b_bytes)) for e in (b",", b";")]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and their numbers in each text, for A and for B, of texts that begin with a space; which texts both give back: others get no ids."""
        parts = [self._together(texts[at : at + TOGETHER]) for at in range(0, len(texts), TOGETHER)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4 + (np.zeros(0, bool),)

    def _together(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts encoded as one, where each but the first begins a unit: then its ids are its own. Where bytes are lost, each by itself."""
        want = b"".join(texts)
        joined = want.decode("utf-8", "surrogatepass")
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        short = sizes.max() <= SHORT
        a = self.units.encode_ordinary(joined) if short else self.a.encode(joined, add_special_tokens=False).ids
        b = self.b.encode(joined[1:], num_threads=1)
        own = len(texts) == 1 or short and not any(t[-1] in WHITE for t in texts[:-1])
        if own and b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, b)):
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            ends, cuts = np.cumsum(sizes), []
            for size, ids in ((self.a_size, a), (self.b_size, b)):
                upto = np.cumsum(size[ids])
                cuts.append(np.searchsorted(upto, ends, "right"))
                own = own and bool((upto[cuts[-1] - 1] == ends).all())
            if own:
                return a, np.diff(cuts[0], prepend=0), b, np.diff(cuts[1], prepend=0), np.ones(len(texts), bool)
        if len(texts) == 1:
            none = np.zeros(0, np.int64)
            return none, np.zeros(1, np.int64), none, np.zeros(1, np.int64), np.zeros(1, bool)
        return tuple(np.concatenate(x) for x in zip(*(self._together([t]) for t in texts), strict=True))


@lru_cache(maxsize=1)
def _pair(a: str, b: str) -> Pair:
    return Pair(a, b)


@dataclass
class Aligned:
    """Of each unit: its numbers of ids, groups and links, whether its bytes are given back, its groups in writing, and its links' keys."""

    counts: np.ndarray  # n_a, n_b, n_groups, n_links of each unit
    ok: np.ndarray
    written: list[bytes]
    first: np.ndarray  # of each unit, the place of its first link in keys
    keys: np.ndarray

    @staticmethod
    def none() -> Aligned:
        return Aligned(np.zeros((0, 4), np.int64), np.zeros(0, bool), [], np.zeros(0, np.int64), np.zeros(0, np.int64))

    def and_(self, more: Aligned) -> Aligned:
        return Aligned(np.concatenate([self.counts, more.counts]), np.concatenate([self.ok, more.ok]), self.written + more.written, np.concatenate([self.first, more.first + len(self.keys)]), np.concatenate([self.keys, more.keys]))


def align(pair: Pair, texts: list[bytes]) -> Aligned:
    """Align texts that begin with a space, each by itself.

    The elementary stretches between all ends of tokens are the links: each lies in one token of either kind, and two tokens
    that overlap have one of them in common.
    """
    ids_a, n_a, ids_b, n_b, ok = pair.encode(texts)
    ends_a, ends_b = np.cumsum(pair.a_size[ids_a]), np.cumsum(pair.b_size[ids_b])
    last = np.concatenate([[0], ends_a])[np.cumsum(n_a)]  # each text's end
    every = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    twice = np.append(every[1:] == every[:-1], False)[: len(every)]
    joint, every = every[twice], every[~twice]
    keys = (ids_a[np.searchsorted(ends_a, every)] << ID_BITS) | ids_b[np.searchsorted(ends_b, every)]
    upto = np.searchsorted(every, last, "right")
    n_links, n_groups = np.diff(upto, prepend=0), np.diff(np.searchsorted(joint, last, "right"), prepend=0)
    group_a, group_b = np.searchsorted(joint, ends_a), np.searchsorted(joint, ends_b)
    say = np.zeros(len(ids_a) + len(ids_b), np.int64)
    say[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)] = 2 * ids_a + (joint[group_a] == ends_a)
    say[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")] = 2 * (ids_b + len(pair.a_bytes)) + (joint[group_b] == ends_b)
    parts = list(map(pair.written.__getitem__, say.tolist()))
    cuts = np.concatenate([[0], np.cumsum(n_a + n_b)])
    return Aligned(np.stack([n_a, n_b, n_groups, n_links], axis=1), ok, [b"".join(parts[i:j])[:-1] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], upto - n_links, keys)


def units(texts: list[bytes]) -> Words:
    """The units of texts, each text with a space before it."""
    buffer = b"".join(b" " + t for t in texts) + b" " * 8
    x = np.frombuffer(buffer, np.uint8)[:-8]
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    white = (x == 32) | ((x >= 9) & (x <= 13))
    begins = (x == 32) & ~np.concatenate([[True], white[:-1]])
    begins[offsets[:-1]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(x))
    return Words(buffer, starts, ends, word_hashes(buffer, starts, ends), np.searchsorted(starts, offsets))


class Aligner:
    """Aligns chunks of texts; keeps what it knows of CACHE_UNITS units."""

    def __init__(self, a: str, b: str):
        self.pair = _pair(a, b)
        self.clear()

    def clear(self) -> None:
        self.known, self.hashes, self.at, self.sizes = Aligned.none(), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.buffer, self.begin = b" " * 8, np.zeros(0, np.int64)  # the units' bytes, and where each is

    def chunk(self, texts: list[str]) -> tuple[Aligned, np.ndarray, np.ndarray]:
        """Units, the numbers of the units that the texts consist of, and for each text the place of its first (one entry more than texts).

        Null and empty texts have none, nor have texts that a tokenizer doesn't give back.
        """
        every = [t.encode("utf-8", "surrogatepass") for t in texts]
        whole = [bool(t) and (t[-1] in WHITE or bool(_ODD_SPACE.search(s))) for s, t in zip(texts, every, strict=True)]
        w = units([b"" if x else t for t, x in zip(every, whole, strict=True)])
        distinct, first, which = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_UNITS:
            self.clear()
        at = np.searchsorted(self.hashes, distinct)
        seen = at < len(self.hashes)
        seen[seen] = self.hashes[at[seen]] == distinct[seen]
        size = (w.ends - w.starts)[first]
        # up to eight bytes, hash and size tell units apart
        long = np.flatnonzero(seen & (size > 8))
        old, mine = self.begin[at[long]], w.starts[first[long]]
        same = zip(blocks(self.buffer, old, old + size[long]), blocks(w.buffer, mine, mine + size[long]), strict=True)
        if not same_words(w, first[which]) or (self.sizes[at[seen]] != size[seen]).any() or not all((x == y).all() for (_, x), (_, y) in same):
            whole = [bool(t) for t in texts]  # two units of one hash
        else:
            new = np.flatnonzero(~seen)
            if len(new):
                found = [w.bytes(i) for i in first[new]]
                number = len(self.known.ok) + np.arange(len(new))
                self.known = self.known.and_(align(self.pair, found))
                begin = len(self.buffer) - 8 + np.cumsum(size[new]) - size[new]
                self.buffer = self.buffer[:-8] + b"".join(found) + b" " * 8
                h = np.concatenate([self.hashes, distinct[new]])
                order = np.argsort(h, kind="stable")
                self.hashes = h[order]
                self.at, self.sizes, self.begin = (np.concatenate(x)[order] for x in ((self.at, number), (self.sizes, size[new]), (self.begin, begin)))
                at = np.searchsorted(self.hashes, distinct)
            which = self.at[at][which]
            bad = np.flatnonzero(~self.known.ok[which])
            for i in np.unique(np.searchsorted(w.first, bad, "right") - 1) if len(bad) else ():
                whole[i] = bool(texts[i])
        plain = np.array([bool(t) and not x for t, x in zip(texts, whole, strict=True)], bool)
        rest = [i for i, x in enumerate(whole) if x]
        if not rest:
            return self.known, which[np.repeat(plain, np.diff(w.first))], np.concatenate([[0], np.cumsum(np.where(plain, np.diff(w.first), 0))])
        out = self.known.and_(align(self.pair, [b" " + every[i] for i in rest]))
        number = dict(zip(rest, range(len(self.known.ok), len(out.ok)), strict=True))
        each = [which[w.first[i] : w.first[i + 1]] if plain[i] else np.array([number[i]] if i in number and out.ok[number[i]] else [], np.int64) for i in range(len(texts))]
        return out, np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])


def _links(known: Aligned, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of some units' links, one unit after the other, and how many each has."""
    n = known.counts[of, 3]
    return known.keys[np.repeat(known.first[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in slices(batches):
        texts = [t or "" for t in batch.column(column).to_pylist()]
        sizes = [t.encode("utf-8", "surrogatepass") for t in texts]
        for at, run in chunks(sizes):
            yield batch.slice(at, len(run)), texts[at : at + len(run)]


def pair_documents(df: DataFrame, text_col: str = "text", vocabularies: tuple[str, str] = VOCABULARIES) -> DataFrame:
    """key, n: partial sums, over what each task has read, of how many documents hold a pair linked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, pending, size = Aligner(*vocabularies), [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([k for k, _ in pending]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([n for _, n in pending]), len(keys)).astype(np.int64)

        for _, texts in _texts(batches, 0):
            known, of, first = aligner.chunk(texts)
            owner = np.repeat(np.arange(len(texts)), np.diff(first))
            each = np.unique(owner * len(known.ok) + of)  # a document's distinct units
            keys, n = _links(known, each % max(1, len(known.ok)))
            distinct, place = np.unique(keys, return_inverse=True)
            documents = np.repeat(each // max(1, len(known.ok)), n)
            held = np.unique(documents * len(distinct) + place) % max(1, len(distinct))
            pending.append((distinct, np.bincount(held, minlength=len(distinct))))
            size += len(distinct)
            if size > PENDING:
                pending = [summed()]
                size = len(pending[0][0])
                if size > PENDING // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in pending[0]], names=["key", "n"])
                    pending, size = [], 0
        if pending:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], names=["key", "n"])

    return df.select(F.col(text_col)).mapInArrow(count, "key long, n long")


# --- minimal perfect hash ---------------------------------------------------------------------------------------------


def _place(keys: np.ndarray, level: int, sizes: np.ndarray) -> np.ndarray:
    return (mix(keys.view(U) ^ (U(0x9E3779B97F4A7C15) * U(level + 1) & U(0xFFFFFFFFFFFFFFFF))) % sizes.astype(U)).astype(np.int64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(mix(keys.view(U)) + U(0x632BE59BD9B4E019)) % U(buckets)).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct keys: its levels' sizes in bits, the bits of all levels, and the keys in order of their index.

    In each level of twice as many bits as keys that are left, the keys alone at their place are set there; the others go on.
    A key's index is the number of bits set before its own.
    """
    sizes, bits, order, left = [], [], [], keys
    while len(left):
        size = 2 * len(left) + 1
        with np.errstate(over="ignore"):
            at = _place(left, len(sizes), np.full(len(left), size))
        alone = np.bincount(at, minlength=size) == 1
        settled = alone[at]
        order.append(left[settled][np.argsort(at[settled])])
        sizes.append(size)
        bits.append(alone)
        left = left[~settled]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool), np.concatenate(order) if order else keys


class PairIndex:
    """The minimal perfect hashes of a round's buckets, and the keys that verify them."""

    def __init__(self, first: int, buckets: int, rows: list):
        """rows: (bucket, sizes, packed bits, keys) of the buckets from `first` on that have keys, of `buckets` in all."""
        self.first, self.buckets = first, buckets
        rows = sorted(rows, key=lambda r: r[0])
        levels = max((len(r[1]) for r in rows), default=0)
        span = 1 + max((r[0] for r in rows), default=first) - first
        self.sizes = np.zeros((span, levels), np.int64)
        for b, sizes, _, _ in rows:
            self.sizes[b - first, : len(sizes)] = sizes
        flat = self.sizes.reshape(-1)
        self.starts = (np.cumsum(flat) - flat).reshape(self.sizes.shape)
        bits = np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8), count=sum(s), bitorder="little") for _, s, p, _ in rows]) if rows else np.zeros(0, np.uint8)
        self.bits = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64, np.uint8)]), bitorder="little").view(U)
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.keys = np.concatenate([np.frombuffer(k, np.int64) for _, _, _, k in rows]) if rows else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Each key's index, -1 for keys of other rounds or none."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        bucket = bucket_of(keys, self.buckets) - self.first
        left = np.flatnonzero((bucket >= 0) & (bucket < len(self.sizes)))
        with np.errstate(over="ignore"):
            for level in range(self.sizes.shape[1]):
                sizes = self.sizes[bucket[left], level]
                left, sizes = left[sizes > 0], sizes[sizes > 0]
                if not len(left):
                    break
                at = self.starts[bucket[left], level] + _place(keys[left], level, sizes)
                word, low = self.bits[at >> 6], (at & 63).astype(U)
                is_set = ((word >> low) & U(1)).astype(bool)
                rank = self.before[at >> 6] + np.bitwise_count(word & ((U(1) << low) - U(1)))
                out[left[is_set]] = rank[is_set]
                left = left[~is_set]
        held = np.flatnonzero(out >= 0)
        out[held[self.keys[out[held]] != keys[held]]] = -1
        return out


def _buckets(partial: DataFrame, buckets: int) -> DataFrame:
    """bucket, sizes, bits, keys: each bucket's minimal perfect hash, built in its own task."""

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_arrays([pa.array(bucket_of(batch.column(0).to_numpy(), buckets)), batch.column(0)], names=["bucket", "key"])

    def build(group: pa.Table) -> pa.Table:
        sizes, bits, keys = build_hash(group["key"].to_numpy())
        return pa.table([group["bucket"][:1], pa.array([sizes], pa.list_(pa.int64())), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), pa.array([keys.tobytes()], pa.binary())], names=["bucket", "sizes", "bits", "keys"])

    keyed = partial.select("key").distinct().mapInArrow(tag, "bucket long, key long")
    return keyed.groupBy("bucket").applyInArrow(build, "bucket long, sizes array<long>, bits binary, keys binary")


def _tree_sums(partial: DataFrame, index) -> DataFrame:
    """segment, counts: the dense vector of documents by index, cut into segments of SEGMENT entries of 8 bytes."""

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(len(index.value), np.int64)
        for batch in batches:
            at = index.value.index(batch.column(0).to_numpy())
            np.add.at(vector, at[at >= 0], batch.column(1).to_numpy()[at >= 0])
        source = TaskContext.get().partitionId()
        for segment, start in enumerate(range(0, len(vector), SEGMENT)):
            part = vector[start : start + SEGMENT]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([source]), pa.array([segment]), pa.array([part.tobytes()], pa.binary())], names=["source", "segment", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in group["counts"].to_pylist())
        return pa.table([group["source"][:1], group["segment"][:1], pa.array([total.tobytes()], pa.binary())], names=["source", "segment", "counts"])

    schema = "source long, segment long, counts binary"
    sums, sources = partial.mapInArrow(dense, schema), partial.rdd.getNumPartitions()
    while True:
        sums = sums.withColumn("source", F.expr(f"source div {TREE}")).groupBy("segment", "source").applyInArrow(add, schema)
        sources = -(-sources // TREE)
        if sources <= 1:
            return sums.select("segment", "counts")


@dataclass
class PairCounts:
    """Document counts of all linked id pairs: written tables, read round by round."""

    hashes: DataFrame  # bucket, sizes, bits, keys
    sums: list[DataFrame]  # of each round: segment, counts
    buckets: int
    rounds: list[tuple[int, int]]  # the buckets of each, from and below
    best: np.ndarray  # the highest count of each A id

    def index(self, r: int) -> PairIndex:
        lo, hi = self.rounds[r]
        got = self.hashes.where((F.col("bucket") >= lo) & (F.col("bucket") < hi)).select("bucket", "sizes", "bits", "keys").toArrow()  # `max_keys` pairs or so
        return PairIndex(lo, self.buckets, list(zip(*(got[c].to_pylist() for c in got.column_names), strict=True)))

    def counts(self, r: int) -> np.ndarray:
        got = self.sums[r].toArrow()
        parts = sorted(zip(got["segment"].to_pylist(), got["counts"].to_pylist(), strict=True))
        return np.concatenate([np.frombuffer(c, np.int64) for _, c in parts]) if parts else np.zeros(0, np.int64)


def count_pairs(df: DataFrame, text_col: str = "text", vocabularies: tuple[str, str] = VOCABULARIES, max_keys: int = MAX_KEYS) -> PairCounts:
    """How many documents hold each id pair linked. Every row is a document, repeated rows too."""
    spark = df.sparkSession
    partial = materialise(pair_documents(df, text_col, vocabularies), "pair_documents")
    distinct = partial.agg(F.approx_count_distinct("key", 0.02)).first()[0]
    # an estimate decides the number of buckets alone; a bucket's size varies anyway
    buckets = max(1, -(-distinct // BUCKET_KEYS))
    each = max(1, max_keys // BUCKET_KEYS)
    rounds = [(b, min(b + each, buckets)) for b in range(0, buckets, each)]
    out = PairCounts(materialise(_buckets(partial, buckets), "pair_hashes"), [], buckets, rounds, np.zeros(0, np.int64))
    for r in range(len(rounds)):
        index = out.index(r)
        out.sums.append(materialise(_tree_sums(partial, spark.sparkContext.broadcast(index)), "pair_sums"))
        counts, a = out.counts(r), index.keys >> ID_BITS
        best = np.zeros(max(len(out.best), int(a.max(initial=-1)) + 1), np.int64)  # as many entries as A has ids at most
        best[: len(out.best)] = out.best
        np.maximum.at(best, a, counts)
        out.best = best
    return out


_SUMS = ["n_best", "count_sum"]


def align_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabularies: tuple[str, str] = VOCABULARIES, max_keys: int = MAX_KEYS, with_groups: bool = False) -> DataFrame:
    """The id (its type kept), n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with_groups the groups in writing.

    A text is aligned with a space before it. Null and empty texts, and those that a tokenizer doesn't give back, have no tokens:
    zeros, and '' instead of a digest. Null ids and repeated rows are kept, each a document; an empty table gives an
    empty result; other columns aren't read.
    """
    spark = df.sparkSession
    pairs = count_pairs(df, text_col, vocabularies, max_keys)
    columns = ["n_a", "n_b", "n_groups", "n_links", *_SUMS]
    kind = df.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in columns) + ", groups_sha256 string" + ", groups string" * with_groups

    def one_round(r: int) -> DataFrame:
        looked_up = spark.sparkContext.broadcast((pairs.index(r), pairs.counts(r), pairs.best))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, counts, best = looked_up.value
            aligner = Aligner(*vocabularies)
            for batch, texts in _texts(batches, 1):
                known, of, first = aligner.chunk(texts)
                distinct, which = np.unique(of, return_inverse=True)
                keys, n = _links(known, distinct)
                at = index.index(keys)
                count = np.where(at >= 0, counts[np.maximum(at, 0)] if len(counts) else 0, 0)
                hit = (at >= 0) & (count == best[keys >> ID_BITS])
                sums = np.concatenate([[[0, 0]], np.cumsum(np.stack([hit, count], axis=1), axis=0)])
                ends = np.cumsum(n)
                per_unit = np.concatenate([known.counts[distinct], sums[ends] - sums[ends - n]], axis=1)
                total = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(per_unit[which], axis=0)])
                per_text = total[first[1:]] - total[first[:-1]]
                written = [b";".join(map(known.written.__getitem__, of[i:j].tolist())) for i, j in zip(first[:-1], first[1:], strict=True)]
                digests = [hashlib.sha256(x).hexdigest() if x else "" for x in written]
                arrays = [batch.column(0), *(pa.array(np.ascontiguousarray(per_text[:, i])) for i in range(6)), pa.array(digests, pa.string())]
                if with_groups:
                    arrays.append(pa.array([x.decode() for x in written], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *columns, "groups_sha256", *["groups"] * with_groups])

        return df.select(F.col(id_col), F.col(text_col)).mapInArrow(look_up, schema)

    out = one_round(0)
    if len(pairs.rounds) == 1:
        return out
    for r in range(1, len(pairs.rounds)):
        out = out.union(one_round(r))
    # rows of one id and the same groups have the same sums: what is added up is shared out among them
    fixed = [c for c in out.columns if c not in _SUMS]
    summed = out.groupBy(*fixed).agg(*(F.sum(c).alias(c) for c in _SUMS), (F.count(F.lit(1)) / len(pairs.rounds)).cast("int").alias("_rows"))
    return summed.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows")))).select(*fixed[:5], *(F.expr(f"{c} div _rows").alias(c) for c in _SUMS), *fixed[5:])


def op11_perfect_hash_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents")).withColumn("doc_id", F.col("doc_id").cast("long"))
