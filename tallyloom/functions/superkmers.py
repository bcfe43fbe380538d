"""Counting k-mers through stretches of bases that share a minimiser.

Consecutive k-mers mostly have the same minimiser (the m-mer within them that comes first in a hashed order, the same for both
strands), so what is shuffled is stretches of several k-mers, two bits a base, to the bucket of their minimiser: a fraction of the
bytes of single codes. All occurrences of a k-mer meet in its bucket, where stretches are cut and counted.

What repeats is summed up before the shuffle: equal stretches of a chunk are one with a count, and k-mers whose minimiser is a repeat of one or two bases
(which come last in the order, so only such k-mers have one) are counted there and then.

The number of buckets grows with the bases, and a bucket is counted in pieces: of its k-mers, never more than MOST distinct ones
and as many occurrences are held at a time. A bucket of more is cut and counted once for each class of its k-mers, so what
grows with a frequent minimiser is its packed stretches alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .seq import _BASE, _codes, chunks

WORDS = 3  # of 32 bases each, for a stretch
CHUNK_BASES = 1 << 19
BUCKETS_EACH = 4  # buckets for each shuffle partition, at least
BASES_EACH = 1 << 20  # bases for each bucket
MOST_BUCKETS = 1 << 13  # beyond, buckets grow and are counted in classes
MOST = 1 << 20  # distinct k-mers (by key), and occurrences beside them, that are held at a time
SLICE = 1 << 18  # windows that are cut at a time
ROWS = 1 << 14  # rows of a batch that is given back

_REPEATS = np.uint64(1 << 63)


def flipped(codes: np.ndarray, k: int) -> np.ndarray:
    """Codes of the reverse complements: bases swapped in ever larger groups."""
    x = ~codes.view(np.uint64)
    for shift, keep in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        s, m = np.uint64(shift), np.uint64(keep)
        x = ((x >> s) & m) | ((x & m) << s)
    return (x >> np.uint64(64 - 2 * k)).view(np.int64)


def minimiser_length(k: int) -> int:
    return min(k, max(5, min(11, (k + 1) // 2)))


def _order(codes: np.ndarray, m: int) -> np.ndarray:
    """Each m-mer's value in the order, the same for both strands; repeats of one or two bases come last."""
    x = np.minimum(codes, flipped(codes, m)).view(np.uint64)
    repeat = ((x ^ (x >> np.uint64(4))) & np.uint64((1 << max(0, 2 * m - 4)) - 1)) == 0
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return np.where(repeat, (x >> np.uint64(1)) | _REPEATS, x >> np.uint64(1))


def minimisers(bases: np.ndarray, k: int) -> np.ndarray:
    """For each window of k bases (0 to 3), the least value of its m-mers, by doubling."""
    m = minimiser_length(k)
    value = _order(_codes(bases, m), m)
    width, need = 1, k - m + 1
    while 2 * width <= need:
        value = np.minimum(value[:-width], value[width:])
        width *= 2
    return np.minimum(value[: len(value) - (need - width)], value[need - width :])


def code_minimisers(codes: np.ndarray, k: int) -> np.ndarray:
    """The minimiser of each k-mer given as a code, as a long; the same for its reverse complement."""
    m = minimiser_length(k)
    return np.min([_order((codes >> 2 * j) & ((1 << 2 * m) - 1), m) for j in range(k - m + 1)], axis=0).view(np.int64)


def minimiser_column(code: Column, k: int) -> Column:
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for codes in batches:
            yield pd.Series(code_minimisers(codes.to_numpy(np.int64), k))

    return of(code)


def stretches(bases: np.ndarray, k: int, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each stretch of usable windows; and the windows that are repeats, apart."""
    value = minimisers(bases, k)
    repeat = usable & (value >= _REPEATS)
    plain = usable & ~repeat
    begins = plain & np.append(True, (value[1:] != value[:-1]) | ~plain[:-1])
    start = np.flatnonzero(begins)
    if len(start):
        at = np.flatnonzero(plain)
        n = np.diff(np.append(np.searchsorted(at, start), len(at)))
        most = 32 * WORDS - k + 1
        pieces = -(-n // most)
        which = np.repeat(np.arange(len(start)), pieces)
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, n = start[which] + piece * most, np.minimum(n[which] - piece * most, most)
    else:
        n = start
    return start, n, value[start], np.flatnonzero(repeat)


def packed(bases: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """WORDS words of 32 bases for each stretch of bases, the first base highest, zeros after its end."""
    padded = np.append(bases, np.zeros(32 * (WORDS + 1), np.uint8)).astype(np.uint64)
    part = padded
    for size in (1, 2, 4, 8, 16):
        part = (part[:-size] << np.uint64(2 * size)) | part[size:]
    out = np.empty((len(start), WORDS), np.uint64)
    for w in range(WORDS):
        left = np.clip(length - 32 * w, 0, 32)
        keep = np.where(left > 0, ~np.uint64(0) << (np.uint64(64) - np.uint64(2) * np.maximum(left, 1).astype(np.uint64)), np.uint64(0))
        out[:, w] = part[start + 32 * w] & keep
    return out


def unpacked(words: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the windows of packed stretches of n windows each, and the stretch of each."""
    which = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    padded = np.concatenate([words, np.zeros((len(words), 1), np.uint64)], axis=1)
    shift = (2 * (j % 32)).astype(np.uint64)
    first, second = padded[which, j // 32], padded[which, j // 32 + 1]
    joined = np.where(shift > 0, (first << shift) | (second >> ((np.uint64(64) - shift) & np.uint64(63))), first)
    return (joined >> np.uint64(64 - 2 * k)).view(np.int64), which


def _summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct combinations of the keys (the first is the main order), with their counts added up."""
    if not len(counts):
        return keys, counts
    order = np.lexsort(keys[::-1])
    keys = [x[order] for x in keys]
    new = np.append(True, np.any([x[1:] != x[:-1] for x in keys], axis=0))
    first = np.flatnonzero(new)
    return [x[first] for x in keys], np.add.reduceat(counts[order], first)


def bucketed(df: DataFrame, seq: str, key: str, k: int, buckets: int, canonical: bool) -> DataFrame:
    """bucket, and as arrays: words, n, keys, counts of stretches; codes, code_keys, code_counts of k-mers counted already.

    One row for each bucket and chunk. Windows with letters other than ACGT go; null sequences have none.
    """
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in chunks(batch.column(1), CHUNK_BASES):
                texts = [t.encode() if t else b"" for t in batch.column(1).slice(at, end - at).to_pylist()]
                whole = _BASE[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
                offsets = np.cumsum([len(t) + 1 for t in texts])
                # a sequence longer than a chunk is taken in pieces that overlap by k - 1 bases
                for lo in range(0, max(1, len(whole) - k + 1), CHUNK_BASES):
                    yield from pieces(whole[lo : lo + CHUNK_BASES + k - 1], batch.column(0), at, offsets, lo)

    def pieces(b: np.ndarray, keys, at: int, offsets: np.ndarray, lo: int) -> Iterator[pa.RecordBatch]:
        if len(b) < k:
            return
        bad = np.concatenate([[0], np.cumsum(b > 3)])
        bases = b & 3
        start, n, value, repeats = stretches(bases, k, bad[k:] == bad[:-k])
        row = lambda windows: np.searchsorted(offsets, lo + windows, "right")
        distinct = keys.slice(at, len(offsets)).dictionary_encode()
        number = distinct.indices.fill_null(len(distinct.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        names = pa.concat_arrays([distinct.dictionary, pa.nulls(1, distinct.dictionary.type)])
        words = packed(bases, start, n + k - 1)
        (bucket, w0, w1, w2, n, of), count = _summed([(value % np.uint64(buckets)).astype(np.int64), *words.T, n, number[row(start)]], np.ones(len(start), np.int64))
        codes = _codes(bases, k)[repeats]
        codes = np.minimum(codes, flipped(codes, k)) if canonical else codes
        # what is counted already goes where its code says: no stretch has such k-mers
        (there, codes, code_of), code_count = _summed([codes % buckets, codes, number[row(repeats)]], np.ones(len(repeats), np.int64))
        every = np.union1d(bucket, there)
        cuts, code_cuts = np.append(np.searchsorted(bucket, every), len(bucket)), np.append(np.searchsorted(there, every), len(there))
        lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(every.astype(np.int32)), lists(cuts * WORDS, pa.array(np.stack([w0, w1, w2], axis=1).reshape(-1).view(np.int64))), lists(cuts, pa.array(n.astype(np.int32))), lists(cuts, names.take(pa.array(of))), lists(cuts, pa.array(count)),
                lists(code_cuts, pa.array(codes)), lists(code_cuts, names.take(pa.array(code_of))), lists(code_cuts, pa.array(code_count)),
            ],
            names=["bucket", "words", "n", "keys", "counts", "codes", "code_keys", "code_counts"],
        )

    schema = f"bucket int, words array<long>, n array<int>, keys array<{kind}>, counts array<long>, codes array<long>, code_keys array<{kind}>, code_counts array<long>"
    return df.select(key, seq).mapInArrow(cut, schema)


def _class_of(code: np.ndarray, of: np.ndarray | None, classes: int) -> np.ndarray:
    """The class of each code (with `of`: of each pair) by the top bits of a hash, so that doubling the classes halves each."""
    with np.errstate(over="ignore"):
        x = code.view(np.uint64) if of is None else code.view(np.uint64) + of.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)) * np.uint64(classes) >> np.uint64(32)


def bucket_counts(batches: Iterator[pa.RecordBatch], k: int, canonical: bool, whole: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """A bucket's distinct (code, number of its key) with their counts, class by class and in order; and the keys by number.

    whole: all pairs of a code are in one class, which needs few keys.
    """
    parts = list(batches)
    flat = {c: pa.chunked_array([b.column(c).flatten() for b in parts]).combine_chunks() for c in ("words", "n", "keys", "counts", "codes", "code_keys", "code_counts")}
    del parts
    distinct = pa.chunked_array([flat.pop("keys"), flat.pop("code_keys")]).dictionary_encode().combine_chunks()
    names = pa.concat_arrays([distinct.dictionary, pa.nulls(1, distinct.dictionary.type)])
    number = distinct.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
    words, n, counts = flat["words"].to_numpy().view(np.uint64).reshape(-1, WORDS), flat["n"].to_numpy(), flat["counts"].to_numpy()
    ready, ready_counts = flat["codes"].to_numpy(), flat["code_counts"].to_numpy()
    ends = np.cumsum(n, dtype=np.int64)

    def cut() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        at = 0
        while at < len(n):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            codes, which = unpacked(words[at:end], n[at:end].astype(np.int64), k)
            yield np.minimum(codes, flipped(codes, k)) if canonical else codes, number[at:end][which].astype(np.int64), counts[at:end][which]
            at = end
        for at in range(0, len(ready), SLICE):
            yield ready[at : at + SLICE], number[len(n) + at : len(n) + at + SLICE].astype(np.int64), ready_counts[at : at + SLICE]

    def of_class(mine: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The sums of one class; None if it has more than MOST."""
        held, waiting = [(np.zeros(0, np.int64),) * 3], 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            code, of, count = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            (code, of), count = _summed([code, of], count)
            return code, of, count

        for code, of, count in cut():
            if classes > 1:
                some = _class_of(code, None if whole else of, classes) == mine
                code, of, count = code[some], of[some], count[some]
            held.append((code, of, count))
            waiting += len(code)
            if waiting > MOST:
                held.append(merged())
                waiting = 0
                if len(held[0][0]) > MOST and classes < 1 << 16:  # below, it is one code's keys
                    return None
        return merged()

    left = [(0, 1)]
    while left:
        mine, classes = left.pop()
        got = of_class(mine, classes)
        if got is None:
            left += [(2 * mine + 1, 2 * classes), (2 * mine, 2 * classes)]
        else:
            yield *got, names


def bases(df: DataFrame, seq: str) -> int:
    return df.agg(F.sum(F.octet_length(seq))).first()[0] or 0


def _buckets(df: DataFrame, seq: str) -> int:
    return max(BUCKETS_EACH * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, bases(df, seq) // BASES_EACH))


def counted(df: DataFrame, seq: str, key: str, k: int, canonical: bool, buckets: int = 0) -> DataFrame:
    """key, code, cnt: occurrences of every k-mer (k up to 31) of column `seq` by a column `key`, canonical or as they stand."""
    if not 0 < k <= 31:
        raise ValueError("k must lie between 1 and 31")

    def count(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, of, total, names in bucket_counts(group, k, canonical):
            for at in range(0, len(code), ROWS):
                part = slice(at, at + ROWS)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(of[part])), pa.array(code[part]), pa.array(total[part])], names=[key, "code", "cnt"])

    kind = df.schema[key].dataType.simpleString()
    return bucketed(df, seq, key, k, buckets or _buckets(df, seq), canonical).groupBy("bucket").applyInArrow(count, f"`{key}` {kind}, code long, cnt long")


def vectors(df: DataFrame, seq: str, key: str, k: int, canonical: bool, width: int, least: int = 1, buckets: int = 0) -> DataFrame:
    """code, counts (array of `width` doubles, by the int column `key`): k-mers that occur under `least` keys or more."""
    if not 0 < k <= 31:
        raise ValueError("k must lie between 1 and 31")

    def count(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, of, total, names in bucket_counts(group, k, canonical, True):
            column = names.fill_null(-1).to_numpy().astype(np.int64)[of]
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(code)))
            first, n = first[n >= least], n[n >= least]
            for at in range(0, len(first), ROWS):
                begin, size = first[at : at + ROWS], n[at : at + ROWS]
                cells = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                dense = np.zeros((len(begin), width))
                dense[np.repeat(np.arange(len(begin)), size), column[cells]] = total[cells]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(dense) + 1, dtype=np.int32) * width), pa.array(dense.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(code[begin]), lists], names=["code", "counts"])

    known = df.where(F.col(key).between(0, width - 1))
    return bucketed(known, seq, key, k, buckets or _buckets(known, seq), canonical).groupBy("bucket").applyInArrow(count, "code long, counts array<double>")


def _alike(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One row of each distinct combination, and how many rows have it."""
    order = np.lexsort(columns[::-1])
    new = np.any([x[order][1:] != x[order][:-1] for x in columns], axis=0)
    first = np.flatnonzero(np.append(True, new))
    return order[first], np.diff(np.append(first, len(order)))


def held_sets(df: DataFrame, seq: str, key: str, k: int, canonical: bool, lists: int, full: bool, buckets: int = 0) -> DataFrame:
    """What sets of contigs hold k-mers: of a string column `key`, <number of a list>:<contig>, or the number alone.

    Rows of two kinds. sets (for each list, a mark of the set of its contigs; null: none), n (k-mers with these sets; a bucket's own sum); and
    list, sig, name: the members of a set that is marked sig, once for each bucket. A mark is the set's size and two hashes of its
    members that are added up. full: k-mers that some list lacks, too.
    """
    if not 0 < k <= 31:
        raise ValueError("k must lie between 1 and 31")

    def marks(size: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.Array:
        raw = np.ascontiguousarray(np.stack([size.astype(np.uint64), x, y], axis=1))
        fixed = pa.Array.from_buffers(pa.binary(24), len(raw), [None, pa.py_buffer(raw)]).cast(pa.binary())
        return pc.if_else(pa.array(size > 0), fixed, pa.scalar(None, pa.binary()))

    def rows(**known: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(known.values())))
        kinds = {"sets": pa.list_(pa.binary()), "n": pa.int64(), "list": pa.int32(), "sig": pa.binary(), "name": pa.string()}
        return pa.RecordBatch.from_arrays([known.get(c, pa.nulls(n, t)) for c, t in kinds.items()], names=list(kinds))

    def find(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = None
        for code, of, _, names in bucket_counts(group, k, canonical, True):
            if which is None:
                parts = [(s or "").partition(":") for s in names.to_pylist()]
                which = np.array([int(p[0] or -1) for p in parts])
                contigs = pa.array([p[2] if p[1] else None for p in parts], pa.string())
                text = np.array(["".join(p) for p in parts], object)
                hashes = [pd.util.hash_array(text, hash_key=x, categorize=False) for x in ("0123456789abcdef", "fedcba9876543210")]
            if not len(code):
                continue
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            sets = []
            for i in range(lists):
                mine = which[of] == i
                sets.append([np.add.reduceat(mine.astype(np.int64), first), *(np.add.reduceat(np.where(mine, h[of], np.uint64(0)), first) for h in hashes)])
            keep = np.ones(len(first), bool) if full else np.all([s[0] > 0 for s in sets], axis=0)
            if not keep.any():
                continue
            size = np.diff(np.append(first, len(code)))[keep]
            first, sets = first[keep], [[x[keep] for x in s] for s in sets]
            one, n = _alike([x for s in sets for x in s])
            for at in range(0, len(one), ROWS):
                part = one[at : at + ROWS]
                each = pa.concat_arrays([marks(*(x[part] for x in s)) for s in sets]).take(pa.array(np.arange(len(part) * lists).reshape(lists, -1).T.reshape(-1)))
                yield rows(sets=pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * lists), each), n=pa.array(n[at : at + ROWS]))
            for i, s in enumerate(sets):
                one, _ = _alike(s)
                one = one[s[0][one] > 0]
                ends = np.cumsum(size[one])
                at = 0
                while at < len(one):  # so many sets that they have about ROWS members
                    end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROWS, "right")))
                    part = one[at:end]
                    row = np.repeat(np.arange(len(part)), size[part])
                    place = first[part][row] + np.arange(len(row)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
                    mine = which[of[place]] == i
                    row, place = row[mine], place[mine]
                    yield rows(list=pa.array(np.full(len(row), i, np.int32)), sig=marks(*(x[part] for x in s)).take(pa.array(row)), name=contigs.take(pa.array(of[place])))
                    at = end

    schema = "sets array<binary>, n long, list int, sig binary, name string"
    return bucketed(df, seq, key, k, buckets or _buckets(df, seq), canonical).groupBy("bucket").applyInArrow(find, schema)
