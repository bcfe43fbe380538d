"""Sequences over ACGT: Column expressions, and windows as two-bit codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def revcomp(s: Column) -> Column:
    """Reverse complement; anything but ACGT becomes N."""
    return F.translate(F.reverse(F.regexp_replace(s, "[^ACGT]", "N")), "ACGT", "TGCA")


def flip(s: Column) -> Column:
    """Reverse complement of a sequence known to hold only ACGT, such as a window."""
    return F.translate(F.reverse(s), "ACGT", "TGCA")


def canonical(s: Column) -> Column:
    """The smaller of a sequence over ACGT and its reverse complement; letter order is code order, since A < C < G < T."""
    return F.least(s, flip(s))


def oriented(s: Column, stranded: bool) -> Column:
    return s if stranded else canonical(s)


def encode(s: Column, k: int) -> Column:
    """Two bits per base, the first base highest; k up to 31 fits a signed long."""
    if not 0 < k <= 31:
        raise ValueError("k must lie between 1 and 31")
    return F.conv(F.translate(s, "ACGT", "0123"), 4, 10).cast("long")


def decode(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def flip_code(code: Column, k: int) -> Column:
    """The code of the reverse complement: bases swapped in ever larger groups."""
    x = F.bitwise_not(code)
    for shift, keep in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        x = F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(keep)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(keep)), shift))
    return F.shiftrightunsigned(x, 64 - 2 * k)


def _codes(bases: np.ndarray, k: int) -> np.ndarray:
    """Codes of all windows of k bases (0 to 3), by doubling: windows of 2 n bases from two of n."""
    done, width = np.zeros(len(bases) - k + 1, np.int64), 0
    part, size = bases.astype(np.int64), 1
    while True:
        if k & size:
            done = (done << (2 * size)) | part[width : width + len(done)]
            width += size
        if 2 * size > k:
            return done
        part, size = (part[:-size] << (2 * size)) | part[size:], 2 * size


_BASE = np.full(256, 4, np.uint8)
_BASE[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3, 0, 1, 2, 3]
CHUNK_BASES = 1 << 18


def chunks(texts: pa.Array, bases: int) -> Iterator[tuple[int, int]]:
    """First row and end of pieces of a column of texts, of about that many bytes and one text at least."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + bases, "right")))
        yield at, end
        at = end


def window_codes(df: DataFrame, seq: str, k: int, canonical: bool, name: str = "code") -> DataFrame:
    """One row for each window of k bases (k up to 31) of column `seq`, which gives way to the window's code; repeats kept.

    Windows with letters other than ACGT go; canonical: the smaller code of a window and its reverse complement. The
    windows of many sequences are coded at once in Arrow tasks, in pieces of about CHUNK_BASES.
    """
    if not 0 < k <= 31:
        raise ValueError("k must lie between 1 and 31")
    keep = [c for c in df.columns if c != seq]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in chunks(batch.column(len(keep)), CHUNK_BASES):
                texts = [t.encode() if t else b"" for t in batch.column(len(keep)).slice(at, end - at).to_pylist()]
                b = _BASE[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
                bad = np.concatenate([[0], np.cumsum(b > 3)])
                starts = np.flatnonzero(bad[k:] == bad[:-k]) if len(b) >= k else np.zeros(0, np.int64)
                codes = np.zeros(0, np.int64)
                if len(starts):
                    codes = _codes(b & 3, k)[starts]
                    if canonical:
                        # complements in reversed order: a window's reverse complement begins where it ends
                        codes = np.minimum(codes, _codes((3 - (b & 3))[::-1], k)[::-1][starts])
                offsets = np.cumsum([len(t) + 1 for t in texts])
                rows = pa.array(at + np.searchsorted(offsets, starts, "right"))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(len(keep))), pa.array(codes)], names=[*keep, name])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema] + [f"`{name}` long"]
    return df.select(*keep, seq).mapInArrow(cut, ", ".join(kinds))


def windows(df: DataFrame, seq: str, k: int, name: str = "kmer") -> DataFrame:
    """window_codes written out as sequences, in the orientation in which they stand."""
    return window_codes(df, seq, k, False, "_code").withColumn(name, decode(F.col("_code"), k)).drop("_code")
