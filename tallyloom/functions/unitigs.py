"""Joining k-mers that share k - 1 bases, without a row for each: within buckets of the shared bases' minimisers.

A k-mer goes to the bucket of either end, mostly the same one, with its counts where joints are tested. A bucket finds the joints between its ends
and walks them; what it gives back is stretches of joined k-mers, two bits a base and a bit for each k-mer's direction, and the
k-mers without a joint. Stretches that meet in a k-mer whose ends lie in two buckets are put together by ranking (paths.py): only they are moved
any further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import paths
from .seq import _codes
from .superkmers import code_minimisers, flipped

SLOTS = 1 << 14  # of minimisers, which are counted
BUCKET_KMERS = 1 << 15  # on average
HOT = 1 << 18  # a slot of more is dealt out by its shared ends
TESTED = 1 << 14  # joints that are tested at a time

STRETCHES = "head long, tail long, length long, low long, best long, rep_value double, best_fwd boolean, best_at long, ends int, alone boolean, bases binary, ways binary"
NAMES = [c.split()[0] for c in STRETCHES.split(", ")]

ORDERS = {"min": lambda v: v, "max": lambda v: -v, "minabs": np.abs, "maxabs": lambda v: -np.abs(v)}


def _pearson(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """vec.pearson of each row, operation by operation, so that the same joints pass; nan for null."""
    n = float(x.shape[1])
    sx, sy, xx, yy, xy = np.zeros((5, len(x)))
    for a, b in zip(x.T, y.T, strict=True):
        sx, sy, xx, yy, xy = sx + a, sy + b, xx + a * a, yy + b * b, xy + a * b
    if not n:
        return np.full(len(x), np.nan)
    vx, vy = xx - sx * sx / n, yy - sy * sy / n
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (xy - sx * sy / n) / np.sqrt(np.maximum(vx, 1e-300) * np.maximum(vy, 1e-300))
    return np.where((vx > 1e-12 * xx) & (vy > 1e-12 * yy), r, 0.0)


def _ranks(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape)
    for i in range(x.shape[1]):
        out[:, i] = ((x < x[:, i : i + 1]).sum(axis=1) + (x <= x[:, i : i + 1]).sum(axis=1) - 1) / 2.0
    return out


def _mac(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    with np.errstate(divide="ignore", invalid="ignore"):
        for a, b in zip(x.T, y.T, strict=True):
            total = total + np.where(a == b, 0.0, np.where(a + b != 0, np.abs(a - b) / (a + b), np.nan))
        return total / float(x.shape[1])


DISTANCES = {"pearson": lambda x, y: 0.5 * (1.0 - _pearson(x, y)), "spearman": lambda x, y: 0.5 * (1.0 - _pearson(_ranks(x), _ranks(y))), "mac": _mac}


def _ends(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return codes >> 2, codes & ((1 << 2 * (k - 1)) - 1)


def _slots(ends: np.ndarray, k: int) -> np.ndarray:
    return (code_minimisers(ends, k - 1).view(np.uint64) % np.uint64(SLOTS)).astype(np.int64)


def _knots(ends: np.ndarray, k: int, stranded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends as they are grouped, whether they are read backward there, and whether they are their own reverse complements."""
    if stranded:
        return ends, np.zeros(len(ends), bool), np.zeros(len(ends), bool)
    other = flipped(ends, k - 1)
    return np.minimum(ends, other), other < ends, other == ends


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


def _plan(seeds: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First bucket of each slot, and how many it is dealt out to."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            pre, suf = (_slots(e, k) for e in _ends(batch.column(0).to_numpy(), k))
            n += np.bincount(pre, minlength=SLOTS) + np.bincount(suf[suf != pre], minlength=SLOTS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["slot", "n"])

    size = np.zeros(SLOTS, np.int64)
    for r in seeds.select("code").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # SLOTS rows at most
        size[r["slot"]] = r["n"]
    hot = size > HOT
    buckets = max(1, -(-int(size[~hot].sum()) // BUCKET_KMERS))
    pieces = np.where(hot, -(-size // BUCKET_KMERS), 1)
    first = np.where(hot, buckets + np.cumsum(np.where(hot, pieces, 0)) - pieces, np.arange(SLOTS) % buckets)
    return first, pieces


def _dealt(seeds: DataFrame, k: int, stranded: bool) -> DataFrame:
    """bucket, ends (1: of the first k - 1 bases, 2: of the last, 3: both) and the columns of seeds (code first)."""
    first, pieces = _plan(seeds, k)

    def bucket(ends: np.ndarray) -> np.ndarray:
        slot = _slots(ends, k)
        at = first[slot]
        spread = pieces[slot] > 1
        if spread.any():
            knot, _, _ = _knots(ends[spread], k, stranded)
            at[spread] += (_mixed(knot) % pieces[slot[spread]].view(np.uint64)).astype(np.int64)
        return at

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pre, suf = (bucket(e) for e in _ends(batch.column(0).to_numpy(), k))
            apart = np.flatnonzero(pre != suf)
            row = pa.array(np.concatenate([np.arange(len(pre)), apart]))
            ends = np.concatenate([np.where(pre == suf, 3, 1), np.full(len(apart), 2)]).astype(np.int32)
            at = np.concatenate([pre, suf[apart]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ends), *(c.take(row) for c in batch.columns)], names=["bucket", "ends", *batch.schema.names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seeds.schema)
    return seeds.mapInArrow(deal, f"bucket int, ends int, {kinds}")


def _found(codes: np.ndarray, ends: np.ndarray, k: int, stranded: bool) -> tuple[np.ndarray, ...]:
    """Rows of the k-mers before and behind each knot of two, and whether each is read forward there."""
    pre, suf = np.flatnonzero(ends & 1), np.flatnonzero(ends & 2)
    row, is_pre = np.concatenate([pre, suf]), np.arange(len(pre) + len(suf)) < len(pre)
    knot, back, own = _knots(np.concatenate([_ends(codes[pre], k)[0], _ends(codes[suf], k)[1]]), k, stranded)
    pred = is_pre == back
    order = np.lexsort((~pred, knot))
    order = order[~own[order]]
    row, knot, back, pred = row[order], knot[order], back[order], pred[order]
    new = np.append(True, knot[1:] != knot[:-1]) if len(knot) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    at = start[np.diff(np.append(start, len(knot))) == 2]
    at = at[pred[at] & ~pred[at + 1]]
    at = at[codes[row[at]] != codes[row[at + 1]]]
    return row[at], ~back[at], row[at + 1], ~back[at + 1]


def _expanded(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _binaries(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _lows(node: np.ndarray, some: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The least of some of each chain's nodes."""
    return np.minimum.reduceat(np.where(some, node, np.iinfo(np.int64).max), start) if len(start) else start


def _stretches(group: pa.Table, k: int, stranded: bool, rep_mode: str, method: str | None, threshold: float) -> pa.Table:
    codes, ends = (group[c].combine_chunks().to_numpy() for c in ("code", "ends"))
    values = group["rep_value"].combine_chunks()
    p, pf, s, sf = _found(codes, ends, k, stranded)
    if method not in (None, "none"):
        counts = group["counts"].combine_chunks()
        counts = counts.flatten().to_numpy(zero_copy_only=False).reshape(len(counts), -1)
        near = np.zeros(len(p), bool)
        for i in range(0, len(p), TESTED):
            part = slice(i, i + TESTED)
            near[part] = DISTANCES[method](counts[p[part]], counts[s[part]]) < threshold
        p, pf, s, sf = p[near], pf[near], s[near], sf[near]
    a, b = 2 * codes[p] + pf, 2 * codes[s] + sf
    if not stranded:
        a, b = np.concatenate([a, b ^ 1]), np.concatenate([b, a ^ 1])
    node, head, at, tail, length, _ = paths.chains(a, b)
    order = np.lexsort((at, head))
    node, at = node[order], at[order]
    start = np.flatnonzero(at == 0)
    tail, length = tail[order][start], length[order][start]
    node = np.insert(node, start + length, tail)  # each chain's last node behind the others
    start = start + np.arange(len(start))
    # a cycle through several buckets is cut at its least code (see opened). Where the leftmost of equal k-mers represents a contig, the best k-mers on
    # both sides of the cut must be known: in a stretch that others may continue on both sides there is one joint at most where the cut can
    # be, which is made a stretch of its own
    by_code = np.argsort(codes, kind="stable")
    row = by_code[np.searchsorted(codes, node >> 1, sorter=by_code)]
    begins, stops = ends[row[start]] == 3, ends[row[start + length]] == 3  # the first or last k-mer has no end elsewhere
    of = np.repeat(np.arange(len(start)), length + 1)
    place = np.arange(len(node)) - start[of]
    low = _lows(node, place < length[of], start)
    low_at = place[node == low[of]]  # a chain has a node once
    last = (tail & 1 == 1) & (tail < low)
    cut = np.where(last, length, np.where(low & 1 == 1, low_at, low_at + 1))  # the joint before this place
    split = ~begins & ~stops & (cut > 0) & stranded
    whole = np.flatnonzero(~split)
    which = np.flatnonzero(split)
    chain = np.concatenate([whole, which, which, which])
    begin = np.concatenate([np.zeros(len(whole), np.int64), np.zeros(len(which), np.int64), cut[which] - 1, cut[which]])
    end = np.concatenate([length[whole], cut[which] - 1, cut[which], length[which]])
    some = end > begin
    chain, begin, length = chain[some], begin[some], (end - begin)[some]
    alone = (begins & stops)[chain]
    start = start[chain] + begin
    size = length + 1
    take = _expanded(start, size)
    node, row, of = node[take], row[take], np.repeat(np.arange(len(size)), size)
    start = np.cumsum(size) - size
    at = np.arange(len(node)) - start[of]
    code, fwd = node >> 1, node & 1 == 1
    # bases: those of the first k-mer, and the last one of each other; every stretch begins with a byte
    read = np.where(fwd, code, flipped(code, k))
    held = -(-(size + k - 1) // 4)
    offset = 4 * (np.cumsum(held) - held)
    bases = np.zeros(4 * held.sum(), np.uint8)
    bases[offset[:, None] + np.arange(k)] = (read[start][:, None] >> 2 * np.arange(k - 1, -1, -1)) & 3
    later = at > 0
    bases[offset[of[later]] + k - 1 + at[later]] = read[later] & 3
    four = bases.reshape(-1, 4)
    packed = (four[:, 0] << 6) | (four[:, 1] << 4) | (four[:, 2] << 2) | four[:, 3]
    marked = -(-size // 8)
    ways = np.zeros(8 * marked.sum(), np.uint8)
    ways[8 * (np.cumsum(marked) - marked)[of] + at] = fwd
    v = ORDERS[rep_mode](values.fill_null(0.0).to_numpy(zero_copy_only=False))[row]
    known = values.is_valid().to_numpy(zero_copy_only=False)[row]
    best = np.lexsort(((code,) if not stranded else (code, at)) + (v, known, of))[start]
    lone = np.flatnonzero(~np.isin(codes, code))
    nulls = lambda kind: pa.nulls(len(lone), kind)
    both = lambda x, kind: pa.concat_arrays([pa.array(x, kind), nulls(kind)])
    long = pa.int64()
    return pa.table({
        "head": both(node[start], long), "tail": both(node[start + length], long), "length": both(length, long), "low": both(_lows(node, at < length[of], start), long),
        "best": pa.array(np.concatenate([code[best], codes[lone]])), "rep_value": values.take(pa.array(np.concatenate([row[best], lone]))), "best_fwd": both(fwd[best], pa.bool_()), "best_at": both(at[best], long),
        "ends": pa.concat_arrays([pa.nulls(len(start), pa.int32()), pa.array(ends[lone])]),
        "alone": both(alone, pa.bool_()),
        "bases": pa.concat_arrays([_binaries(packed, held), nulls(pa.binary())]), "ways": pa.concat_arrays([_binaries(np.packbits(ways), marked), nulls(pa.binary())]),
    })


def stretches(seeds: DataFrame, k: int, stranded: bool, rep_mode: str, method: str | None, threshold: float) -> DataFrame:
    """Of seeds (code, rep_value and, for a test, counts): stretches of joined k-mers, in both reading directions if unstranded, and k-mers apart.

    A stretch: head and tail (nodes, as in paths.py), length (joints), low (the least node but the tail), best, rep_value, best_fwd, best_at (the best
    k-mer and its place), alone (no other continues it), bases and ways (packed). A k-mer without a joint in its bucket has head null and best, rep_value, ends: it has none at all if its
    rows' ends make 3.
    """
    dealt = _dealt(seeds, k, stranded)
    return dealt.groupBy("bucket").applyInArrow(lambda group: _stretches(group, k, stranded, rep_mode, method, threshold), STRETCHES)


def opened(loose: DataFrame, k: int) -> DataFrame:
    """Stretches of cycles (with cycle: the least node of the cycle, or of its other reading) with every cycle cut before its least code, as paths.opened does.

    The parts of a stretch keep its best k-mer, as parts of one path.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                n = r["length"]
                packed = np.frombuffer(r["bases"], np.uint8)
                bases = ((packed[:, None] >> np.array([6, 4, 2, 0])) & 3).reshape(-1)[: n + k].astype(np.uint8)
                fwd = np.unpackbits(np.frombuffer(r["ways"], np.uint8), count=n + 1)
                read = _codes(bases, k)
                node = 2 * np.where(fwd == 1, read, flipped(read, k)) + fwd
                # no joint leads into the least code as it reads forward, none leaves its other reading
                at = [q + 1 - r["cycle"] % 2 for q in np.flatnonzero(node == r["cycle"]).tolist()]
                at = [q for q in at if 0 < q <= n]
                for i, j in zip([0, *at], [*(q - 1 for q in at), n], strict=True):
                    if i < j:
                        part = np.append(bases[i : j + k], np.zeros(-(j + k - i) % 4, np.uint8)).reshape(-1, 4)
                        whole = ((part[:, 0] << 6) | (part[:, 1] << 4) | (part[:, 2] << 2) | part[:, 3]).tobytes()
                        out.append(r | {"head": int(node[i]), "tail": int(node[j]), "length": j - i, "low": int(node[i:j].min()), "bases": whole, "ways": np.packbits(fwd[i : j + 1]).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema).drop_columns(["cycle"])

    return loose.select(*NAMES, "cycle").mapInArrow(cut, STRETCHES)


def spelled(pieces: DataFrame, k: int) -> DataFrame:
    """whole, rep_value, begin, text, marks of pieces (whole, rep_value, begin, fwd, length, code, bases, ways): their bases as they are read, and for each k-mer 1 if it reads forward.

    A piece is a k-mer (code) or a stretch (bases and ways).
    """
    letters = np.frombuffer(b"ACGT", np.uint8)
    four = letters[np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3]
    swap, turn = bytes.maketrans(b"ACGT", b"TGCA"), bytes.maketrans(b"01", b"10")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, value, begin, forward, length, code, bases, ways = (batch.column(i) for i in range(8))
            single = code.is_valid().to_numpy(zero_copy_only=False)
            kmers = letters[code.fill_null(0).to_numpy(zero_copy_only=False)[:, None] >> 2 * np.arange(k - 1, -1, -1) & 3].tobytes()
            texts, marks = [], []
            for i, (n, fwd, one, packed, way) in enumerate(zip(length.to_pylist(), forward.to_pylist(), single.tolist(), bases.to_pylist(), ways.to_pylist(), strict=True)):
                if one:
                    text, mark = kmers[k * i : k * i + k], b"1"
                else:
                    text = four[np.frombuffer(packed, np.uint8)].tobytes()[:n]
                    mark = (np.unpackbits(np.frombuffer(way, np.uint8), count=n - k + 1) + 48).tobytes()
                texts.append(text if fwd else text.translate(swap)[::-1])
                marks.append(mark if fwd else mark.translate(turn)[::-1])
            yield pa.RecordBatch.from_arrays([whole, value, begin, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(marks, pa.binary()).cast(pa.string())], names=["whole", "rep_value", "begin", "text", "marks"])

    return pieces.select("whole", "rep_value", "begin", "fwd", "length", "code", "bases", "ways").mapInArrow(spell, "whole long, rep_value double, begin long, text string, marks string")
