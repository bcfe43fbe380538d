"""Exact medians of vectors by group, however large a group is.

Vectors of ordinary groups meet whole in an Arrow task of their group. A group of more than LARGE vectors is never gathered: the medians' bits
are found DIGIT at a time, from counts of how many values continue what is known with each digit. Counts are added up in tasks before
they are shuffled, and there are 2^DIGIT of them at most for each group, sample and round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialise

LARGE = 50_000
DIGIT = 16
ROUNDS = 64 // DIGIT


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; 0.0 and -0.0 are one."""
    b = (x + 0.0).view(np.int64)
    return (b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.uint64) ^ np.uint64(1 << 63)


def from_bits(u: np.ndarray) -> np.ndarray:
    b = (u ^ np.uint64(1 << 63)).view(np.int64)
    return (b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _small(rows: DataFrame, key: str, kind: str) -> DataFrame:
    def of(group: pa.Table) -> pa.Table:
        return pa.table([group[key][:1], pa.array([np.median(_matrix(group["counts"]), axis=0)], pa.list_(pa.float64()))], names=[key, "counts"])

    return rows.groupBy(key).applyInArrow(of, f"`{key}` {kind}, counts array<double>")


def _large(rows: DataFrame, sizes: DataFrame, key: str, kind: str, width: int) -> DataFrame:
    """rows: a written table of the large groups' vectors; sizes: key, n."""
    # two order statistics for each sample: what is known of their bits, and their rank among the values that share it
    target = F.explode(F.array(F.struct(F.lit(0).alias("t"), F.expr("(n - 1) div 2").alias("rank")), F.struct(F.lit(1).alias("t"), F.expr("n div 2").alias("rank"))))
    state = sizes.select(key, target.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("i")).select(key, "i", "x.t", "x.rank", F.lit(0).cast("long").alias("bits"))
    for r in range(ROUNDS):
        state = materialise(state, "medians")
        known = state.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "i", "bits"))), lambda s: s["bits"]).alias("bits"))

        def digits(batches: Iterator[pa.RecordBatch], r: int = r) -> Iterator[pa.RecordBatch]:
            shift = 64 - DIGIT * (r + 1)
            for batch in batches:
                groups = batch.column(0).dictionary_encode()
                values, bits = ordered_bits(_matrix(batch.column(1))), _matrix(batch.column(2)).view(np.uint64)
                place, found = groups.indices.to_numpy(zero_copy_only=False), []
                for g in range(len(groups.dictionary)):
                    mine = np.flatnonzero(place == g)
                    v = values[mine]
                    for t in range(2):
                        for i in range(v.shape[1]):
                            on = v[:, i] if not r else v[(v[:, i] >> np.uint64(shift + DIGIT)) == bits[mine[0], t * v.shape[1] + i], i]
                            digit, n = np.unique((on >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1), return_counts=True)
                            found.append((np.full(len(n), g), np.full(len(n), i), np.full(len(n), t), digit.view(np.int64), n))
                g, i, t, digit, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
                yield pa.RecordBatch.from_arrays([groups.dictionary.take(pa.array(g)), pa.array(i.astype(np.int32)), pa.array(t.astype(np.int32)), pa.array(digit), pa.array(n)], names=[key, "i", "t", "digit", "n"])

        counted = rows.join(known, key).select(key, "counts", "bits").mapInArrow(digits, f"`{key}` {kind}, i int, t int, digit long, n long").groupBy(key, "i", "t", "digit").agg(F.sum("n").alias("n"))
        order = Window.partitionBy(key, "i", "t").orderBy("digit")
        upto = counted.withColumn("upto", F.sum("n").over(order))
        step = upto.join(state, [key, "i", "t"]).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        state = step.select(key, "i", "t", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), F.shiftleft("bits", DIGIT).bitwiseOR(F.col("digit")).alias("bits"))

    def mean(group: pa.Table) -> pa.Table:
        order = np.lexsort((group["i"].to_numpy(), group["t"].to_numpy()))
        both = from_bits(group["bits"].to_numpy()[order].view(np.uint64)).reshape(2, -1)
        return pa.table([group[key][:1], pa.array([both.mean(axis=0)], pa.list_(pa.float64()))], names=[key, "counts"])

    return state.groupBy(key).applyInArrow(mean, f"`{key}` {kind}, counts array<double>")


def group_means(rows: DataFrame, key: str) -> DataFrame:
    """key, counts (the means), n of rows (key, counts): each batch of a task adds up its groups' vectors, and sums of vectors are shuffled."""
    kind = rows.schema[key].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            if not len(groups.dictionary):
                continue
            place, values = groups.indices.to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            order = np.argsort(place, kind="stable")
            sums = np.add.reduceat(values[order], np.searchsorted(place[order], np.arange(len(groups.dictionary))), axis=0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums.reshape(-1)))
            yield pa.RecordBatch.from_arrays([groups.dictionary, lists, pa.array(np.bincount(place, minlength=len(sums)))], names=[key, "sums", "n"])

    def mean(group: pa.Table) -> pa.Table:
        n = group["n"].to_numpy().sum()
        return pa.table([group[key][:1], pa.array([_matrix(group["sums"]).sum(axis=0) / n], pa.list_(pa.float64())), pa.array([n])], names=[key, "counts", "n"])

    parts = rows.select(key, "counts").where(F.col(key).isNotNull()).mapInArrow(add, f"`{key}` {kind}, sums array<double>, n long")
    return parts.groupBy(key).applyInArrow(mean, f"`{key}` {kind}, counts array<double>, n long")


def group_medians(rows: DataFrame, key: str, width: int) -> DataFrame:
    """key, counts (the median of each of `width` values over the group's vectors), n (vectors) of rows (key, counts).

    Keys that are null are left out; an empty table gives none.
    """
    kept = materialise(rows.select(key, "counts").where(F.col(key).isNotNull()), "vectors")
    sizes = materialise(kept.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "sizes")
    kind = kept.schema[key].dataType.simpleString()
    large = sizes.where(F.col("n") > LARGE)
    if large.isEmpty():
        return _small(kept, key, kind).join(sizes, key)
    big = materialise(kept.join(large.select(key), key, "left_semi"), "large")
    out = _small(kept.join(large.select(key), key, "left_anti"), key, kind).union(_large(big, large, key, kind, width))
    return out.join(sizes, key)
