"""A bit array of bounded size that tells which values can be in a set; what it lets through is checked exactly later."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, slices

MAX_BITS = 27
BITS_EACH = 64


def bit_filters(df: DataFrame, group: str, column: str, most_bits: int = MAX_BITS) -> dict[int, Broadcast]:
    """For each value of an int column `group` (few), the bits of a long column's values: two bits set by each (places from its
    low and its high half) in BITS_EACH bits a value, at least 2^16, and 2^most_bits over all groups at most (groups of 2^16 apart)."""
    values = df.select(F.col(group).alias("g"), F.col(column).alias("v")).distinct()
    sizes = values.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()  # few groups
    if not sizes:
        return {}
    bits = {r["g"]: max(16, min(most_bits - (len(sizes) - 1).bit_length(), (BITS_EACH * r["n"] - 1).bit_length())) for r in sizes}
    mask = F.try_element_at(F.create_map(*(F.lit(x) for g, b in bits.items() for x in (g, (1 << b) - 1))), F.col("g"))
    place = values.select("g", F.explode(F.array(F.col("v"), F.shiftright("v", 32))).alias("v")).select("g", F.col("v").bitwiseAND(mask.cast("long")).alias("at"))
    part = place.select("g", F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit")).groupBy("g", "word").agg(F.bit_or("bit").alias("bits")).toArrow()
    groups, at, word = part["g"].to_numpy(), part["word"].to_numpy(), part["bits"].to_numpy().view(U)  # at most 2^(bits - 6) for each group
    out = {}
    for g, b in bits.items():
        array = np.zeros(1 << (b - 6), U)
        array[at[groups == g]] = word[groups == g]
        out[g] = df.sparkSession.sparkContext.broadcast(array)
    return out


def bit_filter(df: DataFrame, column: str, most_bits: int = MAX_BITS) -> Broadcast:
    """The bits of a long column's values (by their low bits)."""
    return bit_filters(df.withColumn("_g", F.lit(0)), "_g", column, most_bits).get(0) or df.sparkSession.sparkContext.broadcast(np.zeros(1 << 10, U))


def can_hold(values: np.ndarray, array: np.ndarray) -> np.ndarray:
    mask = U(len(array) * 64 - 1)
    values = values.astype(np.int64)

    def has(v: np.ndarray) -> np.ndarray:
        place = v.view(U) & mask
        return ((array[(place >> U(6)).astype(np.int64)] >> (place & U(63))) & U(1)).astype(bool)

    found = has(values)
    at = np.flatnonzero(found)
    found[at] = has(values[at] >> 32)
    return found


def kept(batch: pa.RecordBatch, at: int, bits: Broadcast) -> pa.RecordBatch:
    """The rows of a batch whose value in column `at` the bit array lets through; nulls go."""
    v = batch.column(at)
    return batch.filter(pa.array(can_hold(v.fill_null(0).to_numpy(), bits.value) & v.is_valid().to_numpy(zero_copy_only=False)))


def passing(df: DataFrame, column: str, bits: Broadcast) -> DataFrame:
    """The rows of df whose long column the bit array lets through; nulls go."""
    at = df.columns.index(column)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield kept(batch, at, bits)

    return df.mapInArrow(cut, df.schema)
