"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..N-1 in the order of (id, CRC-32, size), a keyed Feistel network permutes the smallest even-bit
power-of-two domain that holds N, and values outside 0..N-1 are permuted again until they fall inside (cycle
walking), which makes it a permutation of 0..N-1. The permuted number p of a row gives shard p mod S and slot
p div S, so shard sizes differ by one row at most, slots have no gaps, and `locate` computes the place of any row
number (and `row_at` the reverse) without the data. The same rows and seed always give the same places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table, with_row_number
from .words import U, mix

ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _keys(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, ROUNDS + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed % (1 << 64)))


def _network(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    mask = U((1 << half) - 1)
    left, right = x >> U(half), x & mask
    for key in keys:
        left, right = right, left ^ (mix(right ^ key) & mask)
    return (left << U(half)) | right


def _network_back(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    mask = U((1 << half) - 1)
    left, right = x >> U(half), x & mask
    for key in keys[::-1]:
        left, right = right ^ (mix(left ^ key) & mask), left
    return (left << U(half)) | right


def _walk(numbers: np.ndarray, n: int, seed: int, network) -> np.ndarray:
    half, keys = _half_bits(n), _keys(seed)
    out = network(numbers.astype(U), half, keys)
    while len(outside := np.flatnonzero(out >= U(n))):
        out[outside] = network(out[outside], half, keys)
    return out.astype(np.int64)


def permute(numbers: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The place of each of the row numbers 0..n-1 in the shuffle."""
    return _walk(numbers, n, seed, _network)


def locate(number: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permute(np.array([number]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number that stands at a slot of a shard."""
    return int(_walk(np.array([slot * shards + shard]), n, seed, _network_back)[0])


def shard_rows(df: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Give each row of df a shard and a slot.

    Returns the id column, size, text_crc32, row_number, shard, slot. Nulls: a null text counts as empty (size 8,
    CRC-32 0); a null id sorts first and is kept. Rows that agree in id and text take neighbouring row numbers in any
    order, which can't be told apart in the result. An empty table gives an empty result. Other columns of df aren't
    read, whatever their names.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    numbered = with_row_number(rows, [id_col, "text_crc32", "size"])
    n = numbered.count()

    @F.pandas_udf(T.LongType())
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for numbers in batches:
            yield pd.Series(permute(numbers.to_numpy(), n, seed))

    return (
        numbered.withColumn("place", place("row_number"))
        .withColumn("shard", (F.col("place") % shards).cast("int"))
        .withColumn("slot", F.expr(f"place div {shards}"))
        .drop("place")
    )


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law of equal row counts."""
    placed = shard_rows(table(spark, sf_dir, "documents"), shards=24, seed=20240229)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
