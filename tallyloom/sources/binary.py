"""Reading matrices and selections that a command-line tool has stored as flat binary files.

A folder holds idx-meta.bin (text: the number of samples, k and for k-mers T or F for stranded; the header; factors if there are any) and idx-mat.bin (of
each row 32-bit floats, then the feature's name and a line end). Rows of k-mers all have one length, so Spark reads them in splits at any size.
Other features' rows don't: such a matrix is read as one value, of 2 GB at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq
from ..matrix import FeatureMatrix

_ROW = "feature string, counts array<double>, offset long"


def _batch(features: list[str], counts: np.ndarray, offsets: list[int]) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * counts.shape[1]), pa.array(counts.reshape(-1).astype(float)))
    return pa.RecordBatch.from_arrays([pa.array(features, pa.string()), lists, pa.array(offsets, pa.int64())], names=["feature", "counts", "offset"])


def _fixed(spark: SparkSession, path: str, n: int, k: int) -> DataFrame:
    size = 4 * n + k + 1
    records = spark.createDataFrame(spark.sparkContext.binaryRecords(path, size).zipWithIndex().map(lambda r: (bytes(r[0]), r[1])), "record binary, number long")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, size)
                counts = np.ascontiguousarray(raw[:, : 4 * n]).view("<f4")
                yield _batch([bytes(r).decode() for r in raw[:, 4 * n : -1]], counts, (batch.column(1).to_numpy() * size).tolist())

    return records.mapInArrow(parse, _ROW)


def _whole(spark: SparkSession, path: str, n: int) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                names, places, at = [], [], 0
                while at < len(data):
                    end = data.index(b"\n", at + 4 * n)
                    names.append(data[at + 4 * n : end].decode())
                    places.append(at)
                    at = end + 1
                counts = np.stack([np.frombuffer(data, "<f4", n, p) for p in places]) if places else np.zeros((0, n), "<f4")
                for i in range(0, len(places), 10_000):
                    yield _batch(names[i : i + 10_000], counts[i : i + 10_000], places[i : i + 10_000])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, _ROW)


def read_binary_index(spark: SparkSession, folder: str) -> FeatureMatrix:
    """The matrix of such a folder, with columns offset (of the row in its file) and ordinal (rising in the order of rows).

    K-mers of unstranded matrices are turned to their canonical form.
    """
    meta = " ".join(r[0] for r in spark.read.text(f"{folder}/idx-meta.bin").collect()).split()  # one small file
    n, k = int(meta[0]), int(meta[1])
    stranded, rest = (meta[2] == "T", meta[3:]) if k else (True, meta[2:])
    if n < 1 or len(rest) not in (n + 1, 2 * n + 1):
        raise ValueError("the metadata has another number of columns than it says")
    path = f"{folder}/idx-mat.bin"
    df = (_fixed(spark, path, n, k) if k else _whole(spark, path, n)).withColumn("ordinal", F.col("offset"))
    if k:
        df = df.withColumn("feature", seq.oriented(F.upper("feature"), stranded))
    return FeatureMatrix(df, rest[1 : n + 1], k, stranded, [float(x) for x in rest[n + 1 :]], rest[0])


def read_binary_selection(spark: SparkSession, path: str, m: FeatureMatrix) -> DataFrame:
    """feature, value, members of a stored selection: lines of a name, a value, a number and as many 64-bit offsets of rows of the matrix m.

    members are the features at those offsets, in order. The file is read as one value, of 2 GB at most; offsets that m lacks raise.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                names, values, places, at = [], [], [], 0
                while at < len(data):
                    name, value, count = (data[at:].split(b"\t", 3) if len(data) - at < 4096 else data[at : at + 4096].split(b"\t", 3))[:3]
                    start = at + len(name) + len(value) + len(count) + 3
                    end = start + 8 * int(count)
                    names.append(name.decode())
                    values.append(float(value))
                    places.append(np.frombuffer(data[start:end], "<u8").astype(np.int64))
                    at = end + 1
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.float64()), pa.array(places, pa.list_(pa.int64()))], names=["feature", "value", "places"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "feature string, value double, places array<long>")
    each = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "feature", "value", F.posexplode("places").alias("i", "offset"))
    named = each.join(m.df.select("offset", F.col("feature").alias("member")), "offset", "left")
    member = F.coalesce("member", F.raise_error(F.concat(F.lit("no row at offset "), F.col("offset").cast("string"))))
    grouped = named.groupBy("row").agg(F.first("feature").alias("feature"), F.first("value").alias("value"), F.sort_array(F.collect_list(F.struct("i", member.alias("member")))).alias("m"))
    return grouped.select("feature", "value", F.transform("m", lambda s: s["member"]).alias("members"))
