"""Lines of block gzip files (BGZF), read by many tasks.

Such a file is a row of gzip members of at most 64 KB, each of which states its own size, so a task can begin at any member. A
task's part is a range of bytes: its members are those that begin there. As with plain text, a line belongs to the part that holds
the byte before it, a file's first line to the first part; a task reads on until its last line ends.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "value string, ordinal long"
# fixed values of the format: a member's first bytes, and the extra field that holds its size less one
_MAGIC, _FIELD = b"\x1f\x8b\x08\x04", b"BC\x02\x00"
_HEADER = 12  # bytes before the extra fields
_MEMBER = 1 << 16  # most bytes of a member
_PART = 32 << 20  # bytes of a part, unless asked otherwise
_ROWS = 8192


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def member_size(head: bytes) -> int:
    """The size of the member that begins with `head`, which holds its extra fields; 0 where none begins."""
    if len(head) < _HEADER or head[:4] != _MAGIC:
        return 0
    at, end = _HEADER, _HEADER + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 4] == _FIELD and at + 6 <= len(head):
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return 0


def is_block_gzip(path: str) -> bool:
    """Whether path is one file that begins with a member that states its size."""
    try:
        files, name = _open(path)
        if files.get_file_info(name).type != fs.FileType.File:
            return False
        with files.open_input_file(name) as f:
            return member_size(f.read(_MEMBER)) > 0
    except (OSError, ValueError, ImportError):  # a path that Spark's own readers alone can open
        return False


def first_member(f, lo: int, size: int) -> int:
    """Where the first member at or after byte lo begins; size where there is none. Data that look like a member's start aren't
    followed by another member, or by the end of the file, at the distance stated."""
    f.seek(lo)
    window = f.read(3 * _MEMBER)
    at = window.find(_MAGIC)
    while 0 <= at < _MEMBER + 1:
        step = member_size(window[at : at + _MEMBER])
        after = at + step
        if step and (lo + after == size or member_size(window[after : after + _MEMBER])):
            return lo + at
        at = window.find(_MAGIC, at + 1)
    if lo + _MEMBER < size:
        raise ValueError(f"no member of a block gzip file within 64 KB after byte {lo}")
    return size


def members(f, at: int) -> Iterator[tuple[int, int, bytes]]:
    """From the member at byte `at` on: where each begins, where the next one does, and its data."""
    f.seek(at)
    held = b""
    while True:
        if len(held) < _MEMBER:
            held += f.read(16 * _MEMBER)
        if not held:
            return
        step = member_size(held[:_MEMBER])
        if not step or step > len(held):
            raise ValueError(f"the block gzip file is damaged or cut at byte {at}")
        yield at, at + step, zlib.decompress(held[:step], 31)
        held, at = held[step:], at + step


def lines(f, lo: int, hi: int, size: int) -> Iterator[tuple[int, bytes]]:
    """The lines of the part of bytes lo to hi - 1, with their virtual offsets: a member's place times 2^16, and the place in its data."""
    begin = first_member(f, lo, size) if lo else 0
    end = first_member(f, hi, size) if hi < size else size
    if begin >= end:
        return
    start, pieces = (None if begin else 0), []
    for at, after, data in members(f, begin):
        if start is None and at >= end:
            return
        place = 0
        while (stop := data.find(b"\n", place)) >= 0:
            if start is not None:
                pieces.append(data[place:stop])
                yield start, b"".join(pieces)
            pieces, place = [], stop + 1
            start = at << 16 | place if place < len(data) else after << 16
            if start > end << 16:
                return
        if start is not None:
            pieces.append(data[place:])
    if start is not None and any(pieces):
        yield start, b"".join(pieces)


def first_line(path: str) -> tuple[str] | None:
    """The first line of a block gzip file, as a row of one column; None of an empty one."""
    files, name = _open(path)
    with files.open_input_file(name) as f:
        found = next(lines(f, 0, 1, files.get_file_info(name).size), None)
    return None if found is None else (_text(found[1]),)


def _text(line: bytes) -> str:
    return line.removesuffix(b"\r").decode("utf-8", "replace")


class _Part(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.part = options["path"], int(options.get("partbytes", _PART))

    def partitions(self):
        files, name = _open(self.path)
        size = files.get_file_info(name).size
        part = max(self.part, _MEMBER)
        return [_Part(lo, min(lo + part, size)) for lo in range(0, size, part)] or [_Part(0, 0)]

    def read(self, partition):
        files, name = _open(self.path)
        size = files.get_file_info(name).size
        with files.open_input_file(name) as f:
            offsets, texts = [], []
            for offset, text in lines(f, partition.lo, partition.hi, size):
                offsets.append(offset)
                texts.append(_text(text))
                if len(texts) == _ROWS:
                    yield _batch(texts, offsets)
                    offsets, texts = [], []
            if texts:
                yield _batch(texts, offsets)


def _batch(texts: list[str], offsets: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(offsets, pa.int64())], names=["value", "ordinal"])


class BlockGzipLines(DataSource):
    """Spark data source block_gzip_lines; options path and partBytes (at least 64 KB)."""

    @classmethod
    def name(cls):
        return "block_gzip_lines"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_lines(spark: SparkSession, path: str, part_bytes: int = _PART) -> DataFrame:
    """value, ordinal of a block gzip file's lines; ordinals are virtual offsets, distinct and rising.

    Line ends are \\n or \\r\\n; the last line needs none; bytes that aren't UTF-8 are replaced; an empty file has no lines; a
    damaged one raises. The path is one that every executor can open.
    """
    spark.dataSource.register(BlockGzipLines)
    return spark.read.format(BlockGzipLines.name()).option("path", path).option("partBytes", part_bytes).load()
