"""Block gzip files, laid out by hand."""

import gzip
import io
import random
import struct
import zlib

import pytest

from tallyloom import sources
from tallyloom.sources import bgzf


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 18 + len(body) + 8
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, size - 1) + body + struct.pack("<II", zlib.crc32(data), len(data))


def lay_out(data: bytes, sizes) -> bytes:
    """Members of the sizes given, empty ones too, and the empty one at the end."""
    out, at = b"", 0
    while at < len(data):
        n = next(sizes)
        out, at = out + member(data[at : at + n]), at + n
    return out + member(b"")


def plain(data: bytes) -> list[bytes]:
    return data.removesuffix(b"\n").split(b"\n") if data else []


@pytest.mark.parametrize("seed", range(12))
def test_parts_hold_each_line_once(seed, monkeypatch):
    """Every cut of a file in two or three parts gives the lines of plain reading, in order and with rising offsets."""
    rng = random.Random(seed)
    made = [bytes(rng.choices(b"ab\x1f\x8b\x08\x04", k=rng.choice([0, 0, 1, 3, 40, 400]))) for _ in range(60)]
    data = b"\n".join(made) + (b"\n" if seed % 2 else b"")
    file = lay_out(data, iter(lambda: rng.choice([0, 1, 2, 7, 50, 300]), None))
    assert gzip.decompress(file) == data
    f = io.BytesIO(file)
    for _ in range(60):
        cuts = [0, *sorted(rng.sample(range(1, len(file)), rng.choice([1, 2]))), len(file)]
        got = [x for lo, hi in zip(cuts, cuts[1:], strict=False) for x in bgzf.lines(f, lo, hi, len(file))]
        assert [t for _, t in got] == plain(data), cuts
        assert all(a < b for (a, _), (b, _) in zip(got, got[1:], strict=False))


def test_lines_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    text = "".join(f"{i}\t{'é' * rng.randint(0, 300)}{rng.random()}\n" for i in range(20_000)) + "x" * 300_000 + "\nlast"
    data = text.encode()
    path = tmp_path / "lines.gz"
    path.write_bytes(lay_out(data, iter(lambda: 60_000, None)))
    got = bgzf.read_lines(spark, str(path), 1 << 16)
    assert got.rdd.getNumPartitions() > 3
    assert [r["value"] for r in got.orderBy("ordinal").collect()] == text.split("\n")
    assert [r["value"] for r in bgzf.read_lines(spark, f"file://{path}").orderBy("ordinal").collect()] == text.split("\n")
    assert bgzf.first_line(str(path)) == (text.split("\n")[0],)
    path.write_bytes(lay_out(b"", iter([])))
    assert bgzf.first_line(str(path)) is None and bgzf.read_lines(spark, str(path)).count() == 0
    path.write_bytes(lay_out(data, iter(lambda: 60_000, None))[:-500])
    with pytest.raises(Exception, match="damaged or cut"):
        bgzf.read_lines(spark, str(path)).collect()


def test_count_tables(spark, tmp_path):
    """A block gzip table equals the plain one, rows in order; gzip of another kind and plain files aren't taken for such."""
    text = "tag\ta\tb\n" + "".join(f"f{i}\t{i}\t{i / 4}\n" for i in range(5000))
    (tmp_path / "plain.tsv").write_text(text)
    (tmp_path / "block.tsv.gz").write_bytes(lay_out(text.encode(), iter(lambda: 1000, None)))
    with gzip.open(tmp_path / "whole.tsv.gz", "wt") as f:
        f.write(text)
    assert [bgzf.is_block_gzip(str(tmp_path / n)) for n in ("plain.tsv", "block.tsv.gz", "whole.tsv.gz", "none.gz", "*.gz", "")] == [False, True, False, False, False, False]
    want, got = (sources.read_counts(spark, str(tmp_path / n)) for n in ("plain.tsv", "block.tsv.gz"))
    assert (got.samples, got.feature_name) == (want.samples, want.feature_name) == (["a", "b"], "tag")
    rows = lambda m: [(r["feature"], r["counts"]) for r in m.df.orderBy("ordinal").collect()]
    assert rows(got) == rows(want) and len(rows(got)) == 5000
