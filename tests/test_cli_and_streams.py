"""The command line end to end, and verbs on streams."""

import pytest

from tallyloom import __main__ as cli
from tallyloom import streaming
from tallyloom.operators import filter as filters


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("cli")
    rows = {"AACCG": [1, 2, 30, 40], "ACCGT": [1, 2, 30, 40], "GGGGA": [5, 5, 5, 5]}
    (top / "t.tsv").write_text("tag\ta\tb\tc\td\n" + "".join(f"{k}\t" + "\t".join(map(str, v)) + "\n" for k, v in rows.items()))
    (top / "ud.tsv").write_text("a DOWN\nb DOWN\nc UP\nd UP\n")
    (top / "label.tsv").write_text("a normal\nb normal\nc tumor\nd tumor\n")
    (top / "q.fa").write_text(">q1\nAACCGT\n>q2\nTTTTTTT\n")
    cli.run(spark, ["index", "--table", str(top / "t.tsv"), "--klen", "5", "--out", str(top / "idx")])
    return top


def table(spark, path):
    return {r[0]: tuple(r[1:]) for r in spark.read.option("header", True).option("sep", "\t").csv(str(path)).collect()}


def test_verbs(spark, folder):
    go = lambda verb, name, *more: cli.run(spark, [verb, "--index", str(folder / "idx"), "--out", str(folder / name), *more])
    go("filter", "f", "--design", str(folder / "ud.tsv"), "--up-min", "20:2", "--down-max", "3:2")
    assert set(table(spark, folder / "f")) == {"AACCG", "ACCGT"}
    go("mask", "m", "--suppress", str(folder / "q.fa"))
    assert table(spark, folder / "m") == {"GGGGA": ("5", "5", "5", "5")}
    go("query", "q", "--fasta", str(folder / "q.fa"), "--with-absent", "--counts", "float")
    assert table(spark, folder / "q") == {"q1": ("1.0", "2.0", "30.0", "40.0"), "q2": ("0.0",) * 4}
    go("score", "s", "--by", "snr", "--design", str(folder / "label.tsv"), "--format", "bin")
    go("merge", "c", "--with", f"{folder / 's'}:maxabs", "--overlap", "4-3", "--aggregate", "mean")
    assert {k: v[0] for k, v in table(spark, folder / "c").items()} == {"AACCGT": "2", "GGGGA": "1"}
    go("merge", "b", "--overlap", "4-4", "--intervention", "none", "--format", "bin")
    go("rank", "r", "--by", "sd", "--with", f"{folder / 'b'}:median", "--top", "1")
    assert set(table(spark, folder / "r")) == {"AACCGT"}
    go("filter", "fa", "--design", str(folder / "ud.tsv"), "--format", "fa", "--reverse", "--up-min", "20:2")
    assert [r[0] for r in spark.read.text(str(folder / "fa")).collect()] == [">feature_0", "GGGGA"]


def test_streams(spark, tmp_path):
    rows = [("A", [9.0, 0.0]), ("B", [1.0, 0.0]), ("C", [7.0, 8.0])]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], streaming.verbs.ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    m = streaming.read_rows(spark, str(tmp_path / "in"), ["u", "d"])
    streaming.stream(m, lambda x: filters.filter_features(x, ["UP", "DOWN"], (5, 1), (0, 1)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert {r["feature"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"A"}
    q = streaming.column_sums(m).writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["sample_idx"], r["total"]) for r in spark.table("sums").collect()} == {(0, 17.0), (1, 8.0)}
