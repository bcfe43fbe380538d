"""Flat binary matrices and selections, from bytes laid out by hand."""

import struct

import pytest

from tallyloom import sources


def lay_out(folder, meta, rows):
    (folder / "idx-meta.bin").write_text(meta)
    mat, offsets = b"", []
    for name, counts in rows:
        offsets.append(len(mat))
        mat += struct.pack(f"<{len(counts)}f", *counts) + name.encode() + b"\n"
    (folder / "idx-mat.bin").write_bytes(mat)
    return offsets


def test_kmers(spark, tmp_path):
    # 10.0 and others have bytes that are line ends
    rows = [("TTTGA", [1.0, 10.0]), ("AACCG", [struct.unpack("<f", b"\n\n\n\n")[0], 0.5]), ("CCCCC", [2.0, 3.25])]
    offsets = lay_out(tmp_path, "2\t5\tF\ntag\ta\tb\n2.5\t0.5\n", rows)
    m = sources.read_binary_index(spark, str(tmp_path))
    assert (m.samples, m.k, m.stranded, m.nf, m.feature_name) == (["a", "b"], 5, False, [2.5, 0.5], "tag")
    got = m.df.orderBy("ordinal").collect()
    assert [(r["feature"], r["counts"], r["offset"]) for r in got] == [("TCAAA", [1.0, 10.0], offsets[0]), ("AACCG", [pytest.approx(rows[1][1][0], rel=1e-6), 0.5], offsets[1]), ("CCCCC", [2.0, 3.25], offsets[2])]
    line = lambda name, value, places: f"{name}\t{value}\t{len(places)}\t".encode() + struct.pack(f"<{len(places)}Q", *places) + b"\n"
    (tmp_path / "sel.bin").write_bytes(line("TTTGACC", 0.25, [offsets[2], offsets[0]]) + line("AACCG", -1, [offsets[1]]))
    found = {r["feature"]: (r["value"], r["members"]) for r in sources.read_binary_selection(spark, str(tmp_path / "sel.bin"), m).collect()}
    assert found == {"TTTGACC": (0.25, ["CCCCC", "TCAAA"]), "AACCG": (-1.0, ["AACCG"])}
    (tmp_path / "bad.bin").write_bytes(line("X", 1, [7]))
    with pytest.raises(Exception, match="no row at offset 7"):
        sources.read_binary_selection(spark, str(tmp_path / "bad.bin"), m).collect()


def test_other_features_and_bad_metadata(spark, tmp_path):
    lay_out(tmp_path, "3\t0\nname\ts1\ts2\ts3\n", [("gene one".replace(" ", "_"), [1, 2, 3]), ("g2", [0, 0, 10])])
    m = sources.read_binary_index(spark, str(tmp_path))
    assert (m.samples, m.k, m.nf) == (["s1", "s2", "s3"], 0, []) and {r["feature"]: r["counts"] for r in m.df.collect()} == {"gene_one": [1, 2, 3], "g2": [0, 0, 10]}
    (tmp_path / "idx-meta.bin").write_text("3\t0\nname\ts1\n")
    with pytest.raises(ValueError):
        sources.read_binary_index(spark, str(tmp_path))
