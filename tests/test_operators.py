"""Operators on small matrices, edge cases, files, and merging against a brute-force merger."""

import gzip
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom import sources
from tallyloom.matrix import FeatureMatrix, from_long
from tallyloom.operators import filter as filters
from tallyloom.operators import index, mask, merge, score, tools
from tallyloom.sources import designs


def matrix(spark, rows, **more):
    n = len(next(iter(rows.values())))
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows.items()], "feature string, counts array<double>")
    return FeatureMatrix(df, [f"s{i}" for i in range(n)], **more)


def got(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_files_round_trip(spark, tmp_path):
    text = "tag\ts0 s1\nA\t1\t2.5\n\nB 0  4\n"
    with gzip.open(tmp_path / "counts.tsv.gz", "wt") as f:
        f.write(text)
    m = sources.read_counts(spark, str(tmp_path / "counts.tsv.gz"))
    assert (m.samples, m.feature_name) == (["s0", "s1"], "tag")
    assert {r["feature"]: r["counts"] for r in m.df.collect()} == {"A": [1.0, 2.5], "B": [0.0, 4.0]}
    sources.write_index(m, str(tmp_path / "index"))
    again = sources.read_index(spark, str(tmp_path / "index"))
    assert again.samples == m.samples and again.df.count() == 2
    sources.write_counts(m, str(tmp_path / "out"))
    out = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "out"))
    assert got(out, "tag", "s0", "s1") == {("A", "1", "3"), ("B", "0", "4")}
    (tmp_path / "bad.tsv").write_text("tag s0 s1\nA 1\n")
    with pytest.raises(Exception, match="number of columns"):
        sources.read_counts(spark, str(tmp_path / "bad.tsv")).df.collect()
    (tmp_path / "none.tsv").write_text("tag\nA\n")
    with pytest.raises(ValueError):
        sources.read_counts(spark, str(tmp_path / "none.tsv"))


def test_sequence_files(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one first len>5\nacgt\nAC\n>two\r\nG\r\nG\r\n>two\nA")
    assert sorted(map(tuple, sources.read_fasta(spark, str(tmp_path / "x.fa")).collect())) == [("one first len>5", "ACGTAC"), ("two", "A"), ("two", "GG")]
    (tmp_path / "x.fq").write_text("@r1\nACGT\n+\nIII#\n@r2\nGGA\n+\n@@I\n")
    reads = sources.read_fastq(spark, str(tmp_path / "x.fq"))
    assert got(tools.reverse_reads(reads), "name", "seq", "qual") == {("r1", "ACGT", "#III"), ("r2", "TCC", "I@@")}
    many = [(f"r{i}", "ACGT"[i % 4] * (1 + i % 90), "I" * (1 + i % 90)) for i in range(20_000)]
    (tmp_path / "many.fq").write_text("".join(f"@{n}\n{x}\n+\n{q}\n" for n, x, q in many))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        split = sources.read_fastq(spark, str(tmp_path / "many.fq"))
        assert sorted(map(tuple, split.collect())) == sorted(many)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    sources.write_fasta(spark.createDataFrame([("GG", 2.0), ("AC", 1.5)], "feature string, score double"), str(tmp_path / "fa"), score="score")
    assert got(sources.read_fasta(spark, str(tmp_path / "fa")), "name", "seq") == {("feature_0,score=1.5", "AC"), ("feature_1,score=2.0", "GG")}


def test_input_order(spark, tmp_path):
    """Rows keep their place in the input through filters, and FASTA is numbered by it."""
    names = [f"f{(i * 7919) % 5000}" for i in range(5000)]
    (tmp_path / "t.tsv").write_text("tag\ta\n" + "".join(f"{n}\t{i}\n" for i, n in enumerate(names)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        m = sources.read_counts(spark, str(tmp_path / "t.tsv"))
        kept = filters.filter_features(m, ["UP"], (100, 1)).df
        sources.write_fasta(kept, str(tmp_path / "fa"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [r["feature"] for r in m.df.orderBy("ordinal").collect()] == names
    files = sorted((tmp_path / "fa").glob("part-*.txt"))
    lines = "".join(f.read_text() for f in files).split("\n")
    assert lines[:-1] == [x for i, n in enumerate(names[100:]) for x in (f">feature_{i}", n)]


def test_designs(spark, tmp_path):
    samples = ["a", "b", "c"]
    assert designs.up_down(samples, [("a", "UP"), ("a", "DOWN"), ("x", "UP")]) == ["UP", "DOWN", "DOWN"]
    assert designs.up_down(samples, [("a", "UP")], neutral_unlisted=True) == ["UP", None, None]
    with pytest.raises(ValueError):
        designs.up_down(samples, [("a", "SIDEWAYS")])
    assert designs.labels(samples, [("c", "t"), ("a", "n"), ("b", "n"), ("b", "t")]) == [0, 1, 1]
    with pytest.raises(ValueError):
        designs.labels(samples, [("a", "n")])
    with pytest.raises(ValueError, match="more than once"):
        designs.labels(["a", "a"], [("a", "n")])
    (tmp_path / "d").write_text("a 1.5\nb\t2 ignored\nc 3\n")
    assert sources.continuous_design(spark, str(tmp_path / "d"), samples) == [1.5, 2.0, 3.0]
    (tmp_path / "bad").write_text("a\n")
    with pytest.raises(ValueError):
        sources.label_design(spark, str(tmp_path / "bad"), samples)
    (tmp_path / "nf").write_text("0.5\t2 3\n")
    assert sources.normalisation_factors(spark, str(tmp_path / "nf"), samples) == [0.5, 2.0, 3.0]
    with pytest.raises(ValueError):
        sources.normalisation_factors(spark, str(tmp_path / "nf"), samples[:2])


def test_normalisation(spark):
    m = matrix(spark, {"A": [1, 3], "B": [1, 1]})
    nf = index.compute_nf(m, 8)
    assert nf == [4.0, 2.0]
    assert {r["feature"]: r["counts"] for r in index.normalise(m, nf).df.collect()} == {"A": [4.0, 6.0], "B": [4.0, 2.0]}
    with pytest.raises(ValueError):
        index.compute_nf(matrix(spark, {"A": [1, 0]}), 8)
    with pytest.raises(ValueError):
        index.normalise(m, [1.0])


def test_sequence_checks(spark):
    assert index.index_sequences(matrix(spark, {"TTT": [1]}), 3, stranded=False).df.first()["feature"] == "AAA"
    with pytest.raises(ValueError, match="2 times"):
        index.index_sequences(matrix(spark, {"TTT": [1], "AAA": [1]}), 3, stranded=False)
    with pytest.raises(Exception, match="not a 3-mer"):
        index.index_sequences(matrix(spark, {"TTTT": [1]}), 3).df.collect()


def test_filters(spark):
    m = matrix(spark, {"A": [9, 9, 0, 0], "B": [9, 0, 0, 0], "C": [9, 9, 5, 5]})
    status = ["UP", "UP", "DOWN", "DOWN"]
    keep = lambda **k: {r["feature"] for r in filters.filter_features(m, status, **k).df.collect()}
    assert keep() == {"A", "B", "C"}
    assert keep(up_min=(5, 2)) == {"A", "C"}
    assert keep(up_min=(5, 2), down_max=(0, 2)) == {"A"}
    assert keep(up_min=(5, 2), down_max=(0, 2), reverse=True) == {"B", "C"}


def test_mask_and_query(spark):
    m = matrix(spark, {"AAC": [1, 2], "ACG": [3, 4], "CCC": [5, 6]}, k=3, stranded=False)
    seqs = spark.createDataFrame([("x", "AACGTT"), ("short", "AA"), ("gap", "AACNCCC")], "name string, seq string")
    one = seqs.where("name = 'x'")
    assert {r["feature"] for r in mask.mask(m, select=one).df.collect()} == {"AAC", "ACG"}
    assert {r["feature"] for r in mask.mask(m, suppress=one).df.collect()} == {"CCC"}
    assert {r["feature"] for r in mask.mask(m, seqs, one).df.collect()} == {"CCC"}
    with pytest.raises(ValueError):
        mask.mask(m, select=seqs.where("name = 'short'"))
    twice = spark.createDataFrame([("x", "AACG"), ("x", "CCC"), ("x", "TT")], "name string, seq string")
    assert sorted(r["counts"] for r in mask.query(m, twice).collect()) == [[2.0, 3.0], [5.0, 6.0]]
    assert sorted(r["counts"] for r in mask.query(m, twice, "mean", True).collect()) == [[0.0, 0.0], [2.0, 3.0], [5.0, 6.0]]
    # AAC, ACG, CGT = ACG, GTT = AAC
    assert {r["name"]: (r["n_hits"], r["counts"]) for r in mask.query(m, seqs).collect()} == {"x": (4, [2.0, 3.0]), "gap": (2, [3.0, 4.0])}
    assert {r["name"]: r["counts"] for r in mask.query(m, seqs, "median", True).collect()} == {"x": [2.0, 3.0], "gap": [3.0, 4.0], "short": [0.0, 0.0]}


def test_scores_by_hand(spark):
    m = matrix(spark, {"A": [1, 3, 5, 9], "zero": [0, 0, 0, 0]})
    y = [0, 0, 1, 1]
    s = lambda by, **k: {r["feature"]: r["score"] for r in score.score(m, by, **k).collect()}
    assert s("snr", labels=y)["A"] == pytest.approx(-5 / (math.sqrt(2) + math.sqrt(8))) and s("snr", labels=y)["zero"] == 0
    assert s("dids", labels=y)["A"] == pytest.approx(math.sqrt(2) + math.sqrt(6))
    assert s("rsd2")["A"] == s("sd")["A"] and s("rsd1")["A"] == pytest.approx(s("sd")["A"] / 4.5) and s("rsd3")["A"] == pytest.approx(s("sd")["A"] / 4)
    assert s("entropy")["zero"] is None and s("entropy_exact")["zero"] == pytest.approx(2.0)
    assert s("ttest.padj", labels=y)["zero"] == 1.0 and s("ttest.pi", labels=y)["zero"] == 0.0
    assert s("pearson", target=[1.0, 2.0, 3.0, 4.0])["zero"] == 0.0
    for by, k in (("snr", {"labels": [0, 1, 2, 2]}), ("dids", {"labels": [0] * 4}), ("pearson", {}), ("nothing", {})):
        with pytest.raises(ValueError):
            score.score(m, by, **k)
    assert [r["feature"] for r in score.ordered(score.score(m, "entropy"), "entropy").collect()] == ["A", "zero"]


def test_adjustment_by_brute_force(spark):
    rng = random.Random(5)
    p = [rng.choice([rng.random(), 0.01, 0.5]) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double").repartition(5)
    order = sorted(range(200), key=lambda i: p[i])
    for standard in (False, True):
        want, least = {}, math.inf
        for r in range(200, 0, -1):
            f = 200 / r if standard else (200 / (r + 1) if r < 200 else 1)
            least = min(least, p[order[r - 1]] * f)
            want[order[r - 1]] = min(least, 1.0) if standard else least
        by_p = {p[i]: min(want[j] for j in range(200) if p[j] == p[i]) for i in range(200)}
        for r in score.adjust(df, "p", standard).collect():
            assert r["p_adjusted"] == pytest.approx(by_p[r["p"]])


def test_large_selections_equal_small_ones(spark, monkeypatch):
    m = matrix(spark, {f"f{i}": [float(i % 17), float(i % 5)] for i in range(300)})
    scored = score.score(m, "sd")
    want = [r["feature"] for r in score.select_top(scored, "sd", 120).collect()]
    monkeypatch.setattr(score, "IN_ONE_TASK", 10)
    assert [r["feature"] for r in score.select_top(scored, "sd", 120).collect()] == want


def test_selection_sizes():
    assert [score.number_selected(100, t) for t in (None, -1, 0.1, 0.126, 1, 7)] == [100, 100, 10, 13, 1, 7]
    with pytest.raises(ValueError):
        score.number_selected(5, 6)


# --- merging ---

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(RC)[::-1]


def brute_merge(kmers, overlaps, stranded):
    """Join any unique joint, one at a time, until none is left at an overlap; contigs up to orientation."""
    contigs = [(s, [s]) for s in sorted(kmers)]
    for o in overlaps:
        while True:
            knots = defaultdict(lambda: ([], []))
            for n, (s, _) in enumerate(contigs):
                if len(s) <= o:
                    continue
                for end, is_pre in ((s[:o], True), (s[-o:], False)):
                    if not stranded and end == rc(end):
                        continue
                    flip = not stranded and rc(end) < end
                    knots[rc(end) if flip else end][0 if is_pre == flip else 1].append((n, not flip))
            joint = next(((p[0], q[0]) for _, (p, q) in sorted(knots.items()) if len(p) == len(q) == 1 and p[0][0] != q[0][0]), None)
            if joint is None:
                break
            (a, fa), (b, fb) = joint
            x, y = (contigs[n][0] if f else rc(contigs[n][0]) for n, f in joint)
            assert x[-o:] == y[:o]
            mx, my = (contigs[n][1] if f else contigs[n][1][::-1] for n, f in joint)
            contigs = [c for n, c in enumerate(contigs) if n not in (a, b)] + [(x + y[o:], mx + my)]
    return contigs


def regular(kmers, overlaps, stranded):
    """No k-mer has both ends at one knot, so the order of work doesn't matter."""
    for k in kmers:
        for o in overlaps:
            ends = (k[:o], k[-o:])
            if ends[0] == ends[1] or (not stranded and (ends[0] == rc(ends[1]) or any(e == rc(e) for e in ends))):
                return False
    return True


@pytest.mark.parametrize("stranded,seed", [(True, 0), (False, 1), (False, 2)])
def test_merging_by_brute_force(spark, stranded, seed):
    rng = random.Random(seed)
    k, overlaps = 9, [8, 7]
    kmers: set[str] = set()
    while len(kmers) < 150:
        s = "".join(rng.choice("ACGT") for _ in range(rng.randint(12, 40)))
        fresh = {s[i : i + k] for i in range(len(s) - k + 1) if rng.random() < 0.9}
        fresh = fresh if stranded else {min(x, rc(x)) for x in fresh}
        kmers |= {x for x in fresh if regular([x], overlaps, stranded)}
    m = matrix(spark, {s: [1.0] for s in kmers}, k=k, stranded=stranded)
    out = merge.merge(m, longest=8, shortest=7, intervention=(None, 0)).collect()
    same = lambda s: s if stranded else min(s, rc(s))
    assert sorted(same(r["contig"]) for r in out) == sorted(same(s) for s, _ in brute_merge(kmers, overlaps, stranded))
    assert sorted(x for r in out for x in r["members"]) == sorted(kmers)
    for r in out:
        assert r["nb_merged"] == len(r["members"]) and r["rep"] == (r["members"][0] if stranded else min(r["members"]))
        assert r["rep"] in r["contig"] and all(x in r["contig"] or rc(x) in r["contig"] for x in r["members"])


def test_merging_cycles_and_tests(spark):
    ring = "ACGGTCATTGCA"
    kmers = {(ring * 2)[i : i + 7] for i in range(len(ring))}
    out = merge.merge(matrix(spark, {s: [1.0] for s in kmers}, k=7), longest=6, shortest=6, intervention=("none", 0)).collect()
    assert len(out) == 1 and out[0]["nb_merged"] == len(ring) and out[0]["members"][0] == min(kmers)
    m = matrix(spark, {"AACC": [1, 2, 3], "ACCG": [1, 2, 3], "CCGT": [3, 2, 1]}, k=4)
    cut = merge.merge(m, longest=3, shortest=3, intervention=("pearson", 0.2))
    assert got(cut, "contig", "nb_merged") == {("AACCG", 2), ("CCGT", 1)}
    assert got(merge.merge(m, longest=3, shortest=3, intervention=("mac", 0.5), min_members=3), "contig") == {("AACCGT",)}
    values = spark.createDataFrame([("AACC", 1.0), ("ACCG", -5.0), ("CCGT", 3.0)], "feature string, value double")
    for mode, rep in (("min", "ACCG"), ("max", "CCGT"), ("minabs", "AACC"), ("maxabs", "ACCG")):
        assert got(merge.merge(m, values, 3, 3, (None, 0), mode), "rep") == {(rep,)}
    whole = merge.merge(m, longest=3, shortest=3, intervention=(None, 0))
    assert merge.member_counts(whole, m, "mean").first()["counts"] == pytest.approx([5 / 3, 2, 7 / 3])
    assert merge.member_counts(whole, m, "median").first()["counts"] == [1, 2, 3]
    assert merge.member_counts(whole, m, "rep").first()["counts"] == [1, 2, 3]
    for bad in ({"longest": 4}, {"shortest": 3, "longest": 2}, {"rep_mode": "best"}):
        with pytest.raises(ValueError):
            merge.merge(m, **bad)


def test_tools(spark):
    reads = spark.createDataFrame([(0, "ACGACG"), (1, "CGT")], "sample_idx int, seq string")
    assert got(tools.count_kmers(reads, 3, least=1), "sample_idx", "feature", "cnt") == {(0, "ACG", 2), (0, "CGA", 1), (0, "GAC", 1), (1, "CGT", 1)}
    long = tools.count_kmers(reads, 3, stranded=False, least=1)
    assert got(tools.join_counts(long, 2, 1), "sample_idx", "feature", "cnt") == {(0, "ACG", 2), (1, "ACG", 1)}
    m = from_long(tools.join_counts(long, 2, 1), ["a", "b", "c"])
    assert m.df.first()["counts"] == [2.0, 1.0, 0.0]
    assert got(tools.count_zeros(m), "cells", "zeros") == {(3, 1)}
    sheet = spark.createDataFrame([(f"s{i}", "xy"[i % 2]) for i in range(20)], "sample string, condition string")
    sizes = tools.split_folds(sheet, 5).groupBy("condition", "fold").count().collect()
    assert {r["count"] for r in sizes} == {2}
    with pytest.raises(ValueError):
        tools.select_features(m, spark.createDataFrame([("GGG",)], "feature string"))
    scores = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.4)], "label int, score double")
    assert tools.roc_auc(scores).first()[0] == pytest.approx(0.875)
    columns = ["qlen", "qstart", "qend", "length", "nident", "pident", "slen", "sstart", "send", "qcovs"]
    hits = spark.createDataFrame([(10, 1, 10, 10, 10, 100.0, 10, 1, 10, 100), (10, 1, 10, 10, 10, 100.0, 30, 5, 14, 100), (10, 1, 10, 10, 9, 90.0, 10, 1, 10, 100), (10, 3, 7, 5, 4, 80.0, 9, 1, 5, 50)], columns)
    contigs = spark.createDataFrame([(i,) for i in range(8)], "contig int")
    assert tools.alignment_quality(hits, contigs).first().asDict() == {"perfect": 25.0, "identical": 12.5, "complete": 37.5}
    assert got(tools.bad_samples(spark.createDataFrame([("a_1",), ("1a",), ("a-b",), ("Z",), (None,)], "sample string")), "sample") == {("1a",), ("a-b",), (None,)}
    mates = spark.createDataFrame([(1, "AAC"), (2, "AAC")], "mate int, seq string")
    assert [got(tools.library_strand(mates, t), "mate", "seq") for t in tools.LIBRARY_TYPES] == [{(1, "AAC"), (2, "AAC")}, {(1, "AAC"), (2, "GTT")}, {(1, "GTT"), (2, "AAC")}]
    with pytest.raises(ValueError):
        tools.library_strand(mates, "ff")
    t = tools.pairwise_t_tests(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 5.0), ("b", 7.0), ("c", 1.0)], "g string, v double"), "g", "v").collect()
    assert [(r["group_1"], r["group_2"], r["p"] is None) for r in sorted(t)] == [("a", "b", False), ("a", "c", True), ("b", "c", True)]


@pytest.mark.parametrize("kind", ["lasso", "ridge", "randomforest"])
def test_models(spark, kind):
    rng = random.Random(7)
    y = [i % 2 for i in range(24)]
    m = matrix(spark, {"good": [5 * v + rng.random() for v in y], "noise": [rng.random() for _ in y], "more": [rng.random() for _ in y]})
    rows = tools.samples_as_rows(m, y)
    model = tools.fit_model(rows, kind, strength=0.05, runs=4)
    assert tools.balanced_accuracy(model.transform(rows)).first()[0] == 1.0
