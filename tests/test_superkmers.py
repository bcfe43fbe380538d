"""Counting k-mers through stretches that share a minimiser, against plain counting."""

import random
from collections import Counter

import numpy as np
import pytest

from tallyloom.functions import seq, superkmers
from tallyloom.operators import tools
from tests.test_operators import rc


def encode(s):
    return int("".join(str("ACGT".index(c)) for c in s), 4)


def plain(rows, k, canonical):
    out = Counter()
    for key, s in rows:
        for i in range(len(s or "") - k + 1):
            w = s[i : i + k].upper()
            if set(w) <= set("ACGT"):
                out[key, min(encode(w), encode(rc(w))) if canonical else encode(w)] += 1
    return out


def sample_rows(seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("ACGT") for _ in range(300))
    rows = [(rng.choice([0, 1, 2, None]), "".join(rng.choice("ACGTacgtN" if rng.random() < 0.1 else "ACGT") for _ in range(rng.randint(0, 150)))) for _ in range(60)]
    rows += [(i % 3, base[i : i + 100] if i % 2 else rc(base[i : i + 100])) for i in range(0, 200, 7)] + [(1, base)] * 20  # repeated stretches
    return rows + [(0, "A" * 500), (2, "T" * 90), (1, "AC" * 200), (1, None), (1, ""), (2, "ACGT" * 100)]


@pytest.mark.parametrize("k", [1, 4, 5, 9, 13, 21, 31])
def test_counts(spark, monkeypatch, k):
    monkeypatch.setattr(superkmers, "CHUNK_BASES", 120)  # sequences longer than a chunk, many chunks
    rows = sample_rows(k)
    df = spark.createDataFrame(rows, "sample_idx int, seq string").repartition(3)
    for canonical in (True, False):
        got = superkmers.counted(df, "seq", "sample_idx", k, canonical, buckets=7).collect()
        assert Counter({(r["sample_idx"], r["code"]): r["cnt"] for r in got}) == plain(rows, k, canonical) and len(got) == len(plain(rows, k, canonical))
    want = plain(rows, k, True)
    codes = {c for s, c in want if s is not None and sum((i, c) in want for i in range(3)) >= 2}
    got = superkmers.vectors(df, "seq", "sample_idx", k, True, 3, 2).collect()
    assert {r["code"]: r["counts"] for r in got} == {c: [float(want[i, c]) for i in range(3)] for c in codes}


def test_names_as_keys_and_no_rows(spark):
    df = spark.createDataFrame([("a", "ACGTACGT"), ("b", "ACGTA"), (None, "ACGTA")], "sample string, seq string")
    got = {(r["sample"], r["code"]): r["cnt"] for r in superkmers.counted(df, "seq", "sample", 5, False).collect()}
    assert got == dict(plain([("a", "ACGTACGT"), ("b", "ACGTA"), (None, "ACGTA")], 5, False))
    assert superkmers.counted(df.limit(0), "seq", "sample", 5, False).count() == 0 == superkmers.vectors(df.limit(0).selectExpr("1 sample", "seq"), "seq", "sample", 5, False, 3).count()
    with pytest.raises(ValueError):
        superkmers.counted(df, "seq", "sample", 32, False)


def test_reverse_complements_of_codes():
    rng = random.Random(2)
    for k in (1, 7, 16, 31):
        words = ["".join(rng.choice("ACGT") for _ in range(k)) for _ in range(50)]
        assert superkmers.flipped(np.array([encode(w) for w in words]), k).tolist() == [encode(rc(w)) for w in words]


def test_minimisers_are_the_same_for_both_strands():
    rng = np.random.default_rng(3)
    bases = rng.integers(0, 4, 2000).astype(np.uint8)
    assert (superkmers.minimisers(bases, 31) == superkmers.minimisers(3 - bases[::-1], 31)[::-1]).all()


def test_a_quarter_of_the_bytes_of_single_codes(spark, tmp_path):
    """What is dealt to buckets at k = 31, against what counting of single codes deals out."""
    rng = random.Random(5)
    df = spark.createDataFrame([(i % 20, "".join(rng.choice("ACGT") for _ in range(2000))) for i in range(100)], "sample_idx int, seq string").repartition(4)
    size = lambda out: sum(f.stat().st_size for f in out.glob("*.parquet"))
    superkmers.bucketed(df, "seq", "sample_idx", 31, 64, True).write.option("compression", "lz4").parquet(str(tmp_path / "a"))
    seq.window_codes(df, "seq", 31, True).groupBy("sample_idx", "code").count().write.option("compression", "lz4").parquet(str(tmp_path / "b"))
    assert size(tmp_path / "a") * 4 < size(tmp_path / "b")


def test_one_repeated_kmer_is_summed_up_before_the_shuffle(spark):
    df = spark.createDataFrame([(0, "A" * 5000)] * 200 + [(0, "GATTACAGATTACCAGATTTACAGGATTACAGATTACA")] * 3000, "sample_idx int, seq string").repartition(2)
    rows = superkmers.bucketed(df, "seq", "sample_idx", 31, 64, True).collect()
    assert sum(len(r["n"]) + len(r["codes"]) for r in rows) < 50
    assert {r["cnt"] for r in tools.count_kmers(df, 31, stranded=False).collect()} == {200 * 4970, 3000}


def test_a_large_bucket_is_counted_in_classes(spark, monkeypatch):
    """One bucket of many k-mers: no more than MOST pairs at a time, all of a code in one class where asked, and the same counts."""
    rng = random.Random(11)
    rows = [(i % 3, "".join(rng.choice("ACGT") for _ in range(400))) for i in range(20)] + [(0, "A" * 200), (None, "ACGT" * 30)]
    df = spark.createDataFrame(rows, "sample_idx int, seq string").repartition(2)
    group = superkmers.bucketed(df, "seq", "sample_idx", 13, 1, True).toArrow().to_batches(max_chunksize=1)
    monkeypatch.setattr(superkmers, "MOST", 500)
    monkeypatch.setattr(superkmers, "SLICE", 64)
    for whole in (False, True):
        got, pieces = Counter(), []
        for code, of, count, names in superkmers.bucket_counts(iter(group), 13, True, whole):
            keys = names.take(of).to_pylist()
            assert len(set(zip(code.tolist(), keys, strict=True))) == len(code) <= 500
            got.update(dict(zip(zip(keys, code.tolist(), strict=True), count.tolist(), strict=True)))
            pieces.append(set(code.tolist()))
        assert got == plain(rows, 13, True) and len(pieces) > 8
        assert not whole or sum(map(len, pieces)) == len(set().union(*pieces))


def test_buckets_grow_with_the_bases(spark, monkeypatch):
    df = spark.createDataFrame([(0, "ACGT" * 1000)] * 10, "sample_idx int, seq string")
    assert superkmers._buckets(df, "seq") == superkmers.BUCKETS_EACH * 4
    monkeypatch.setattr(superkmers, "BASES_EACH", 100)
    assert superkmers._buckets(df, "seq") == 400
