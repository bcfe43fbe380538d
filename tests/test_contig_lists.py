"""Comparing lists of contigs by sets, against plain counting."""

import random
from collections import Counter
from itertools import product

import pytest

from tallyloom.operators import tools
from tests.test_operators import rc


def held(contigs, k):
    out = {}
    for name, s in contigs:
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            out.setdefault(min(w, rc(w)), set()).add(name)
    return out


@pytest.mark.parametrize("hot", [tools.HOT_KMER, 2, 0])
def test_lists_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(tools, "HOT_KMER", hot)
    rng = random.Random(3)
    base = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(6)]
    lists = {}
    for name, n in (("a", 12), ("b", 9), ("c", 7)):
        lists[name] = [(f"{name}{i}", rng.choice(base)[rng.randint(0, 20) : rng.randint(30, 60)] + rng.choice(["", "A" * 12, "ACACACACACAC"])) for i in range(n)]
        lists[name] += [(f"{name}again", lists[name][0][1])]
    k = 9
    frames = {n: spark.createDataFrame(v, "contig string, seq string") for n, v in lists.items()}
    by = {n: held(v, k) for n, v in lists.items()}
    for unique in (False, True):
        want = Counter()
        for w in set().union(*by.values()):
            sets = [by[n].get(w, {"-"} if unique else set()) for n in lists]
            want.update(product(*sets))
        got = tools.compare_contig_lists(frames, k, show_unique=unique).collect()
        assert {(r["a"], r["b"], r["c"]): r["nb_kmer"] for r in got} == dict(want) and len(got) == len(want)
        assert all(r["nb_shared_contig"] == sum(r[n] != "-" for n in lists) for r in got)
    got = tools.shared_kmers(frames["a"], frames["b"], k).collect()
    want = Counter(p for w in by["a"] if w in by["b"] for p in product(by["a"][w], by["b"][w]))
    assert {(r["left_contig"], r["right_contig"]): r["n"] for r in got} == dict(want)
    full = tools.shared_kmers(frames["a"], frames["b"], k, how="full").collect()
    assert sum(r["n"] for r in full if r["right_contig"] is None) == sum(len(s) for w, s in by["a"].items() if w not in by["b"])


def test_a_kmer_of_many_contigs_is_one_row_until_the_end(spark):
    """Forty repeated k-mers that 300 contigs of either list hold: joined and counted as one pair of sets."""
    rng = random.Random(5)
    stock = "".join(rng.choice("ACGT") for _ in range(70))
    side = lambda c: spark.createDataFrame([(f"{c}{i}", stock + "".join(rng.choice("ACGT") for _ in range(31))) for i in range(300)], "contig string, seq string")
    got = tools.shared_kmers(side("l"), side("r"), 31).collect()
    assert len(got) == 300 * 300 and min(r["n"] for r in got) == 40


@pytest.mark.parametrize("few", [tools.FEW_KMERS, 0])
def test_lists_met_with_few_kmers_or_by_sets(spark, monkeypatch, few):
    """Inner comparisons give the same either way; a filtered list never shuffles windows that the smallest list lacks."""
    monkeypatch.setattr(tools, "FEW_KMERS", few)
    rng = random.Random(13)
    base = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(4)]
    left = [(f"l{i}", rng.choice(base)[: rng.randint(20, 60)]) for i in range(5)]
    right = [(f"r{i}", rng.choice(base)[rng.randint(0, 20) :] + "A" * 15) for i in range(40)] + [("none", None), ("r0", "ACGT" * 9)]
    frames = [spark.createDataFrame(x, "contig string, seq string") for x in (left, right)]
    a, b = held(left, 9), held([(n, s or "") for n, s in right], 9)
    want = Counter(p for w in a if w in b for p in product(a[w], b[w]))
    got = tools.shared_kmers(*frames, 9).collect()
    assert {(r["left_contig"], r["right_contig"]): r["n"] for r in got} == dict(want) and len(got) == len(want)
    assert tools.kmer_jaccard(*frames, 9).first()["jaccard"] == len(set(a) & set(b)) / len(set(a) | set(b))
    tables = []
    monkeypatch.setattr(tools, "materialise", lambda df, name, make=tools.materialise: tables.append((name, make(df, name))) or tables[-1][1])
    tools.shared_kmers(*frames, 9)
    written = [t.count() for n, t in tables if n == "contig_codes"]
    assert max(written) <= (sum(len(b[w]) for w in a if w in b) + sum(map(len, a.values())) if few else sum(map(len, a.values())))


def test_large_tops_equal_small_ones(spark, monkeypatch):
    rng = random.Random(8)
    df = spark.createDataFrame([(f"f{i}", rng.random(), float(rng.randint(0, 5))) for i in range(200)], "feature string, a double, b double").repartition(3)
    small = {tuple(r) for r in tools.top_membership(df, ["a", "b"], 40).collect()}
    monkeypatch.setattr(tools, "IN_ONE_TASK", 10)
    assert {tuple(r) for r in tools.top_membership(df, ["a", "b"], 40).collect()} == small
