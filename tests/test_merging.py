"""Paths in buckets, long paths, and merging under the rule "orient" against a sequential worker in plain Python."""

import random

import numpy as np
import pytest

from tallyloom.functions import paths, seq, superkmers
from tallyloom.operators import merge
from tests.test_operators import matrix, rc, regular


def code(s):
    return int("".join(str("ACGT".index(c)) for c in s), 4)


class Worker:
    """One worker that takes contigs in the order of their representatives' codes, and knots in the order of theirs."""

    def __init__(self, values, stranded, better=lambda a, b: a <= b):
        self.contigs = {k: [k, v, [k]] for k, v in values.items()}  # by representative: sequence, its value, members
        self.stranded, self.better = stranded, better

    def entries(self, o):
        knots = {}
        for name in sorted(self.contigs):
            s = self.contigs[name][0]
            ends = []
            for e in (s[:o], s[-o:]):
                back = not self.stranded and rc(e) < e
                ends.append((rc(e) if back else e, back))
            (p, prc), (q, src) = ends
            if p != q:
                for knot, role, back in ((p, "pred" if prc else "succ", prc), (q, "succ" if src else "pred", src)):
                    self.enter(knots.setdefault(knot, {}), role, name, back)
                continue
            held = knots.setdefault(p, {})
            if "pred" not in held and not src:
                self.enter(held, "pred", name, False)
            elif "pred" not in held and prc:
                self.enter(held, "pred", name, True)
            elif "succ" not in held and not prc:
                self.enter(held, "succ", name, False)
            elif "succ" not in held and src:
                self.enter(held, "succ", name, True)
            else:
                held["full"] = True
        return knots

    @staticmethod
    def enter(held, role, name, back):
        if role in held:
            held["full"] = True
        else:
            held[role] = (name, back)

    def run(self, overlaps, near=lambda a, b: True):
        for o in overlaps:
            while self.one_pass(o, near):
                pass
        return sorted((s, len(m), name) for name, (s, _, m) in self.contigs.items())

    def one_pass(self, o, near):
        some = False
        for _, held in sorted(self.entries(o).items()):
            if "full" in held or "pred" not in held or "succ" not in held:
                continue
            (p, prc), (s, src) = held["pred"], held["succ"]
            if p == s or p not in self.contigs or s not in self.contigs:
                continue
            pm, sm = self.contigs[p][2], self.contigs[s][2]
            if not near(pm[0] if prc else pm[-1], sm[-1] if src else sm[0]):
                continue
            some = True
            read = lambda name, back: (rc(self.contigs[name][0]), self.contigs[name][2][::-1]) if back else (self.contigs[name][0], self.contigs[name][2])
            (x, mx), (y, my) = read(p, prc), read(s, src)
            assert x[-o:] == y[:o]
            whole, members = x + y[o:], mx + my
            base, lost, back = (p, s, prc) if self.better(self.contigs[p][1], self.contigs[s][1]) else (s, p, src)
            if back:
                whole, members = rc(whole), members[::-1]
            self.contigs[base] = [whole, self.contigs[base][1], members]
            del self.contigs[lost]
        return some


def some_kmers(rng, k, n, stranded, even):
    """K-mers of random, repeated and self-complementary sequences."""
    out = set()
    while len(out) < n:
        s = "".join(rng.choice("ACGT") for _ in range(rng.randint(k, 3 * k)))
        if even and rng.random() < 0.5:
            half = "".join(rng.choice("ACGT") for _ in range(rng.randint(2, k)))
            s = rng.choice([s + rc(s), half + rc(half) + s, half * 4, s[: k // 2] + half + rc(half) + half, "AT" * k, s + s[: k - 1]])
        fresh = [s[i : i + k] for i in range(len(s) - k + 1) if rng.random() < 0.95]
        out |= {x if stranded else min(x, rc(x)) for x in fresh}
    return out


@pytest.mark.parametrize("seed,stranded", [(0, False), (1, False), (2, True)])
def test_orient_equals_a_sequential_worker(spark, seed, stranded):
    rng = random.Random(seed)
    k = (7, 9, 6)[seed]
    kmers = some_kmers(rng, k, 120, stranded, True)
    values = {s: float(rng.randint(0, 6)) for s in kmers} if seed else dict.fromkeys(kmers, 0.0)
    m = matrix(spark, {s: [1.0] for s in kmers}, k=k, stranded=stranded)
    given = spark.createDataFrame(list(values.items()), "feature string, value double")
    out = merge.merge(m, given, longest=k - 1, shortest=k - 3, intervention=(None, 0), palindromes="orient").collect()
    overlaps = range(k - 1, k - 4, -1)
    assert sorted((r["contig"], r["nb_merged"], r["rep"]) for r in out) == Worker(values, stranded).run(overlaps)
    assert sum(len(r["members"]) for r in out) == len(kmers) and any(o % 2 == 0 for o in overlaps)
    assert not all(regular([s], overlaps, stranded) for s in kmers)


def test_orient_with_a_test_and_other_modes(spark):
    rng = random.Random(11)
    k = 7
    kmers = some_kmers(rng, k, 100, False, True)
    counts = {s: [float(rng.randint(0, 9)) for _ in range(3)] for s in kmers}
    values = {s: float(rng.randint(-4, 4)) for s in kmers}
    near = lambda a, b: np.mean([0 if x == y else abs(x - y) / (x + y) for x, y in zip(counts[a], counts[b], strict=True)]) < 0.5
    m = matrix(spark, counts, k=k, stranded=False)
    given = spark.createDataFrame(list(values.items()), "feature string, value double")
    for mode, better in (("maxabs", lambda a, b: abs(a) >= abs(b)),):
        out = merge.merge(m, given, 6, 5, ("mac", 0.5), mode, palindromes="orient").collect()
        assert sorted((r["contig"], r["nb_merged"], r["rep"]) for r in out) == Worker(values, False, better).run([6, 5], near)


def test_hairpins_rings_and_even_overlaps(spark):
    """By hand: an end that is its own reverse complement joins under "orient" and not under "skip"."""
    m = matrix(spark, {s: [1.0] for s in ("CCACGT", "ACGTGA")}, k=6, stranded=False)
    both = {p: sorted(r["contig"] for r in merge.merge(m, longest=4, shortest=4, intervention=(None, 0), palindromes=p).collect()) for p in merge.PALINDROMES}
    assert both == {"skip": ["ACGTGA", "CCACGT"], "orient": ["CCACGTGA"]}
    with pytest.raises(ValueError):
        merge.merge(m, palindromes="other")


def plain_ranks(arcs):
    out = {}
    step = dict(arcs)
    for a in {x for arc in arcs for x in arc}:
        n, at = 0, a
        while at in step:
            at, n = step[at], n + 1
        out[a] = (at, n)
    return out


@pytest.mark.parametrize("one_task", [1 << 20, 5])
def test_path_ranks(spark, monkeypatch, one_task):
    """Paths, cycles inside one bucket and across buckets, and hot keys; more chains than one task ranks."""
    monkeypatch.setattr(paths, "ONE_TASK", one_task)
    monkeypatch.setattr(paths, "BUCKET_ARCS", 40)
    rng = random.Random(4)
    nodes = list(range(500))
    rng.shuffle(nodes)
    arcs, at = [], 0
    for length, ring in ((60, False), (1, False), (35, True), (2, True), (100, False), (80, True), (3, True), (63, True)):
        part = nodes[at : at + length + 1]
        at += length + 1
        key = rng.randint(0, 3)
        row = [(2 * a + 1, 2 * b + 1) for a, b in zip(part, part[1:] + part[:1] if ring else part[1:], strict=False)]
        mirror = [(b - 1, a - 1) for a, b in row]
        keys = {}
        for n, (a, b) in enumerate(row):
            key = key if length == 35 else key if n % 7 else rng.randint(0, 9)
            keys[a, b] = keys[b - 1, a - 1] = 77 if length == 100 else key
        arcs += [(a, b, keys[a, b]) for a, b in row + mirror]
    from tallyloom.storage import materialise

    got = paths.path_ranks(materialise(spark.createDataFrame(arcs, "a long, b long, key long"), "test")).collect()
    a, b = paths.opened(np.array([x[0] for x in arcs]), np.array([x[1] for x in arcs]))
    assert len(arcs) - len(a) == 10  # each ring and its mirror image is cut once
    assert {r["node"]: (r["path"], r["rank"]) for r in got} == plain_ranks(list(zip(a.tolist(), b.tolist(), strict=True))) and len(got) == len({x for arc in arcs for x in arc[:2]})


def test_bucketed_merging_is_the_same(spark, monkeypatch):
    rng = random.Random(9)
    kmers = {s for s in some_kmers(rng, 9, 300, False, False) if regular([s], [8, 7], False)}
    m = matrix(spark, {s: [1.0] for s in kmers}, k=9, stranded=False)
    whole = sorted(map(tuple, merge.merge(m, longest=8, shortest=7, intervention=(None, 0)).select("contig", "nb_merged", "rep").collect()))
    monkeypatch.setattr(paths, "ONE_TASK", 20)
    monkeypatch.setattr(paths, "BUCKET_ARCS", 50)
    assert whole == sorted(map(tuple, merge.merge(m, longest=8, shortest=7, intervention=(None, 0)).select("contig", "nb_merged", "rep").collect()))


def test_a_path_of_a_million_kmers_takes_few_jobs(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(paths, "ONE_TASK", 1 << 19)
    k, n = 31, 1_000_000
    bases = np.random.default_rng(5).integers(0, 4, n + k - 1).astype(np.uint8)
    codes = seq._codes(bases, k)
    forward = codes <= superkmers.flipped(codes, k)
    kmers = np.where(forward, codes, superkmers.flipped(codes, k))
    assert len(np.unique(kmers)) == n
    c = spark.createDataFrame(pd.DataFrame({"code": kmers})).repartition(4)
    from pyspark.sql import functions as F

    from tallyloom.storage import materialise

    contigs = materialise(c.select("code", F.col("code").alias("head"), F.col("code").alias("rear"), F.shiftright("code", 2).alias("pre"), F.col("code").bitwiseAND(F.lit((1 << 60) - 1)).alias("suf")), "million")
    spark.sparkContext.setJobGroup("million", "one level")
    edges = materialise(merge.joints(contigs, 30, k, False), "edges")
    ranked = merge._ranked(edges, 30, False)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("million"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 25
    got = ranked.toPandas()
    assert len(got) == 2 * n and got["path"].nunique() == 2
    place = got[got["path"] == 2 * kmers[-1] + forward[-1]].set_index("code").loc[kmers]
    assert (place["rank"].to_numpy() == np.arange(n)[::-1]).all() and (place["fwd"].to_numpy() == forward).all()


def test_passes_move_neither_sequences_nor_members(spark, monkeypatch):
    """What a pass writes has numbers only: contigs are written out once, at the end."""
    rng = random.Random(17)
    s = "".join(rng.choice("ACGT") for _ in range(60))
    kmers = sorted({min(w, rc(w)) for w in (s[i : i + 9] for i in range(52))})
    m = matrix(spark, {x: [1.0, 2.0] for x in kmers}, k=9, stranded=False)
    written = []
    monkeypatch.setattr(merge, "materialise", lambda df, name, make=merge.materialise: written.append(df.dtypes) or make(df, name))
    out = merge.merge(m, longest=8, shortest=7, intervention=(None, 0)).collect()
    assert sum(r["nb_merged"] for r in out) == len(kmers) and max(r["nb_merged"] for r in out) > 20
    assert written and not [t for each in written for t in each if t[1] == "string" or t[1].startswith("array")]
