"""Every registered query against its SQL on the smallest tables."""

import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyloom.plans import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


MERGED = {
    "merge_contigs": {"test": False}, "merge_counts_rep": {"aggregate": "rep"}, "merge_counts_mean": {"aggregate": "mean"}, "merge_counts_median": {"aggregate": "median"},
    "merge_min_members": {"least": 3}, "merge_scored_maxabs": {"by_sd": True},
}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(MERGED)))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    assert got
    if name in queries.SQL:
        want = duck.sql(queries.SQL[name])
        assert sorted(want.columns) == columns
        assert got == Counter(tuple(plain(v) for v in r) for r in want.select(*columns).fetchall())


RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(RC)[::-1]


def plain_merge(kmers, near, key):
    """Unstranded contigs over overlaps 30 to 15, by walking the paths of joints in plain Python: (sequence, members, representative)."""
    contigs = {s: (s, [s]) for s in kmers}
    for o in range(30, 14, -1):
        while True:
            knots = defaultdict(lambda: ([], []))
            for name, (s, members) in contigs.items():
                for end, mer, is_pre in ((s[:o], members[0], True), (s[-o:], members[-1], False)):
                    if end != rc(end):
                        flip = rc(end) < end
                        knots[min(end, rc(end))][0 if is_pre == flip else 1].append((name, not flip, mer))
            step = {}
            for p, q in knots.values():
                if len(p) == len(q) == 1 and p[0][0] != q[0][0] and near(p[0][2], q[0][2]):
                    step[p[0][:2]] = q[0][:2]
                    step[q[0][0], not q[0][1]] = (p[0][0], not p[0][1])
            if not step:
                break
            targets, done = set(step.values()), set()
            starts = sorted(n for n in step if n not in targets) + sorted(((n, True) for n, _ in step), key=lambda n: n[0])
            for start in starts:
                if start[0] in done or (start not in step and start not in targets):
                    continue
                path = [start]
                while path[-1] in step and step[path[-1]] != start:
                    path.append(step[path[-1]])
                done |= {n for n, _ in path}
                best = min((key(n), n) for n, _ in path)[1]
                if (best, True) not in path:
                    path = [(n, not f) for n, f in reversed(path)]
                sequence, members = "", []
                for n, f in path:
                    s, m = contigs.pop(n)
                    s = s if f else rc(s)
                    sequence += s[o if sequence else 0 :]
                    members += m if f else m[::-1]
                contigs[best] = (sequence, members)
    return [(s, m, name) for name, (s, m) in contigs.items()]


@pytest.fixture(scope="module")
def shared_kmers(duck):
    from tallyloom.plans import fixtures

    counts = defaultdict(lambda: np.zeros(fixtures.N))
    for feature, i, x in duck.sql(f"WITH {fixtures.kmers_sql(31)} SELECT feature, sample_idx, cnt FROM g").fetchall():
        counts[feature][i] = x
    return dict(counts)


@pytest.mark.parametrize("name", MERGED)
def test_merged(spark, shared_kmers, name):
    """The merging queries over all their rows, against plain Python."""
    how = MERGED[name]

    def near(a, b):
        x, y = shared_kmers[a], shared_kmers[b]
        r = np.corrcoef(x, y)[0, 1] if x.std() > 0 and y.std() > 0 else 0.0
        return 0.5 * (1 - r) < 0.2

    sd = {k: float(np.std(v, ddof=1)) for k, v in shared_kmers.items()}
    found = plain_merge(shared_kmers, near if how.get("test", True) else lambda a, b: True, (lambda n: -sd[n]) if how.get("by_sd") else lambda n: 0)
    found = [c for c in found if len(c[1]) >= how.get("least", 1)]
    got = queries.QUERIES[name](spark, DATA).collect()
    assert len(found) > 10 and max(len(m) for _, m, _ in found) > 20
    if "aggregate" not in how:
        assert sorted((r["contig"], r["nb_merged"], r["rep"]) for r in got) == sorted((s, len(m), n) for s, m, n in found)
        return
    pick = {"rep": lambda m, n: shared_kmers[n], "mean": lambda m, n: np.mean([shared_kmers[x] for x in m], axis=0), "median": lambda m, n: np.median([shared_kmers[x] for x in m], axis=0)}[how["aggregate"]]
    want = {(s, len(m), n, i): v for s, m, n in found for i, v in enumerate(pick(m, n))}
    assert {(r["contig"], r["nb_merged"], r["rep"], r["sample_idx"]) for r in got} == set(want)
    assert all(abs(r["value"] - want[r["contig"], r["nb_merged"], r["rep"], r["sample_idx"]]) < 1e-5 for r in got)
