"""Ranked search against plain Python over all rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import op12_search as ms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items, k):
    each = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in each)
    total = sum(sum(c.values()) for _, c in each)
    df = Counter(t for _, c in each for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in each:
            m = 50 + 50 * sum(c.values()) * n // total if total else 50
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def corpus(seed, n=600, vocabulary=300):
    rng = random.Random(seed)
    word = lambda: f"w{int(vocabulary * rng.random() ** 3)}" + ("é" if rng.random() < 0.05 else "")
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(n)]
    docs += [(10_000 + i, "Copies! of one-and-the_same W1 w2 w250 text") for i in range(90)] + [(20_000, None), (20_001, ""), (20_002, "...")]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 25)))) for i in range(25)] + [(100, "copies text w1"), (101, None), (102, "?!"), (103, "unheardof"), (104, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("block", [ms.BLOCK, 37])
def test_all_rows(spark, rows, docs, wide, empty, monkeypatch, block):
    monkeypatch.setattr(ms, "BLOCK", block)
    texts, items = corpus(1)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    queries = spark.createDataFrame(items, "item_id long, text string")
    got = ms.rank_documents(df, queries, 20).select("item_id", "rank", "doc_id", "score")
    assert Counter(tuple(r) for r in got.collect()) == plain(texts, items, 20)
    if block == 37:  # several runs of items
        monkeypatch.setattr(ms, "ITEM_BYTES", 600)
        assert Counter(tuple(r) for r in ms.rank_documents(df, queries, 20).collect()) == plain(texts, items, 20)
        return
    mine = [(i, t) for i, t, *_ in rows]
    asked = [("a", mine[0][1]), ("b", "word changed"), (None, "WORD")]
    questions = spark.createDataFrame(asked, "item_id string, text string")
    want = plain(mine, asked, 50)
    assert Counter(tuple(r) for r in ms.rank_documents(docs, questions).collect()) == want
    assert Counter(tuple(r) for r in ms.rank_documents(wide, questions).collect()) == want
    assert ms.rank_documents(empty, questions).count() == 0 == ms.rank_documents(docs, questions.limit(0)).count()


def _run(spark, seed):
    texts, items = corpus(seed, 3000)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    impacts, run = ms.index_impacts(df, spark.createDataFrame(items, "item_id long, text string").collect(), 10, "doc_id", "text")
    thresholds = ms.first_thresholds(impacts, run, 10)
    blocks = []
    for r in impacts.where("size(ids) > 0").orderBy("ids").collect():
        of = lambda c, r=r: np.array(r[c], np.int64)
        blocks.append((ms.Block(of("terms"), of("lengths"), of("docs"), of("values"), len(r["ids"])), list(r["ids"]), of("joint")))
    return run, thresholds, blocks


def test_pair_bounds_skip_more_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ms, "BLOCK", 64)
    run, thresholds, blocks = _run(spark, 2)
    work = {}
    for pairs in (True, False):
        found = ms.Found(10, thresholds.copy())
        for block, ids, joint in blocks:
            ms.search_block(block, ids, run, joint if pairs else None, found)
        work[pairs] = (found.skipped, found.candidates, found.kept)
    brute = ms.Found(10, np.ones(len(run.terms), np.int64))
    for block, ids, _ in blocks:
        for i, t in enumerate(run.ordered):
            score = block.score(np.arange(block.n), t)
            brute.add(i, [ids[d] for d in np.flatnonzero(score)], score[score > 0])
    every = sum(len(b[1]) for b in blocks) * len(run.terms)
    same = lambda kept: {i: x for i, x in kept.items() if x}
    assert same(work[True][2]) == same(work[False][2]) == same(brute.kept)
    assert work[True][0] > 1.1 * work[False][0] > 0  # (item, block) skipped
    assert work[True][1] < 0.9 * work[False][1] < 0.5 * every  # candidates


def test_bounds_hold(spark, monkeypatch):
    monkeypatch.setattr(ms, "BLOCK", 64)
    run, _, blocks = _run(spark, 3)
    for block, _, joint in blocks[:20]:
        most = block.most(run.matrix)
        pair = np.where(run.pair_at >= 0, np.append(joint, 0)[run.pair_at], 0)
        tight, loose = ms.bounds(most, pair), ms.bounds(most, None)
        assert (tight <= loose).all() and (np.diff(tight, axis=1) >= 0).all()
        for i in range(len(run.terms)):
            for t in range(run.matrix.shape[1] + 1):
                assert block.score(np.arange(block.n), [x for x in run.matrix[i, :t].tolist() if x >= 0]).max(initial=0) <= tight[i, t]


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(ms, "word_hashes", lambda buffer, starts, ends: np.zeros(len(starts), np.uint64))
    v = ms.Vocabulary.of({b"one", b"two"})
    assert [v.terms[i] if i >= 0 else None for i in v.find(ms.terms_of([b"two three", b"ONE"]))] == [b"two", None, b"one"]
