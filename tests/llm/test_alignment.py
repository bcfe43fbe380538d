"""Cross-tokenizer alignment against plain Python over all rows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyloom.llm import op11_alignment as al


def plain(pair, texts):
    """The contract's columns for each text, from all pairs of tokens."""
    docs = []
    for t in texts:
        a, _, b, _, _ = pair.encode([(" " + t).encode()] if t else [])
        a, b = a.tolist(), b.tolist()
        ends = lambda ids, size: np.cumsum([0] + [len(size[i]) for i in ids]).tolist()
        x, y = ends(a, pair.a_bytes), ends(b, pair.b_bytes)
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if x[i] < y[j + 1] and y[j] < x[i + 1]]
        cuts = sorted(set(x[1:]) & set(y[1:]))
        groups, before = [], 0
        for c in cuts:
            inside = lambda ids, e: ",".join(str(ids[i]) for i in range(len(ids)) if before < e[i + 1] <= c)  # noqa: B023, E731
            groups.append(f"{inside(a, x)}|{inside(b, y)}")
            before = c
        docs.append((a, b, links, groups))
    count = Counter(p for _, _, links, _ in docs for p in set(links))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [
        (len(a), len(b), len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for a, b, links, g in docs
    ]


@pytest.fixture(scope="module")
def pair():
    return al.Pair(*al.VOCABULARIES)


def test_ids_are_those_of_the_whole_text(pair):
    """One text at a time by the tokenizers themselves, and many units encoded together."""
    rng = random.Random(6)
    letters = [*"abc de.,'éñ日本 AB12🙂▁\x00", " the ", "'s", "  x", "<|endoftext|>"]
    texts = [" " + "".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    a, n_a, b, n_b, ok = pair.encode([t.encode() for t in texts])
    assert 100 < ok.sum() < len(texts)
    for t, x, y, good in zip(texts, np.split(a, np.cumsum(n_a)[:-1]), np.split(b, np.cumsum(n_b)[:-1]), ok, strict=True):
        want = pair.a.encode(t, add_special_tokens=False).ids, pair.b.encode(t[1:])
        given = all(b"".join(map(size.__getitem__, ids)) == t.encode() for size, ids in zip((pair.a_bytes, pair.b_bytes), want, strict=True))
        assert (x.tolist(), y.tolist()) == (want if given else ([], [])) and given == good


ODD = ["a  b", "x ▁ y", "tail ", " head", "\n\t", "<|endoftext|> <s></s> <0x41>", "日本語 中文", "a\x00b", "é é", "the the the"]


@pytest.mark.parametrize("max_keys", [al.MAX_KEYS, 1])
def test_all_columns(spark, pair, rows, docs, monkeypatch, max_keys):
    if max_keys == 1:  # several buckets and rounds, several levels of the tree
        monkeypatch.setattr(al, "BUCKET_KEYS", 400)
        monkeypatch.setattr(al, "TREE", 2)
    more = [(900 + i, t) for i, t in enumerate(ODD)] + [(900, ODD[0]), (1000, None)]
    every = [(i, t) for i, t, *_ in rows if not t or len(t) < 3000] + more
    df = spark.createDataFrame(every, "doc_id long, text string").repartition(5)
    got = al.align_documents(df, max_keys=max_keys).collect()
    want = Counter((i, *x) for (i, _), x in zip(every, plain(pair, [t or "" for _, t in every]), strict=True))
    assert Counter(tuple(r) for r in got) == want
    if max_keys == 1:
        assert len(al.count_pairs(df, max_keys=1).rounds) > 3


def test_long_text_clashing_columns_and_no_rows(spark, pair, rows, wide, empty):
    n = len(rows)
    got = al.align_documents(wide).collect()
    assert len(got) == n and {r["doc_id"] for r in got} == {r[0] for r in rows}
    assert al.align_documents(empty).count() == 0
    text = "long " * 60000 + "　 tail"
    r = al.align_documents(spark.createDataFrame([("x", text)], "doc_id string, text string"), with_groups=True).first()
    a, _, b, _, _ = pair.encode([(" " + text).encode()])
    assert (r["doc_id"], r["n_a"], r["n_b"]) == ("x", len(a), len(b)) and hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"]


def test_aligner_is_the_same_for_units_and_whole_texts(pair):
    rng = random.Random(3)
    letters = [*"abc de  \n\t.,'éñ日本 AB12🙂\r", "<|endoftext|>", " the ", "'s", "  \n  ", " "]
    aligner = al.Aligner(*al.VOCABULARIES)
    for _ in range(30):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(40)]
        known, of, first = aligner.chunk(texts)
        whole = al.align(pair, [(" " + t).encode() for t in texts if t])
        mine = [b";".join(known.written[x] for x in of[i:j]) for (i, j), t in zip(zip(first[:-1], first[1:], strict=True), texts, strict=True) if t]
        assert mine == whole.written


def test_units_that_share_a_hash_are_told_apart(pair, monkeypatch):
    monkeypatch.setattr(al, "word_hashes", lambda buffer, starts, ends: np.zeros(len(starts), np.uint64))
    texts = ["some words here", "other words there", "some words here"]
    known, of, first = al.Aligner(*al.VOCABULARIES).chunk(texts)
    assert [b";".join(known.written[x] for x in of[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)] == al.align(pair, [(" " + t).encode() for t in texts]).written


def test_perfect_hash_is_minimal_and_verified():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 50000))
    buckets = 5
    of = al.bucket_of(keys, buckets)
    rows = []
    for b in range(1, buckets):  # a round without the first bucket
        sizes, bits, order = al.build_hash(keys[of == b])
        assert sum(sizes) < 4 * (of == b).sum()
        rows.append((b, sizes, np.packbits(bits, bitorder="little").tobytes(), order.tobytes()))
    index = al.PairIndex(1, buckets, rows)
    at = index.index(keys)
    assert sorted(at[of > 0]) == list(range(len(index))) and (at[of == 0] == -1).all() and (index.keys[at[of > 0]] == keys[of > 0]).all()
    assert (index.index(keys + (1 << 50)) == -1).all() and len(al.PairIndex(0, 1, []).index(keys)) == len(keys)
