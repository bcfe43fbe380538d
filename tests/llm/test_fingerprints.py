"""Order MinHash against plain Python over all rows."""

import hashlib
import random
from collections import Counter, defaultdict

import regex
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import op13_fingerprints as omh

PYTHON_TOKEN = regex.compile(r"(?V1)[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]|[[\p{L}\p{M}\p{N}]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]]{1,8}|[^\ \t\n\x0b\f\r\p{L}\p{M}\p{N}]")


def h64(*values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def plain(text, k=3, tuple_size=2, size=64):
    """Orders as sorts of all numbered k-mers by their distance from where the order begins."""
    tokens = PYTHON_TOKEN.findall(text) or [text]
    kmers = [h64(*tokens[i : i + k]) for i in range(max(1, len(tokens) - k + 1))]
    seen, places = defaultdict(int), []
    for i, h in enumerate(kmers):
        places.append((h64(h >> 29, (seen[h >> 29],)) >> 29, i))
        seen[h >> 29] += 1
    out = []
    for f in range(size):
        begin = (f << 35) // size
        order = sorted(places, key=lambda x: ((x[0] - begin) % (1 << 35), x[1]))
        chosen = sorted(order[t % len(order)][1] for t in range(tuple_size))
        out.append(h64(*(kmers[i] for i in chosen)) & 0xFFFFFFFF)
    return out


TEXTS = [
    "", " ", "\n\t", "one", "one two", "one two three", "a b a b a b a b a b c", "the " * 300, "日本語のテキストです。終わり", "café naïve — «quoted» 🙂🙂 x", "abcdefghijklmnopqrstuvwxyz" * 3, "Tab\there there",
]


def test_fingerprint_by_brute_force(spark):
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice(["red", "green", "blue", "a", "of", "the", "cat.", "12"]) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["fingerprint"] for r in omh.fingerprints(df).collect()} == {i: plain(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["fingerprint"] for r in omh.fingerprints(df, k=2, tuple_size=3, size=10).collect()} == {i: plain(t, 2, 3, 10) for i, t in enumerate(texts)}


def expected(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    out = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 3
        e = t[: len(t) - cut] + u[:cut]
        a, b, c = plain(t), plain(e), plain(u)
        near = lambda x, y: sum(p == q for p, q in zip(x, y, strict=True)) / 64
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(f"{x:08x}" for x in a), "".join(f"{x:08x}" for x in b), near(a, b), near(a, c)))
    return Counter(out)


def test_all_columns(spark, rows, docs, wide, empty):
    short = [(i, t) for i, t, *_ in rows if not t or len(t) < 3000] + [(2000 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(short, "doc_id long, text string").repartition(5)
    assert Counter(tuple(r) for r in omh.edit_fingerprints(df).collect()) == expected(short)
    one = spark.createDataFrame([(5, "a text of one row only")], "doc_id long, text string")
    assert Counter(tuple(r) for r in omh.edit_fingerprints(one).collect()) == expected([(5, "a text of one row only")])
    nulls = spark.createDataFrame([(None, "b c"), (None, "a d e f")], "doc_id long, text string")
    assert Counter(tuple(r) for r in omh.edit_fingerprints(nulls).collect()) == expected([(None, "b c"), (None, "a d e f")])
    assert omh.edit_fingerprints(empty).count() == 0
    assert omh.edit_fingerprints(wide).count() == len(rows)
    named = spark.createDataFrame([("b", "x y z"), ("a", "x y"), ("c", None)], "doc_id string, text string")
    assert {r["doc_id"]: r["n_chars"] for r in omh.edit_fingerprints(named).collect()} == {"a": 3, "b": 5, "c": 0}


def test_order_and_edits_count(spark):
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(900)]
    cut = [words[i : i + 30] for i in range(0, 900, 30)]
    rng.shuffle(cut)
    edit = lambda share: " ".join(f"new{rng.randint(0, 9**6)}" if rng.random() < share else w for w in words)
    texts = [" ".join(words), edit(0.02), edit(0.1), edit(0.3), " ".join(w for c in cut for w in c), " ".join(f"w{rng.randint(0, 5000)}" for _ in range(900))]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    f = {r["i"]: r["fingerprint"] for r in omh.fingerprints(df, "i", size=256).collect()}
    near = [sum(x == y for x, y in zip(f[0], f[i], strict=True)) / 256 for i in range(6)]
    assert near[0] == 1 and near[1] > 0.7 and near[1] > near[2] > near[3] and near[5] == 0
    # blocks moved about keep nearly all k-mers (Jaccard about 0.88), but not their order
    assert 0.2 < near[4] < near[1]


def test_no_python_and_one_exchange_of_texts(spark, docs):
    plan = omh.edit_fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    physical = omh.edit_fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert sum("hashpartitioning(range" in line for line in physical.split("\n")) == 1


def test_likeness_and_writing(spark):
    r = spark.range(1).select(omh.likeness(F.lit([1, 2, 3, 4]), F.lit([1, 0, 3, 0])).alias("n"), omh.written(F.lit([255, 0]).cast("array<long>")).alias("w")).first()
    assert (r["n"], r["w"]) == (0.5, "000000ff00000000")
