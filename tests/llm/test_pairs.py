"""Decontamination, near duplicates, the pipeline."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tallyloom.llm import op1_decontamination as leaks
from tallyloom.llm import op9_jaccard as jaccard

from .conftest import SCHEMA, edited, prose

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute_groups(rows, n, num, den):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both and rows[i][0] is not None and rows[j][0] is not None and den * both >= num * either:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = r[0] if least[find(i)] is None else min(least[find(i)], r[0])
    return sorted((str(r[0]), len(sets[i]), str(None if r[0] is None else r[0] if not sets[i] else least[find(i)])) for i, r in enumerate(rows))


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80), (2, 60)])
def test_groups_by_brute_force(spark, docs, wide, rows, n, num):
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.similar_groups(wide if n == 2 else docs, n, (num, 100)).collect())
    assert got == brute_groups(rows, n, num, 100)


def test_large_group_of_near_copies_and_near_misses(spark, monkeypatch):
    """Blocks smaller than the groups, so that pairs of blocks and deep trees are gone through."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(8)
    passage, base = prose(rng, 90), prose(rng, 100)
    rows = [(i, edited(rng, base, rng.choice([0.0, 0.01, 0.03, 0.05])), "en", "a", 0) for i in range(150)]
    rows += [(1000 + i, passage + " " + prose(rng, rng.randint(5, 40)), "en", "a", 0) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.similar_groups(df, 4, (85, 100)).collect())
    assert got == brute_groups(rows, 4, 85, 100)


@pytest.mark.parametrize("num", [85, 60])
def test_slices_always_meet(num):
    """Sets at the threshold share an upper node, whatever their sizes."""
    rng = np.random.default_rng(0)
    ranges = jaccard.size_ranges(num, 100)
    met = 0
    for k in range(300):
        a = np.unique(rng.integers(0, 2**64, rng.integers(2, 400) if k else 165, dtype=np.uint64))
        common = a[rng.random(len(a)) < rng.choice([0.7, 0.9, 0.95, 1.0])] if k else a[:100]  # 100 of 165 tokens: two ranges apart
        b = np.unique(np.concatenate([common, rng.integers(0, 2**64, rng.integers(0, 1 + len(a) // 8) if k else 0, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= num * (len(a) + len(b) - both) and not np.array_equal(a, b):
            x, y = (jaccard.slice_signatures(s, len(s), num, 100, ranges) for s in (a, b))
            assert len(np.intersect1d(x, y)), (len(a), len(b), both)
            met += 1
    assert met > 30


def test_blocks_of_a_hot_node(spark):
    """A large component has blocks of its own, small ones share, and no block is much larger than asked for."""
    from collections import Counter

    rows = [(1, 5 if i < 5000 else 10_000 + i // 3, i) for i in range(9000)] + [(2, 7, i) for i in range(20)]
    got = jaccard.in_blocks(spark.createDataFrame(rows, "sig long, comp long, node long")).collect()
    assert len(got) == len(rows)
    sizes = Counter((r["sig"], r["blk"]) for r in got)
    assert max(sizes.values()) <= 1.5 * jaccard.BLOCK and len(sizes) <= 12
    big = {r["blk"] for r in got if r["comp"] == 5}
    assert len(big) == 5 and not big & {r["blk"] for r in got if r["comp"] != 5}


def test_tree_bounds_lose_no_link():
    rng = np.random.default_rng(1)
    sets = []
    for g in range(12):
        base = np.unique(rng.integers(0, 2**64, rng.integers(20, 200), dtype=np.uint64))
        for _ in range(6):
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) < 0.97], rng.integers(0, 2**64, 2, dtype=np.uint64)])))
    bitmaps = []
    for s in sets:
        bits = np.zeros(jaccard.bitmap_bits(len(s)), np.uint8)
        bits[(s & np.uint64(len(bits) - 1)).astype(int)] = 1
        bitmaps.append(np.packbits(bits, bitorder="little"))
    sizes = np.array([len(s) for s in sets])
    tree = jaccard.Tree(sizes, bitmaps, np.arange(len(sets)), 64)
    i, j = jaccard.traverse(tree, tree, 80, 100)
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(kept) < len(sets) ** 2 / 4
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (sizes[a] + sizes[b] - both):
                assert (a, b) in kept
                assert both <= jaccard.most_common(int(sizes[a]), int(sizes[b]), bitmaps[a], bitmaps[b])


def test_groups_of_nothing(empty):
    assert jaccard.similar_groups(empty).count() == 0


def test_one_of_each_stays(wide, rows):
    kept = jaccard.keep_one_of_each(wide)
    assert kept.columns == wide.columns
    groups = {i: c for i, _, c in brute_groups(rows, 5, 80, 100)}
    assert {str(r["doc_id"]) for r in kept.collect()} == {i for i, c in groups.items() if i == c}


def brute_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (leaks.MATCH if a[i - 1] == b[j - 1] else -leaks.MISMATCH), h[i - 1, j] - leaks.SKIP, h[i, j - 1] - leaks.SKIP)
    return int(h.max())


def test_alignment_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(0, 15)), rng.integers(0, 4, rng.integers(0, 25))
        assert leaks.smith_waterman(a, b) == brute_alignment(a, b)


def test_leaks(spark, wide, empty):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(12, 50))) for i in range(20)] + [(90, None), (91, ""), (92, "two words")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], set()
    for i, text in items[:20]:
        for k, copy in enumerate((text, text.upper().replace(".", " !"), edited(rng, text, 0.15))):
            rows.append((100 * i + k, f"{prose(rng, 60)} {copy} {prose(rng, 300)}", "en", "a", 0))
            want.add((100 * i + k, i))
        rows.append((100 * i + 50, f"{prose(rng, 60)} {' '.join(text.split(' ')[:4])} {prose(rng, 60)}", "en", "a", 0))
    # one item leaks into half of all texts
    rows += [(5000 + i, f"{prose(rng, 30)} {items[0][1]} {prose(rng, 30)}", "en", "a", 0) for i in range(80)]
    want |= {(5000 + i, 0) for i in range(80)}
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r["doc_id"], r["item_id"]) for r in leaks.contaminated(df, benchmark).collect()} == want
    left = leaks.drop_contaminated(df, benchmark)
    assert {r["doc_id"] for r in left.collect()} == {r[0] for r in rows} - {d for d, _ in want}
    assert leaks.drop_contaminated(wide, benchmark).columns == wide.columns
    assert leaks.drop_contaminated(wide, benchmark).count() == wide.count()
    assert leaks.contaminated(empty, benchmark).count() == 0 and leaks.contaminated(df, benchmark.limit(0)).count() == 0


def test_popular_edited_copy_leaks(spark):
    """Every fifth word changed, always alike, so that most of the item's 4-grams are nowhere in the corpus."""
    rng = random.Random(8)
    item = prose(rng, 20)
    copy = " ".join(f"changed{i}" if i % 5 == 4 else w for i, w in enumerate(item.split(" ")))
    benchmark = spark.createDataFrame([(1, item), (2, prose(rng, 20))], "item_id long, text string")
    for n in (3, 50):
        df = spark.createDataFrame([(i, f"{prose(rng, 30)} {copy} {prose(rng, 30)}", "en", "a", 0) for i in range(n)], SCHEMA)
        assert {(r["doc_id"], r["item_id"]) for r in leaks.contaminated(df, benchmark).collect()} == {(i, 1) for i in range(n)}


def plain_grams(w, n, gaps):
    """Runs of n words; with gaps: two runs of half of them with up to GAP words between."""
    if not gaps:
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    half = n // 2
    return {(*w[k : k + half], *w[k + half + g : k + n + g]) for g in range(leaks.GAP + 1) for k in range(len(w) - n - g + 1)}


def test_gapped_grams():
    texts = [[b"a", b"b", b"c", b"d", b"e", b"a", b"b", b"x", b"c", b"d"], [], [b"a", b"b", b"c"], [b"a", b"b", b"q", b"r", b"s", b"c", b"d"], [b"a", b"b", b"q", b"r", b"s", b"t", b"c", b"d"]]
    w = leaks.words([b" ".join(t) for t in texts])
    h, first = leaks.gapped(w, 4)
    assert (np.diff(first) >= 0).all()
    owner = np.searchsorted(w.first, first, "right") - 1
    sets = [set(h[owner == i].tolist()) for i in range(len(texts))]
    assert [len(s) for s in sets] == [len(plain_grams(t, 4, True)) for t in texts]
    assert len(sets[0] & sets[3]) == 1 and not sets[0] & sets[4]  # a b .. c d, up to three words apart


def test_recall_against_alignment_alone(spark):
    """Copies with words changed, added or left out at random or at regular places: found if and only if alignment covers half
    of the item, but for a tenth at most at any share of edits (measured: all but 3 %)."""
    rng = random.Random(40)
    fresh = iter(range(10**6))
    items, rows, want, share_of = [], [], set(), {}
    for i in range(240):
        item = [f"w{next(fresh)}" for _ in range(rng.choice([8, 12, 16, 24, 40, 60, 90]))]
        share, kind = [0.1, 0.2, 0.25, 0.3, 0.34, 0.4][i % 6], rng.choice(["change", "add", "leave", "any", "regular"])
        copy, every = [], round(1 / share)
        for k, x in enumerate(item):
            edit = k % every == every - 1 if kind == "regular" else rng.random() < share
            how = {"any": rng.choice(["change", "add", "leave"]), "regular": "change"}.get(kind, kind) if edit else "keep"
            copy += {"keep": [x], "change": [f"w{next(fresh)}"], "add": [x, f"w{next(fresh)}"], "leave": []}[how]
        number = {x: k for k, x in enumerate(dict.fromkeys(item + copy))}
        covered = brute_alignment([number[x] for x in item], [number[x] for x in copy]) >= leaks.MATCH * len(item) * 0.5
        items.append((i, " ".join(item)))
        rows.append((i, f"{prose(rng, 40)} {' '.join(copy)} {prose(rng, 40)}", "en", "a", 0))
        share_of[i] = share
        if covered:
            want.add((i, i))
    got = {(r["doc_id"], r["item_id"]) for r in leaks.contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(want) > 180
    for share in set(share_of.values()):
        mine = {p for p in want if share_of[p[0]] == share}
        assert len(mine & got) >= 0.9 * len(mine), (share, len(mine & got), len(mine))
    assert len(got) >= 0.95 * len(want), (len(got), len(want))


def test_seeds_lose_no_copy_and_short_items_leak(spark):
    """Against brute force over all pairs: every text that keeps its share of an item's gapped grams and half the alignment is found."""
    rng = random.Random(21)
    vocabulary = prose(rng, 60).replace(".", "").split(" ")
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, say(rng.choice([1, 2, 3, 4, 5, 9, 20, 40, 90]))) for i in range(24)]
    stock = say(6)
    items = [(i, w if len(w) < 9 else w[: len(w) // 2] + stock + w[len(w) // 2 :]) for i, w in items]  # a stock phrase in all
    texts = []
    for _ in range(150):
        w = list(rng.choice(items)[1])
        for k in range(len(w)):
            if rng.random() < rng.choice([0.0, 0.1, 0.3]):
                w[k] = rng.choice(vocabulary)
        texts.append([*say(rng.randint(0, 30)), *w, *say(rng.randint(0, 30)), *stock])
    want = set()
    for d, t in enumerate(texts):
        for i, w in items:
            grams, there = plain_grams(w, min(4, len(w)), len(w) >= 4), plain_grams(t, min(4, len(w)), len(w) >= 4)
            number = {x: k for k, x in enumerate(vocabulary)}
            if len(grams & there) >= max(1, len(grams) // leaks.KEPT) and brute_alignment([number[x] for x in w], [number[x] for x in t]) >= leaks.MATCH * len(w) * 0.5:
                want.add((d, i))
    df = spark.createDataFrame([(d, " ".join(t), "en", "a", 0) for d, t in enumerate(texts)], SCHEMA)
    got = {(r["doc_id"], r["item_id"]) for r in leaks.contaminated(df, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()}
    assert want <= got and len(want) > 100, (len(want), sorted(want - got)[:5])
    long = {(d, i) for d, i in got if len(dict(items)[i]) >= 4}
    number = {x: k for k, x in enumerate(vocabulary)}
    assert all(brute_alignment([number[x] for x in dict(items)[i]], [number[x] for x in texts[d]]) >= leaks.MATCH * len(dict(items)[i]) * 0.5 for d, i in long)
    assert not {(d, i) for d, i in got - want if len(dict(items)[i]) < 4}


def test_words_without_collisions(spark):
    """Thue-Morse words, on which polynomial hashes collide, are different words everywhere."""
    thue = lambda n, a, b: "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))
    texts = [thue(n, a, b) for n in (64, 1024, 2048) for a, b in ("ab", "ba")]
    got = jaccard.similar_groups(spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA), 4, (85, 100)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, i) for i in range(len(texts))]


def test_pipeline_stages(spark, docs, rows, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(12)
    items = [(i, prose(rng, 30)) for i in range(5)]
    more = [(9000, f"{prose(rng, 50)} {items[2][1]} {prose(rng, 50)}", "en", "a", 0), (9001, prose(rng, 60) + " password=abcdef123456", "en", "a", 0)]
    docs.union(spark.createDataFrame(more, SCHEMA)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, out, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = out.collect()
        if name != "packing":
            assert out.columns == pipeline.COLUMNS
    ids = {name: {r["doc_id"] for r in got} for name, got in seen.items()}
    assert ids["secret_scans"] == ids["decontamination"] == ids["packing"] and 9000 in ids["near_duplicates"] and 9000 not in ids["decontamination"]
    assert {r["text"] for r in seen["secret_scans"] if r["doc_id"] == 9001} == {more[1][1].replace("password=abcdef123456", "[SECRET]")}
    assert 5 in ids["near_duplicates"] and not {6, 7, *range(100, 120)} & ids["near_duplicates"]
    whole = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r[:5]) for r in whole) == sorted(str(r[:5]) for r in seen["packing"])


def test_pipeline_by_brute_force(spark, tmp_path):
    """Every stage's rows against a plain version of it, over the rows that the stage before it returned."""
    import re
    import zlib

    import corpus_pipeline as pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from tallyloom.llm import op8_quality as quality

    from .test_scans import base_secrets, counts

    rng = random.Random(40)
    items = [(i, prose(rng, rng.choice([3, 15, 40]))) for i in range(8)]
    rows = [(i, prose(rng, rng.randint(10, 160)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), 9) for i in range(220)]
    rows += [(1000 + i, edited(rng, rows[i % 7][1], rng.choice([0.0, 0.02, 0.1])), "en", "a", 9) for i in range(60)]
    rows += [(2000 + i, f"{prose(rng, 40)} {rng.choice(items)[1]} {prose(rng, 40)}", "en", "a", 9) for i in range(20)]
    rows += [(3000 + i, f"{prose(rng, 50)} password=abc{i}def token: zyxwvut {prose(rng, 20)}", "fr", "b", 9) for i in range(10)]
    rows += [(4000 + i, " ".join(w + "##" for w in prose(rng, 60).split()), "en", "a", 9) for i in range(10)]
    rows += [(None, prose(rng, 50), "en", "a", 9), (5000, None, "en", "a", 0), (5001, "", "en", "a", 0), (5002, rows[0][1], "en", "a", 9), (5002, rows[0][1], "en", "a", 9)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(pipeline.STAGES)
    plain = lambda df: [tuple(r) for r in df.collect()]
    key = lambda rows: sorted(map(str, rows))

    def next_of(name, given):
        out = stage[name](spark, given, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    # quality: the plain rules by brute force, the outlier test by its own report (which test_scans holds against NumPy)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = next_of("quality_rules", docs)
    n = {str(t): counts(t or "") for _, t, *_ in rows}
    passing = [r for r in rows if n[str(r[1])][0] >= 20 and 100 * n[str(r[1])][4] <= 30 * n[str(r[1])][0]]
    got = key(plain(kept))
    assert set(got) <= set(key(passing)) and all(got.count(x) == key(rows).count(x) for x in set(got))
    report = {str(r["doc_id"]): r for r in quality.quality_report(docs).collect()}
    assert {str(r[0]) for r in plain(kept)} == {i for i, r in report.items() if r["kept"]}
    assert not {str(4000 + i) for i in range(10)} & {str(r[0]) for r in plain(kept)} and kept.count() > 0.9 * (len(passing) - 10)

    # near duplicates
    given = plain(kept)
    single = next_of("near_duplicates", kept)
    least = {i: c for i, _, c in brute_groups(given, 5, 80, 100)}
    assert key(plain(single)) == key(r for r in given if least[str(r[0])] == str(r[0]))

    # decontamination: the rule itself, over all pairs
    clean = next_of("decontamination", single)
    words = lambda t: re.sub(r"[!-/:-@\[-`{-~]", " ", (t or "").lower()).split()
    left = []
    for r in plain(single):
        t, leak = words(r[1]), False
        for _, x in items:
            w = words(x)
            k = min(4, len(w))
            grams, there = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
            if len(grams & there) >= max(1, len(grams) // leaks.KEPT):
                number = {v: i for i, v in enumerate({*w, *t})}
                leak |= brute_alignment([number[v] for v in w], [number[v] for v in t]) >= len(w)  # half of 2 points a word
        if not leak:
            left.append(r)
    assert key(plain(clean)) == key(left) and len(left) < single.count()

    # secrets: marks in place of the union of the spans
    marked = next_of("secret_scans", clean)
    want = []
    for i, t, lang, source, size in left:
        out, at = "", 0
        for _, a, b in base_secrets(t):
            out += t[at:a] + "[SECRET]" if a >= at else ""
            at = max(at, b)
        want.append((i, out + t[at:], lang, source, len(out + t[at:])) if at else (i, t, lang, source, size))
    assert key(plain(marked)) == key(want) and any("[SECRET]" in r[1] for r in want)

    # packing
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = []
    for i, t, *_ in want:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        pieces += [(i, p, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for p, at in enumerate(range(0, len(ids), 4096))]
    packed = plain(stage["packing"](spark, marked, str(tmp_path)))
    assert key(r[:5] for r in packed) == key(pieces)
    assert len({r[5] for r in packed}) <= 1.1 * sum(r[3] for r in pieces) / 4096 + 1


def test_pipeline_of_nothing(spark, empty, tmp_path):
    """Empty tables, and documents of which none passes."""
    import corpus_pipeline as pipeline

    spark.createDataFrame([(1, prose(random.Random(1), 20))], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    empty.write.parquet(f"{tmp_path}/a/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/a").count() == 0
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    spark.createDataFrame([(1, None, None, None, None), (None, "few words", "en", "a", 9)], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/b").count() == 0
