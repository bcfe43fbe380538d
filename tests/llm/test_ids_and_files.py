"""Sharding, packing, archive."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyloom.llm import op3_sharding as sharding
from tallyloom.llm import op6_packing as packing
from tallyloom.llm import op7_warc as warc


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation_and_its_reverse(n):
    p = sharding.permute(np.arange(n), n, seed=5)
    assert sorted(p) == list(range(n))
    for i in range(0, n, max(1, n // 50)):
        shard, slot = sharding.locate(i, n, 7, seed=5)
        assert (shard, slot) == (p[i] % 7, p[i] // 7)
        assert sharding.row_at(shard, slot, n, 7, seed=5) == i


def test_shards(docs, wide, empty, rows):
    got = sharding.shard_rows(docs, 5, seed=3).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1
    for r in got:
        assert (r["shard"], r["slot"]) == sharding.locate(r["row_number"], len(rows), 5, seed=3)
    key = lambda r: tuple(str(x) for x in r)
    again = sharding.shard_rows(wide, 5, seed=3).drop("row_number").collect()
    assert sorted(map(key, again)) == sorted(key(r) for r in sharding.shard_rows(docs, 5, seed=3).drop("row_number").collect())
    assert sharding.shard_rows(empty, 5).count() == 0


def test_best_fit_plan_is_feasible_and_near_the_bound():
    rng = np.random.default_rng(1)
    for capacity in (10, 64, 4096):
        lengths = np.concatenate([rng.integers(1, capacity + 1, 800), np.full(300, capacity), np.full(500, max(1, capacity // 3))])
        histogram = Counter(int(x) for x in lengths)
        plan = packing.plan_best_fit(histogram, capacity)
        used, ranks = defaultdict(list), defaultdict(list)
        for length, first, sequences, each, start, offset in plan:
            for s in range(sequences):
                for k in range(each):
                    used[start + s].append((offset + k * length, length))
                    ranks[length].append(first + s * each + k)
        assert all(sorted(ranks[n]) == list(range(c)) for n, c in histogram.items())
        for spans in used.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(used) <= 1.25 * -(-int(lengths.sum()) // capacity) + 1


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing_round_trip(docs, wide, empty, rows, capacity):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[i, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    for df in (docs, wide):
        got = packing.pack_documents(df, capacity).collect()
        assert Counter(tuple(r)[:5] for r in got) == want
        by = defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for spans in by.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= capacity
    assert packing.pack_documents(empty, capacity).count() == 0


def test_word_ids_equal_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["It's don't x''s a.b,,c -- É ÉCOLE 12a3 <|endoftext|> end", "İstanbul KK   x y ﬁ é . 'S", "", "….,;a", "日本語 text😀!!😀", "a\x1cb\x85c \tQ'LL"]
    thue = lambda n, a, b: "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))
    texts += [thue(n, a, b) for n in (1024, 2048) for a, b in ("ab", "ba")] + ["z" * 300 + " " + "z" * 299 + "y"]
    for ids in (packing.WordIds(t), packing.WordIds(t)):
        for _ in range(2):  # from the tokenizer, then from what is kept
            got = ids.encode([x.encode() for x in texts])
            assert [list(g) for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_word_ids_with_colliding_hashes(monkeypatch):
    """With a hash that only looks at lengths, words are told apart by their bytes."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tallyloom.llm import words

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(words, "word_hashes", lambda buffer, starts, ends: (ends - starts).astype(np.uint64))
    ids = packing.WordIds(t)
    for texts in (["understanding"], ["electricities"], ["everything absolutely"], ["one"]):
        assert [list(g) for g in ids.encode([x.encode() for x in texts])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_archive(spark, tmp_path):
    rows = [(3, "http://a", "<p>x</p>"), (1, "http://b\nc", "<p>x</p>"), (2, None, None), (9, "u", ""), (None, "v", "<p>x</p>"), (7, "w", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n"), (7, "w", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/archive"
    warc.write_archive(pages, path)
    records = warc.read_archive(spark, path)
    seen = set()
    for r in records.collect():
        header, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        lines = header.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        assert lines[0] == "WARC/1.1" and fields["WARC-Date"] == warc.DATE and fields["WARC-Record-ID"] not in seen
        seen.add(fields["WARC-Record-ID"])
        block = rest[: int(fields["Content-Length"])]
        assert rest == block + b"\r\n\r\n"
        http, _, payload = block.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and f"Content-Length: {len(bytes(r['payload']))}".encode() in http
        assert payload == (b"" if fields["WARC-Type"] == "revisit" else bytes(r["payload"]))
        assert (fields.get("WARC-Profile") is not None) == (fields["WARC-Type"] == "revisit")
    got = warc.parse_records(records).collect()
    sha = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter((i, len((h or "").encode()), sha(h)) for i, _, h in rows)
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == Counter([(1, "response", None), (3, "revisit", 1), (None, "revisit", 1), (2, "response", None), (9, "revisit", 2), (7, "response", None), (7, "revisit", 7)])
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    warc.write_archive(pages, f"{path}-large", min_revisit_bytes=9)
    assert {(r["page_id"], r["record_type"]) for r in warc.parse_records(warc.read_archive(spark, f"{path}-large")).collect() if r["record_type"] == "revisit"} == {(7, "revisit")}
    warc.write_archive(pages.limit(0), f"{path}-none")
    assert warc.read_archive(spark, f"{path}-none").count() == 0


def test_archive_finds_damage(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "u", "<p>x</p>"), (2, "v", "<p>x</p>"), (3, "w", "y" * 100_000)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/archive"
    warc.write_archive(pages, path)
    assert warc.parse_records(warc.read_archive(spark, path)).count() == 3

    def damaged(name, **columns):
        other = f"file://{tmp_path}/{name}"
        for t in ("payloads", "records"):
            df = spark.read.parquet(f"{path}/{t}")
            df.withColumns({c: F.expr(e) for c, e in columns.items() if c in df.columns}).write.parquet(f"{other}/{t}")
        return warc.parse_records(warc.read_archive(spark, other))

    for name, change in {
        "payload": {"payload": "cast(replace(cast(payload as string), 'x', 'z') as binary)"}, "length": {"header": "replace(header, 'Content-Length: ', 'Content-Length: 1')"},
        "digest": {"header": "regexp_replace(header, 'sha1:.', 'sha1:2')"}, "http": {"http": "replace(http, 'HTTP/1.1', 'HTTX/1.1')"},
    }.items():
        with pytest.raises(Exception, match="damaged payload|disagree"):
            damaged(name, **change).collect()


def test_archive_of_the_usual_edges(spark, tmp_path):
    """Further columns under names that the archive uses, nulls in all columns, a very long payload, repeated rows."""
    from pyspark.sql import functions as F

    rows = [(1, "u", "é" * 3_000_000), (None, None, None), (None, None, None), (5, None, ""), (4, "u", "a"), (4, "u", "a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("id", "row", "digest", "payload", "header", "http", "kind", "first_id", "s", "f")})
    path = f"file://{tmp_path}/edges"
    warc.write_archive(pages, path)
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.parse_records(warc.read_archive(spark, path)).collect())
    assert got == Counter([(1, 6_000_000, "response", None), (None, 0, "revisit", 5), (None, 0, "revisit", 5), (5, 0, "response", None), (4, 1, "response", None), (4, 1, "revisit", 4)])
