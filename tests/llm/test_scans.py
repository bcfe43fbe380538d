"""Secrets, personal data, licenses, quality, language."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tallyloom.llm import op2_secrets as secrets
from tallyloom.llm import op4_pii as pii
from tallyloom.llm import op5_licenses as licenses
from tallyloom.llm import op8_quality as quality
from tallyloom.llm import op10_language as language

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def same(a, b):
    key = lambda r: tuple(str(x) for x in r)
    return sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def base_secrets(t):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A):
        out += [("assign", m.start(), m.end())] * (len(m[2]) >= 6)
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_secrets_by_brute_force(spark, docs, wide, empty):
    rng = random.Random(3)
    parts = ["password=", "Token: '", "API_KEY = \"", "apikey:", "secret:token:abcdefgh", "pass", "AKIA", "AKIAAKIA", "ABCDEFGHIJ234567", "deadbeef", "0123456789abcdef", "é", "😀", " ", "\n", "=", "abc", "x9", "----------", "ſecret=abcdefg"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    for r in secrets.secret_report(df).collect():
        want = base_secrets(texts[r["doc_id"]])
        say = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(say).encode()).hexdigest(), (texts[r["doc_id"]], r["spans"], say)
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random")] == say
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, *_ in want) for x in ("assign", "access", "hex")]
    report = secrets.secret_report(docs)
    assert report.count() == docs.count() and same(report, secrets.secret_report(wide))
    assert secrets.secret_report(empty).count() == 0


def test_random_tokens_and_redaction(spark):
    rng = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [(i, f"see {''.join(rng.choice(letters) for _ in range(40))} here", "en", "a", 0) for i in range(200)]
    rows += [(1000 + i, f"see {('version' + str(i % 3) + 'release') * 3} here", "en", "a", 0) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    n = {r["doc_id"]: r["n_random"] for r in secrets.secret_report(df).collect()}
    assert sum(n[i] for i in range(200)) >= 185
    assert sum(n[1000 + i] for i in range(200)) <= 10
    clean = secrets.redact_secrets(spark.createDataFrame([(1, "é password=abcdef1 x", "en", "a", 20), (2, "plain", "en", "a", 5), (3, None, None, None, None)], SCHEMA)).collect()
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in clean} == {(1, "é [SECRET] x", 12), (2, "plain", 5), (3, None, None)}


def test_secrets_alone_and_among_worded_tokens(spark):
    rng = random.Random(15)
    lower36, base62 = "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = ["ba", "ne", "ri", "to", "sel", "mar", "en", "st", "der", "lo", "ing", "qua"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    secret = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    slug = lambda n: ("".join(rng.choice(words) for _ in range(n))[: n - 2]) + str(rng.randint(10, 99))
    # one secret by itself in its stratum
    found = []
    for i in range(4):
        rows = [(j, prose(200), "en", "a", 0) for j in range(60)] + [(1000, f"{prose(9)} {secret(base62, 45)} {prose(9)}", "en", "a", 0)]
        found += [r["n_random"] for r in secrets.secret_report(spark.createDataFrame(rows, SCHEMA)).where("doc_id = 1000").collect()]
    assert sum(found) >= 3, found
    # 950 worded tokens and 50 secrets of one stratum
    rows = [(i, f"{prose(30)} {slug(45)} {prose(30)}", "en", "a", 0) for i in range(950)] + [(1000 + i, f"{prose(30)} {secret(lower36, 45)} {prose(30)}", "en", "a", 0) for i in range(50)]
    n = {r["doc_id"]: r["n_random"] for r in secrets.secret_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    caught, wrong = sum(n[1000 + i] for i in range(50)), sum(n[i] for i in range(950))
    assert caught >= 45 and wrong <= 0.1 * (caught + wrong), (caught, wrong)


def test_many_secrets_in_one_text(spark):
    """Work in proportion to the matches: 100,000 in one text, in seconds."""
    import time

    one = "secret=abcdef12 "
    df = spark.createDataFrame([(1, one * 100_000, "en", "a", 0), (2, None, None, None, None)], SCHEMA)
    began = time.time()
    r = secrets.secret_report(df).where("doc_id = 1").first()
    assert r["n_assign"] == 100_000 and r["spans"].startswith("assign:0:15,assign:16:31,") and r["spans"].endswith(f",assign:{16 * 99_999}:{16 * 99_999 + 15}")
    clean = secrets.redact_secrets(df, "X").where("doc_id = 1").first()
    assert clean["text"] == "X " * 100_000 and clean["n_chars"] == 200_000
    assert time.time() - began < 90


def test_running_results_and_redaction_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(secrets, "BLOCK", 4)
    rng = random.Random(30)
    rows = []
    for i in range(200):
        t = "".join(rng.choice("abé😀") for _ in range(rng.randint(0, 60)))
        at, spans = 0, []
        while len(t) > at + 1 and rng.random() < 0.95:
            a = at + rng.randint(0, 2)
            b = min(len(t), a + rng.randint(1, 9))
            spans += [(a, b)] * (a < b)
            at = max(at, a) + rng.randint(0, 4)
        rows.append((i, t, spans, [rng.randint(0, 9) for _ in range(rng.randint(0, 30))]))
    df = spark.createDataFrame(rows, "i int, t string, s array<struct<start:int,end:int>>, v array<int>")
    got = df.select("i", secrets.redacted(F.col("t"), F.col("s"), "#").alias("r"), secrets.running(F.col("v"), lambda a, v: a + v, F.lit(0)).alias("sums")).collect()
    for r in got:
        _, t, spans, v = rows[r["i"]]
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += t[at:a] + "#"
            at = max(at, b)
        assert r["r"] == (out + t[at:] if spans else t), (t, spans)
        assert r["sums"] == [sum(v[: k + 1]) for k in range(len(v))]


def test_error_function(spark):
    import math

    z = [k / 50 for k in range(-200, 1200)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(secrets._erfc(F.col("z"))).collect()]
    assert max(abs(a / math.erfc(x) - 1) for a, x in zip(got, z, strict=True)) < 1e-7


def test_a_lone_token_needs_evidence(spark):
    """By itself in its stratum, a worded token is reported neither in a corpus of words nor in one without."""
    rng = random.Random(32)
    words = ["".join(rng.choice(["ba", "ne", "ri", "to", "sel", "mar"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    prose = [(i, " ".join(rng.choice(words) for _ in range(300)), "en", "a", 0) for i in range(40)]
    token = [(1000, "version1release-version1release", "en", "a", 0)]
    for rows in (token, [*prose, *token], [*prose, (1000, "banerito7selmarneri-tobane", "en", "a", 0)]):
        assert sum(r["n_random"] for r in secrets.secret_report(spark.createDataFrame(rows, SCHEMA)).collect()) == 0


def test_cuts_against_their_own_rule(spark):
    """The cut of each stratum is the lowest at which the tail's expected count is within the allowed share of the found."""
    import math

    rng = random.Random(31)
    words = ["".join(rng.choice(["ba", "ne", "ri", "to", "sel", "mar"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    texts = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(400)),) for _ in range(100)], "_t string")
    runs = secrets.word_runs(texts)
    pairs = secrets.letter_pairs(runs)
    scores = [(4 * len(secrets.BANDS) + 3, 0.5, rng.gauss(-20 if i % 4 else 20, 15)) for i in range(400)]
    cuts = secrets.fit_cuts(spark.createDataFrame(scores, "stratum int, p double, score double"), runs, pairs)
    (least, mean), = secrets.worded_tails(runs, pairs, [scores[0][0]]).values()
    expected = lambda c: secrets.TAIL * math.exp(-(c - least) / mean) * len(scores)
    allowed = [k for k in range(secrets.LEVELS + 1) if (n := sum(s >= least + k * mean / secrets.STEPS for *_, s in scores)) and expected(least + k * mean / secrets.STEPS) <= secrets.MAX_FALSE * n]
    assert abs(cuts[scores[0][0]] - (least + allowed[0] * mean / secrets.STEPS)) < 1e-9


def test_uniform_p_values_for_uniform_tokens(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("0123456789abcdef") for _ in range(22)), "en", "a", 0) for i in range(2000)]
    p = [k["p"] for r in spark.createDataFrame(rows, SCHEMA).select(secrets.findings(F.col("text")).alias("f")).collect() for k in r["f"]["tokens"]]
    assert abs(sum(x > 0.5 for x in p) / len(p) - 0.5) < 0.06
    assert sum(x < 0.05 for x in p) / len(p) < 0.09


def base_pii(t):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in m[0].split(".")))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and pii.passes_luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_personal_data_by_brute_force(spark, docs, wide, empty):
    rng = random.Random(5)
    for _ in range(20000):
        t = "".join(rng.choice("a1.@+- 09(:/25%İé4") for _ in range(rng.randint(0, 45)))
        assert base_pii(t) == [s for s in pii.find_personal_data(t) if s[1] < 4], t
    for t in ("0" * 5000 + ".1.1.1", "1.1.1." + "0" * 4301, "1.1.1." + "9" * 5000, "1.1." + "1" * 6000 + ".1", "+" + "1" * 5000, "4" * 5000):
        assert base_pii(t) == [s for s in pii.find_personal_data(t) if s[1] < 4]
    found = pii.personal_data(docs)
    assert found.count() == docs.count() and same(found, pii.personal_data(wide))
    assert pii.personal_data(empty).count() == 0


def test_added_kinds():
    t = "Account no: AB12345678, see https://example.org/~ann/x?y=1. IBAN: GB82 WEST 1234 5698 7654 32. Address: 12 High Street, Anytown 12345 http://example.org/plain accountable 12345678"
    got = {(pii.KINDS[k], t[a:b]) for a, k, b in pii.find_personal_data(t) if k >= 4}
    assert ("account", "AB12345678") in got and ("url", "https://example.org/~ann/x?y=1") in got and ("address", "12 High Street, Anytown 12345") in got
    assert not any(v.startswith("http://example.org/plain") for _, v in got)


def test_licenses(spark, docs, wide, empty):
    texts = {
        1: "Some prose here.\nLicensed under the Apache License, Version 2.0.\nMore prose.", 2: "Licensed under the Apache License, Version 3.0.", 3: "This work was licensed under the GNU General Public License, version 3.",
        4: "prose " * 200 + "Released under the MIT License. " + "prose " * 200, 5: "licensed plumbers wanted", 6: None, 7: "Licensed under CC BY-NC 4.0.", 8: "Licensed under CC BY-SA 4.0.",
    }
    got = {(r["doc_id"], r["license"], r["edits"]) for r in licenses.license_notices(spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts.items()], SCHEMA)).collect()}
    assert got == {(1, "Apache-2.0", 0), (3, "GPL-3.0", 1), (4, "MIT", 0), (7, "CC-BY-NC-4.0", 0), (8, "CC-BY-SA-4.0", 0)}
    assert same(licenses.license_notices(docs), licenses.license_notices(wide))
    assert licenses.license_notices(empty).count() == 0


def test_licenses_inside_prose(spark):
    rng = random.Random(16)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))
    notices = [(name, notice) for name, all_of in licenses.TEMPLATES.items() for notice in all_of]
    texts, want = [], set()
    for name, notice in notices:
        for kind, text in (("line", notice), ("wrapped", notice.replace(" ", "\r\n", 3))):
            want.add((len(texts), name))
            texts.append(f"{prose(45)} {text} {prose(45)}" if kind == "line" else f"{prose(800)}\r\n{text}\r\n{prose(45)}")
    # two notices and a long list of authors in one line
    mit = dict(licenses.TEMPLATES)["MIT"][1]
    want |= {(len(texts), "MIT"), (len(texts), "All-rights-reserved")}
    texts.append(f"Copyright (c) {prose(25)} {mit} {prose(5)} All rights reserved. {prose(90)}")
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    assert {(r["doc_id"], r["license"]) for r in licenses.license_notices(df).collect()} == want


def brute_edits(want, have):
    """Least edits between all of `want` and a stretch of `have`."""
    row = [0] * (len(have) + 1)
    for i, x in enumerate(want, 1):
        last, row = row, [i]
        for j, y in enumerate(have, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row)


def test_license_candidates_and_ranking_by_brute_force(spark):
    """Edited copies of random templates: every template within its edits is a candidate; the winner is the closest of alike ones."""
    from tallyloom.llm.words import words

    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(4, 9))) for _ in range(400)]  # no strict words among them
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base = say(60)
    templates = {"base": base, "longer": base[:40] + say(12) + base[40:], "short": say(5), "tiny": say(3), "other": say(25)}
    matcher = licenses.Matcher({k: [" ".join(v)] for k, v in templates.items()})
    texts, want = [], []
    for i in range(160):
        name = rng.choice(list(templates))
        copy = []
        for x in templates[name]:
            u, share = rng.random(), rng.choice([0.0, 0.05, 0.1])
            copy += [] if u < share / 3 else [x, rng.choice(vocabulary)] if u < 2 * share / 3 else [rng.choice(vocabulary)] if u < share else [x]
        texts.append([*say(rng.randint(0, 50)), *copy, *say(rng.randint(0, 50))])
        want.append(name)
    w = words([" ".join(t).encode() for t in texts], licenses._TABLE)
    found = {i: [matcher.templates[k].name for _, k, *_ in ranked] for i, ranked in matcher.candidates(w)}
    for i, t in enumerate(texts):
        for k, m in enumerate(matcher.templates):
            least = brute_edits([x.decode() for x in m.words], t)
            assert licenses.align(m.hashes, w.hashes[w.first[i] : w.first[i + 1]])[0] == least
            assert least > m.edits or m.name in found[i], (i, m.name, least)
    got = {}
    for i, name, *_ in matcher.notices(w):
        got.setdefault(i, []).append(name)
    near = [i for i, t in enumerate(texts) if brute_edits(templates[want[i]], t) <= licenses.MAX_EDITS * len(templates[want[i]])]
    assert len(near) > 120 and all(want[i] in got[i] for i in near)
    assert not any("base" in got[i] for i in near if want[i] == "longer") and not any("longer" in got[i] for i in near if want[i] == "base")


def test_whole_licenses_long_lines_and_denials(spark):
    rng = random.Random(18)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))
    t = licenses.TEMPLATES
    long = prose(560)
    cases = [
        (f"{prose(30)} {t['BSD-2-Clause'][0]} {prose(30)}", ["BSD-2-Clause"]), (f"{prose(30)} {t['BSD-3-Clause'][0]} {prose(30)}", ["BSD-3-Clause"]),
        (f"{t['MIT'][2]}", ["MIT"]), (f"{t['GPL-2.0-or-later'][0]}", ["GPL-2.0-or-later"]), (f"{t['GPL-3.0-or-later'][0]}", ["GPL-3.0-or-later"]), (f"{t['AGPL-3.0-or-later'][0]}", ["AGPL-3.0-or-later"]),
        ("Not all rights reserved.", []), ("This file is no longer subject to the terms of the Mozilla Public License, v. 2.0.", []), ("This Source Code Form is no longer subject to the terms of the Mozilla Public License, v. 2.0.", []),
        (f"{prose(300)} {t['ISC'][0]} {prose(900)}".replace("\n", " "), ["ISC"]), ("All rights reserved. " * 3000, ["All-rights-reserved"] * 3000),
        (f"{prose(20)} {long} {prose(20)}", ["long"]),
    ]
    df = spark.createDataFrame([(i, x, "en", "a", 0) for i, (x, _) in enumerate(cases)], SCHEMA)
    got = {}
    for r in licenses.license_notices(df, {**t, "long": [long]}).collect():
        got.setdefault(r["doc_id"], []).append(r["license"])
        assert cases[r["doc_id"]][0][r["start"] : r["end"]] == r["notice"]
    assert {i: sorted(got.get(i, [])) for i in range(len(cases))} == {i: want for i, (_, want) in enumerate(cases)}


def counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(marked)


def test_quality_counts_by_brute_force(spark, docs, wide, empty):
    rng = random.Random(11)
    texts = ["".join(rng.choice(["a ", "b ", "é", "\n", "#", " ", "\x0b", "\x1c", "a b c d e f g h ", " "]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    for r in quality.quality_report(df).collect():
        want = counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, texts[r["doc_id"]]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    report = quality.quality_report(docs).drop("distance")
    assert report.count() == docs.count() and same(report, quality.quality_report(wide).drop("distance"))
    assert quality.quality_report(empty).count() == 0
    kept = quality.keep_quality(wide)
    assert kept.columns == wide.columns and kept.count() == report.where("kept").count()


def test_outliers_go_and_ordinary_texts_stay(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(25, 300))), "en", "a", 0) for i in range(300)]
    rows += [(1000 + i, " ".join(word() + "###" for _ in range(100)), "en", "a", 0) for i in range(60)]
    rows += [(2000 + i, " ".join(word().upper() for _ in range(100)), "en", "a", 0) for i in range(30)]
    rows += [(3000 + i, " ".join(f"{w} {w} {w} {w}" for w in (word() for _ in range(25))), "en", "a", 0) for i in range(5)]
    kept = {r["doc_id"] for r in quality.quality_report(spark.createDataFrame(rows, SCHEMA)).where("kept").collect()}
    assert kept == set(range(300))


def numpy_mcd(x, floor, starts=60, seed=0):
    """The smallest determinant, and its centre, over concentration steps from random subsets; pivots are not below `floor`."""
    import numpy as np

    rng, p, h = np.random.default_rng(seed), x.shape[1], int(quality.SUBSET * len(x))

    def factor(c):
        c, pivots, factors = c.copy(), [], np.eye(p)
        for k in range(p):
            pivots.append(max(c[k, k], floor[k]))
            factors[k, k + 1 :] = c[k, k + 1 :] / pivots[k]
            c[k + 1 :, k + 1 :] -= np.outer(factors[k, k + 1 :], c[k, k + 1 :])
        return np.array(pivots), factors

    best = (np.inf, None)
    for _ in range(starts):
        s = rng.choice(len(x), p + 1, replace=False)
        last = np.inf
        while True:
            m = x[s].mean(0)
            pivots, factors = factor(np.cov(x[s].T, bias=True) * quality.CONSISTENCY)
            d = (np.linalg.solve(factors.T, (x - m).T).T ** 2 / pivots).sum(1)
            s, now = np.argsort(d)[:h], np.log(pivots).sum()
            if len(s) == h and now >= last - 1e-9:
                break
            last = now if last < np.inf else 1e300
        best = min(best, (last, m), key=lambda b: b[0])
    return best


def as_points(spark, x, size, group="g"):
    names = [f"_x{k}" for k in range(quality.P)] + [f"_v_{n}" for n in quality.SIZES]
    rows = [(group, *map(float, r), *([float(size)] * len(quality.SIZES))) for r in x]
    return spark.createDataFrame(rows, "_group string, " + ", ".join(f"{n} double" for n in names))


def test_fit_finds_the_smallest_determinant(spark):
    """Against FAST-MCD in NumPy: a fifth of the points are far outliers in one direction, and one axis has no scatter."""
    import numpy as np

    rng = np.random.default_rng(3)
    a = rng.normal(size=(quality.P, quality.P)) * 0.1
    x = rng.normal(size=(1000, quality.P)) @ a.T + 0.5
    x[:, 3] = 0.0
    x[:200] += np.array([1.5, 1.0, -1.0, 0.0, 1.0, 0.5])
    size = 400
    want, centre = numpy_mcd(x, [v / size for _, v, _ in quality.AXES])
    got = quality.fit(as_points(spark, x, size)).first()
    typical = 2.0 ** (round(np.log2(size) * 16) / 16)
    assert abs(got["_typical_n_words"] - typical) < 1e-9
    assert got["_logdet"] <= want + 0.15, (got["_logdet"], want)
    assert np.abs(np.array([got[f"_m{k}"] for k in range(quality.P)]) - centre).max() < 0.03


def test_distances_are_chi_squared_for_normal_points(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    a = rng.normal(size=(quality.P, quality.P)) + 2 * np.eye(quality.P)
    x = rng.normal(size=(4000, quality.P)) @ a.T
    points = as_points(spark, x, 1e6)
    model = quality.fit(points)
    d = sorted(r[0] for r in quality.with_distance(points.join(model, "_group"), [F.col(f"_x{k}") - F.col(f"_m{k}") for k in range(quality.P)]).select("_distance").collect())
    assert abs(d[2000] / quality.chi_squared_quantile(0.5, quality.P) - 1) < 0.08 and abs(d[3600] / quality.chi_squared_quantile(0.9, quality.P) - 1) < 0.08


def test_small_groups_are_pooled(spark):
    rows = [("en", "a")] * 250 + [("en", f"s{i}") for i in range(210)] + [("fr", "b")] * 150 + [("de", "c")] * 3
    df = spark.createDataFrame([(*r, False) for r in rows], "_lang string, _source string, _failed boolean")
    got = {(r["_lang"], r["_source"]): r["_group"] for r in quality.groups(df).collect()}
    assert got["en", "a"] == '["en","a"]' and got["en", "s5"] == '["en"]' and got["fr", "b"] == got["de", "c"] == "[]"


def test_language_mixtures(spark, docs, wide, empty):
    rng = random.Random(4)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, text("abcde", 80), "xx", None, 0) for i in range(60)] + [(100 + i, text("vwxyz", 80), "yy", None, 0) for i in range(60)]
    langs, model = language.train(spark.createDataFrame(rows, SCHEMA))
    assert langs == ["xx", "yy"]
    test = [(1, text("abcde", 50), None, None, 0), (2, text("abcde", 70) + " " + text("vwxyz", 30), None, None, 0), (3, "12 !?", None, None, 0), (4, None, None, None, 0), (None, text("vwxyz", 3), None, None, 0)]
    got = {r["doc_id"]: r for r in language.detect(spark.createDataFrame(test, SCHEMA), langs, model).collect()}
    assert (got[1]["lang_pred"], got[1]["languages"], round(got[1]["score"], 2)) == ("xx", ["xx"], 1.0)
    assert got[2]["languages"] == ["xx", "yy"] and abs(got[2]["score"] - 0.7) < 0.06
    assert (got[3]["lang_pred"], got[3]["score"]) == ("und", 0.0) == (got[4]["lang_pred"], got[4]["score"])
    assert got[None]["lang_pred"] == "yy"
    assert language.detect(docs, langs, model).count() == docs.count() and same(language.detect(docs, langs, model), language.detect(wide, langs, model))
    assert language.detect(empty, langs, model).count() == 0 and language.train(empty)[0] == []
    assert all(r["lang_pred"] == "und" for r in language.detect(docs, [], language.train(empty)[1]).collect())


def test_three_hundred_languages_and_no_letters(spark):
    rng = random.Random(14)
    letters = [chr(0x4E00 + i) for i in range(1500)]
    rows = [(i, " ".join("".join(rng.choice(letters[5 * (i % 300) : 5 * (i % 300) + 5]) for _ in range(5)) for _ in range(30)), f"l{i % 300:03}", None, 0) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    langs, model = language.train(df)
    assert len(langs) == 300 and len(model) == 10
    got = {r["doc_id"]: r["lang_pred"] for r in language.detect(df, langs, model).collect()}
    assert got == {i: f"l{i % 300:03}" for i in range(600)}
    flags = [(1, "\U0001f3f4\U000e0067\U000e0062\U000e007f", None, None, 0), (2, "\U000f0000 \U00100000", None, None, 0), (3, "\U00020000\U00020001", None, None, 0)]
    assert [r["lang_pred"] != "und" for r in language.detect(spark.createDataFrame(flags, SCHEMA), langs, model).orderBy("doc_id").collect()] == [False, False, True]


def test_mixture_proportions_maximise_the_likelihood():
    """Expectation-maximisation against a grid over all proportions of two languages."""
    import numpy as np

    rng = np.random.default_rng(5)
    p, weight = rng.random((50, 2)) / 20, rng.integers(1, 9, 50).astype(float)
    share, likelihood = language.proportions(p, weight, 2000)
    grid = [float(weight @ np.log(p @ np.array([x, 1 - x]))) for x in np.linspace(0, 1, 2001)]
    assert likelihood >= max(grid) - 0.05 and abs(share[0] - np.argmax(grid) / 2000) < 0.05


def test_language_held_out(spark):
    """The registered query's accuracy on the held-out fifth of the driver's smallest table."""
    import os

    import pytest

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no driver tables")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = language.op10_language_mixture(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id").where("lang is not null and lang_pred <> 'und'")
    right, n = held.where("lang = lang_pred").count(), held.count()
    assert n > 100 and right >= 0.97 * n, (right, n)
