"""Secret scans in DataFrame expressions only: fixed patterns, and a battery of randomness tests on opaque tokens.

The patterns (kinds assign, access, hex) give spans by themselves. Beside them, each run of 20 or more letters, digits
and +/_- with a letter and a digit is a token; the smallest alphabet that holds it is its inferred encoding. Under the
hypothesis of uniform independent draws from that alphabet, three tests give p-values: chi-squared on the letter
counts, the runs test above and below the alphabet's middle, and the lag-1 serial correlation of the letters' places.
Fisher's method combines them.

The tests alone can't tell short random tokens from words, so a token also has a score against words: the logarithm of
its p-value, less the log-likelihood ratio of its letter pairs under the corpus's own words and under uniform letters.
What is tested is that a token is worded. The null distribution of the score is learnt, for each encoding and length
band, from tokens put together from the corpus's words: every run of RUN_WORDS words of all texts makes one token, for
a band that its hash picks, and equal tokens count once. The upper tail is taken as exponential, its mean raised by two standard errors, so a
thin tail makes the test stricter. A band of fewer than LEAST_NULL such tokens takes the tail of the next shorter band of
its encoding that has enough (longer worded tokens score lower), or else the highest of all tails. All tokens that Benjamini-Hochberg
rejects at MAX_FALSE within their encoding and band become spans of kind random, unless randomness itself is rejected
(p below MIN_P) or one of the patterns' matches covers part of them.

Work on one text is in proportion to its length and its matches: running sums go by blocks (`running`).
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .op8_quality import let, once
from .shared import materialise, passing, table

PATTERNS = {
    "assign": r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
KINDS = [*PATTERNS, "random"]
MIN_VALUE = 6
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: inferred encodings, smallest first: name, alphabet
ENCODINGS = [
    ("hex_lower", DIGITS + "abcdef"),
    ("hex_upper", DIGITS + "ABCDEF"),
    ("base32", UPPER + "234567"),
    ("upper36", UPPER + DIGITS),
    ("lower36", LOWER + DIGITS),
    ("base62", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
    ("any66", UPPER + LOWER + DIGITS + "+/-_"),
]
BANDS = (20, 24, 28, 32, 40, 48, 64, 128)
MAX_FALSE = 0.05
MIN_P = 0.01
RUN_WORDS = 64  # words of a text that one token of known words is made of
LEAST_NULL = 40
TAIL = 0.05  # the upper share of the worded scores to which an exponential tail is fitted
STEPS, LEVELS = 4, 400  # levels of the tail probability in each power of e, and in all
BLOCK = 256  # of a running sum
_SPAN = "array<struct<start:int,end:int>>"


def running(values: Column, combine, start: Column) -> Column:
    """Running results over an array of ints, up to and with each element.

    Arrays grow by copying, so elements are combined within blocks, then the blocks' last results, then both.
    """

    def alone(x: Column) -> Column:
        empty = F.array().cast("array<int>")
        return F.aggregate(x, empty, lambda a, v: F.concat(a, F.array(combine(F.coalesce(F.get(a, F.size(a) - 1), start), v))))

    def together(parts: Column) -> Column:
        lasts = alone(F.transform(parts, lambda p: F.coalesce(F.get(p, F.size(p) - 1), start)))
        return let(lasts, lambda c: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda v: combine(F.get(c, i - 1), v))))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda i: alone(F.slice(values, i * BLOCK + 1, F.lit(BLOCK))))
    return F.when(F.size(values) <= BLOCK, alone(values)).otherwise(let(blocks, together))


def _ends(pieces: Column, matches: Column) -> Column:
    """Where each match ends: the running sum of the lengths of the matches and of the pieces before them."""
    return let(F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m)), lambda x: running(x, lambda a, v: a + v, F.lit(0)))


def _places(text: Column, pattern: str, matches: Column) -> Column:
    """Spans of all matches of a pattern."""
    return F.zip_with(_ends(F.split(text, pattern, -1), matches), matches, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end")))


def _spans(text: Column, kind: str) -> Column:
    pattern = PATTERNS[kind]
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: _places(text, pattern, m))
    if kind == "assign":
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        found = let(values, lambda v: let(found, lambda f: F.filter(f, lambda s, i: F.length(F.get(v, i)) >= MIN_VALUE)))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _fit_erfc(degree: int = 10, scale: float = 0.4) -> tuple[float, list[float]]:
    """A polynomial in t = 1 / (1 + scale z) for ln erfc(z) + z^2 - ln t, fitted to math.erfc at Chebyshev points."""
    t = 0.5 * (1.0 + np.cos(np.pi * (np.arange(400) + 0.5) / 400))
    t = t[t > 1.0 / (1.0 + 25.0 * scale)]
    z = (1.0 / t - 1.0) / scale
    y = [math.log(math.erfc(x)) + x * x - math.log(u) for x, u in zip(z, t, strict=True)]
    return scale, np.polynomial.polynomial.polyfit(t, y, degree).tolist()


_ERFC_SCALE, _ERFC = _fit_erfc()


def _erfc(z: Column) -> Column:
    """Complementary error function, relative error below 1e-7."""

    def tail(a: Column) -> Column:
        return let(1.0 / (1.0 + _ERFC_SCALE * a), lambda t: t * F.exp(-a * a + reduce(lambda acc, c: acc * t + c, reversed(_ERFC[:-1]), F.lit(_ERFC[-1]))))

    return let(z, lambda v: let(tail(F.abs(v)), lambda x: F.when(v >= 0, x).otherwise(2.0 - x)))


def _p_values(token: Column, alphabet: Column) -> Column:
    """The combined p-value of the three tests for one token over its alphabet."""
    size = F.length(alphabet).cast("double")
    n = F.length(token).cast("double")
    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda a, c: a + F.pow((F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double"), 2.0))
    statistic = squares * size / n - n
    freedom = (size - 1.0) / (1.0 - 1.0 / n)  # matches the statistic's exact mean and variance
    part = 2.0 / (9.0 * freedom)
    cube = (F.pow(F.greatest(statistic / (size - 1.0), F.lit(1e-9)), 1.0 / 3.0) - (1.0 - part)) / F.sqrt(part)
    uniform = 0.5 * _erfc(cube / 2.0**0.5)

    def runs(x: Column) -> Column:
        above = F.transform(x, lambda v: v >= size / 2.0)
        n1 = F.size(F.filter(above, lambda b: b)).cast("double")
        n0 = n - n1
        r = F.size(F.filter(above, lambda b, i: (i == 0) | (F.get(above, i - 1) != b))).cast("double")
        expected = 2.0 * n1 * n0 / n + 1.0
        variance = (expected - 1.0) * (expected - 2.0) / (n - 1.0)
        return F.when(variance > 0, _erfc(F.abs(r - expected) / F.sqrt(2.0 * variance))).otherwise(F.lit(1.0))

    def serial(x: Column) -> Column:
        middle, spread = (size - 1.0) / 2.0, (size * size - 1.0) / 12.0
        total = F.aggregate(F.transform(x, lambda v, i: F.when(i > 0, (v - middle) * (F.get(x, i - 1) - middle)).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)
        return _erfc(F.abs(total / spread) / F.sqrt(2.0 * (n - 1.0)))

    places = F.transform(F.split(token, ""), lambda c: F.position(c, alphabet).cast("double") - 1.0)
    minus_logs = let(places, lambda x: -(F.log(F.greatest(uniform, F.lit(1e-300))) + F.log(F.greatest(runs(x), F.lit(1e-300))) + F.log(F.greatest(serial(x), F.lit(1e-300)))))
    return let(minus_logs, lambda s: F.exp(-s) * (1.0 + s + s * s / 2.0))  # chi-squared with 6 d.f. at 2 s


def _score(token: Column, p: Column, pairs: list[float]) -> Column:
    """How little a token looks like words: ln p less the log-likelihood ratio of its pairs of letters."""
    if not pairs:
        return F.log(F.greatest(p, F.lit(1e-300)))
    table = F.array(*(F.lit(float(x)) for x in pairs))
    places = F.transform(F.split(F.lower(token), ""), lambda c: F.ascii(c) - ord("a"))
    letter = lambda v: (v >= 0) & (v < 26)
    ratio = let(places, lambda x: F.aggregate(F.transform(x, lambda v, i: F.when((i > 0) & letter(v) & letter(F.get(x, i - 1)), F.get(table, F.get(x, i - 1) * 26 + v)).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, v: a + v))
    return F.log(F.greatest(p, F.lit(1e-300))) - ratio


def _tokens(text: Column, pairs: list[float]) -> Column:
    """The tokens that no pattern's match covers part of, with an inferred encoding: start, end, stratum, p, score.

    Tokens are whole runs of their letters, so a match of access or hex inside one shows in it alone. For assign, the
    tokens are those of the pieces between its matches; a run at the end of a piece goes on into the match, and is left out.
    """

    def tested(place: Column, word: Column) -> Column:
        n = F.length(word)
        which = reduce(lambda rest, k: F.when(word.rlike("^[" + ENCODINGS[k][1].replace("-", r"\-") + "]+$"), F.lit(k)).otherwise(rest), reversed(range(len(ENCODINGS))), F.lit(len(ENCODINGS) - 1))
        band = reduce(lambda rest, k: F.when(n >= BANDS[k], F.lit(k)).otherwise(rest), range(1, len(BANDS)), F.lit(0))
        alphabets = F.array(*(F.lit(a) for _, a in ENCODINGS))

        def judged(w: Column) -> Column:
            return let(_p_values(word, F.get(alphabets, w)), lambda p: F.struct(place["start"].alias("start"), place["end"].alias("end"), (w * len(BANDS) + band).alias("stratum"), p.alias("p"), _score(word, p, pairs).alias("score")))

        return let(which, judged)

    def opaque(piece: Column, words: Column) -> Column:
        both = F.zip_with(_places(piece, TOKEN, words), words, lambda s, w: F.struct(s.alias("s"), w.alias("w")))
        return F.filter(both, lambda x: x["w"].rlike("[0-9]") & x["w"].rlike("[A-Za-z]") & ~x["w"].rlike(PATTERNS["access"]) & ~x["w"].rlike(PATTERNS["hex"]))

    def of(piece: Column) -> Column:
        return let(F.regexp_extract_all(piece, F.lit(TOKEN), F.lit(0)), lambda words: opaque(piece, words))

    def between(pieces: Column, ends: Column) -> Column:
        def moved(piece: Column, i: Column) -> Column:
            start = F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
            free = F.filter(of(piece), lambda x: (i == F.size(pieces) - 1) | (x["s"]["end"] < F.length(piece)))
            return F.transform(free, lambda x: F.struct(F.struct((x["s"]["start"] + start).alias("start"), (x["s"]["end"] + start).alias("end")).alias("s"), x["w"].alias("w")))

        return F.flatten(F.transform(pieces, lambda piece, i: F.when(piece.rlike(_MIXED), moved(piece, i)).otherwise(F.array().cast("array<struct<s:struct<start:int,end:int>,w:string>>"))))

    assigns = let(F.split(text, PATTERNS["assign"], -1), lambda pieces: let(_ends(pieces, F.regexp_extract_all(text, F.lit(PATTERNS["assign"]), F.lit(0))), lambda ends: between(pieces, ends)))
    found = F.when(text.rlike(PATTERNS["assign"]), assigns).otherwise(of(text))
    return F.when(text.rlike(_MIXED), let(found, lambda f: F.transform(f, lambda x: tested(x["s"], x["w"])))).otherwise(F.array().cast("array<struct<start:int,end:int,stratum:int,p:double,score:double>>"))


_MIXED = r"(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20}"


def findings(text: Column, pairs: list[float] = ()) -> Column:
    """A struct of the pattern spans by kind and the tested tokens of a text (null: empty); pairs: see letter_pairs."""
    return let(F.coalesce(text, F.lit("")), lambda t: F.struct(*(_spans(t, k).alias(k) for k in PATTERNS), _tokens(t, pairs).alias("tokens")))


def word_runs(texts: DataFrame) -> DataFrame:
    """w: the runs of RUN_WORDS words, in order, of a column _t; a text's last run may be shorter. Opaque tokens give no words."""
    words = F.regexp_extract_all(F.regexp_replace("_t", TOKEN, " "), F.lit("[A-Za-z]{2,19}"), F.lit(0))
    runs = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / RUN_WORDS).cast("int")), lambda i: F.array_join(F.slice(w, i * RUN_WORDS + 1, F.lit(RUN_WORDS)), " ")))
    return materialise(texts.where(F.length("_t") > 0).select(F.explode(runs).alias("r")).where(F.length("r") > 0).select(F.split("r", " ").alias("w")), "words")


def letter_pairs(words: DataFrame) -> list[float]:
    """For each letter and the next, at 26 * first + second: the log of the pair's likelihood in words over that of uniform letters. Empty without words."""
    x = words.select(F.explode(F.transform("w", lambda x: F.lower(x))).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    pair = x.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("x") - 1), lambda i: F.substring(F.col("x"), i, F.lit(2)))).alias("pair"))
    n = {r["pair"]: r["n"] for r in pair.groupBy("pair").agg(F.sum("n").alias("n")).collect()}  # at most 26 x 26 rows
    if not n:
        return []
    total = {a: sum(n.get(a + b, 0) for b in LOWER) for a in LOWER}
    return [math.log(26.0 * (n.get(a + b, 0) + 1.0) / (total[a] + 26.0)) for a in LOWER for b in LOWER]


def worded_tokens(words: DataFrame, pairs: list[float], strata: list[int]) -> DataFrame:
    """stratum, score of tokens made of word_runs, one of each run: of the encoding and the band's least length of the stratum that its hash picks."""
    picked = F.get(F.array(*map(F.lit, strata)), F.pmod(F.xxhash64("w"), F.lit(len(strata))).cast("int"))
    chosen = words.withColumn("stratum", picked)

    def made(stratum: int) -> Column:
        name, alphabet = ENCODINGS[stratum // len(BANDS)]
        joined = F.array_join("w", {"base64": "/", "base64url": "-", "any66": "-"}.get(name, " "))
        if name == "any66":
            joined = F.concat(F.get("w", F.lit(0)), F.lit("/"), joined)
        cased = F.upper(joined) if LOWER[-1] not in alphabet and name != "hex_lower" else F.initcap(joined) if name == "base62" else F.lower(joined)
        # letters only, then two digits
        body = F.substring(F.regexp_replace(cased, "[^" + alphabet.replace("-", r"\-") + "]", ""), 1, BANDS[stratum % len(BANDS)] - 2)
        digits = F.lpad(F.pmod(F.xxhash64("w", F.lit(1)), F.lit(100)).cast("string"), 2, "0")
        return F.concat(body, F.translate(digits, "0189", "2345") if name == "base32" else digits)

    of = lambda value: reduce(lambda rest, k: F.when(F.col("stratum") == k, value(k)).otherwise(rest), strata, F.lit(None))
    tokens = chosen.select("stratum", of(made).alias("token"), of(lambda k: F.lit(ENCODINGS[k // len(BANDS)][1])).alias("alphabet"), of(lambda k: F.lit(BANDS[k % len(BANDS)])).alias("n")).where(F.length("token") == F.col("n")).distinct()
    return tokens.select("stratum", let(F.col("token"), lambda t: _score(t, _p_values(t, F.col("alphabet")), pairs)).alias("score"))


def worded_tails(words: DataFrame, pairs: list[float], strata: list[int]) -> dict[int, tuple[float, float]]:
    """For each stratum the score that the share TAIL of worded tokens exceeds, and a bound of how much on average."""
    known = materialise(worded_tokens(words, pairs, strata), "worded")
    top = known.groupBy("stratum").agg(F.percentile_approx("score", 1.0 - TAIL, 10000).alias("least"), F.count(F.lit(1)).alias("n"))
    over = F.when(F.col("score") > F.col("least"), F.col("score") - F.col("least"))
    excess = known.join(top, "stratum").groupBy("stratum", "least", "n").agg(F.avg(over).alias("mean"), F.count(over).alias("k"))
    rows = {r["stratum"]: r for r in excess.collect()}  # at most one row for each stratum
    own = {k: (r["least"], (r["mean"] or 1.0) * (1.0 + 2.0 / math.sqrt(max(1, r["k"])))) for k, r in rows.items() if r["n"] >= LEAST_NULL}
    most = max(own.values(), default=None)
    out = {}
    for k in strata:
        shorter = [j for j in own if j // len(BANDS) == k // len(BANDS) and j <= k]
        if shorter or most:
            out[k] = own[max(shorter)] if shorter else most
    return out


def fit_cuts(tokens: DataFrame, words: DataFrame, pairs: list[float], max_false: float = MAX_FALSE) -> dict[int, float]:
    """The least score of each encoding and length band that is reported; tokens: all of stratum, p, score, at most 72 strata.

    A corpus with fewer than LEAST_NULL worded tokens for every stratum has none to test against; there the battery alone
    decides, and what MIN_P leaves is reported. Strata where nothing is rejected have no cut, and report nothing.
    """
    tokens = materialise(tokens, "opaque")
    total = {r["stratum"]: r["n"] for r in tokens.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    tails = worded_tails(words, pairs, sorted(total)) if total else {}
    if not tails:
        return dict.fromkeys(total, -1e300)
    cuts: dict[int, float] = {}
    by = lambda i: F.create_map(*(F.lit(x) for k, v in tails.items() for x in (k, float(v[i]))))
    level = F.least(F.floor((F.col("score") - F.try_element_at(by(0), F.col("stratum"))) / F.try_element_at(by(1), F.col("stratum")) * STEPS), F.lit(LEVELS)).cast("int")
    counted: dict[int, dict[int, int]] = {}
    for r in tokens.where(F.col("p") >= MIN_P).select("stratum", level.alias("level")).where("level >= 0").groupBy("stratum", "level").agg(F.count(F.lit(1)).alias("n")).collect():  # at most strata x (LEVELS + 1) rows
        counted.setdefault(r["stratum"], {})[r["level"]] = r["n"]
    for stratum, n in counted.items():
        least, mean = tails[stratum]
        for k in range(LEVELS + 1):
            above = sum(v for x, v in n.items() if x >= k)
            if above and TAIL * math.exp(-k / STEPS) * total[stratum] <= max_false * above:
                cuts[stratum] = least + k * mean / STEPS
                break
    return cuts


def all_spans(found: Column, cuts: dict[int, float]) -> Column:
    """An array of (start, kind's number, end) in order: the patterns' spans and the random tokens."""
    numbered = lambda i: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"))
    base = F.concat(*(F.transform(found[k], numbered(i)) for i, k in enumerate(PATTERNS)))
    limits = F.create_map(*(F.lit(x) for kv in sorted(cuts.items()) for x in kv)) if cuts else F.lit(None).cast(T.MapType(T.IntegerType(), T.DoubleType()))

    random = F.filter(found["tokens"], lambda t: (t["p"] >= MIN_P) & F.coalesce(t["score"] >= F.try_element_at(limits, t["stratum"]), F.lit(False)))
    return F.array_sort(F.concat(base, F.transform(random, lambda t: F.struct(t["start"].alias("start"), F.lit(len(PATTERNS)).alias("kind"), t["end"].alias("end")))))


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_false: float = MAX_FALSE) -> DataFrame:
    """Secrets of all rows: the id, an array `found` of (start, kind, end), n_assign, n_access, n_hex, n_random, base_sha256, spans.

    A null or empty text has none (the SHA-256 is that of the empty string); null ids and repeated rows are kept, each
    row reported by itself; an empty table gives an empty result; other columns aren't read.
    """
    with passing(df.sparkSession):
        words = word_runs(df.select(F.col(text_col).alias("_t")))
        pairs = letter_pairs(words)
        kept = materialise(df.select(F.col(id_col).alias("_id"), findings(F.col(text_col), pairs).alias("_f")), "secrets", keep=True)
        cuts = fit_cuts(_exploded(kept), words, pairs, max_false)
    spans = kept.withColumn("_s", all_spans(F.col("_f"), cuts))
    number = lambda i: F.size(F.filter("_s", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("_s", lambda s: s["kind"] < len(PATTERNS))
    return spans.select(
        F.col("_id").alias(id_col),
        F.transform("_s", lambda s: F.struct(s["start"].alias("start"), F.get(F.array(*(F.lit(k) for k in KINDS)), s["kind"]).alias("kind"), s["end"].alias("end"))).alias("found"),
        *(number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col("_s")).alias("spans"),
    )


def _exploded(found: DataFrame) -> DataFrame:
    return found.select(F.explode("_f.tokens").alias("k")).select("k.stratum", "k.p", "k.score")


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark for each span (start, end; in order of start); spans that overlap get one mark together.

    The text is cut into stretches of BLOCK marks first, and each stretch is gone through by itself.
    """
    upto = running(F.transform(spans, lambda s: s["end"]), lambda a, v: F.greatest(a, v), F.lit(0))

    def stretch(gaps: Column) -> Column:
        first = F.get(gaps, F.lit(0))["from"]
        piece = F.substring(text, first + 1, F.get(gaps, F.size(gaps) - 1)["to"] - first)
        return let(piece, lambda x: F.array_join(F.transform(gaps, lambda g: F.concat(F.substring(x, g["from"] - first + 1, g["to"] - g["from"]), F.lit(mark))), ""))

    def joined(last: Column, gaps: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(gaps) - 1) / BLOCK).cast("int")), lambda i: let(F.slice(gaps, i * BLOCK + 1, F.lit(BLOCK)), stretch))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.get(last, F.size(last) - 1) + 1, F.length(text)))

    def gaps(ends: Column) -> Column:
        before = F.transform(spans, lambda s, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1)).alias("from"), s["start"].alias("to")))
        return let(F.filter(before, lambda g: g["to"] >= g["from"]), lambda g: joined(ends, g))

    return F.when(F.size(spans) > 0, let(upto, gaps)).otherwise(text)


def redact_secrets(df: DataFrame, mark: str = "[SECRET]", max_false: float = MAX_FALSE) -> DataFrame:
    """df with every secret in `text` replaced by a mark and n_chars set anew where that changed the text.

    All rows stay, null and empty texts as they are; repeated rows are changed alike; an empty table gives an empty one.
    Findings are computed twice, for the cuts and for the marks: a copy of the texts would take more disk than the input.
    """
    rows = df.select(F.struct("*").alias("_row"), F.col("text").alias("_t"))
    with passing(df.sparkSession):
        words = word_runs(rows.select("_t"))
        pairs = letter_pairs(words)
        found = rows.select(once(findings(F.col("_t"), pairs)).alias("_f")).select(F.struct("_f.tokens").alias("_f")).where(F.size("_f.tokens") > 0)
        cuts = fit_cuts(_exploded(found), words, pairs, max_false)
    spans = rows.withColumn("_f", once(findings(F.col("_t"), pairs))).withColumn("_s", once(all_spans(F.col("_f"), cuts)))
    out = spans.withColumn("_clean", redacted(F.col("_t"), F.col("_s"), mark))
    changed = {"text": F.col("_clean"), "n_chars": F.when(F.size("_s") > 0, F.length("_clean").cast("long")).otherwise(F.col("_row.n_chars"))}
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"_row.`{c}`") for c in df.columns))


def op2_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = secret_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")
