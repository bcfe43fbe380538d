"""Quality rules with robust multivariate outliers, in DataFrame expressions only.

Every text gets counts (words, symbols, repeated lines, words inside repeated 8-word windows, words equal to the one
before, upper-case letters). Texts that pass the plain rules become points of six transformed statistics, and the minimum
covariance determinant estimate of centre and scatter is found for each language and source: from three starts,
concentration steps (take the 75 % of points nearest by Mahalanobis distance, re-estimate from them) go on until the
determinant stops falling, and the start with the smallest determinant wins. A step is one grouped sum over the narrow
table of points: moments are summed per group and bin of the distance, so the nearest 75 % are a running sum over a
group's bins, and no task sees a group's points together. Points whose squared distance exceeds a chi-squared quantile are rejected.

A statistic that is zero in most texts has no scatter. Where a pivot of the scatter matrix falls below the variance that
counting alone gives in a text of the group's median length, that variance stands in for it; other directions are left as
they are. A shorter text's deviations are shrunk to what they would be at the median length. Sources of under MIN_ROWS
rows are pooled with the others of their language, and languages under it with each other.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialise, passing, table

WORD_GAP = r"[\x20\x09-\x0D]"
#: axes: name, variance of the statistic in a text of size 1, and what the size counts. The square root of a share of N
#: has variance 1 / (4 N) if single occurrences count; repeats come as 16 words at least; word lengths vary by half their mean
AXES = (
    ("log_word_length", 0.25, "n_words"), ("symbol_share", 0.25, "word_chars"), ("upper_share", 0.25, "word_chars"),
    ("repeat_share", 4.0, "n_words"), ("stutter_share", 0.25, "n_words"), ("line_share", 0.25, "n_lines"),
)
SIZES = ("n_words", "word_chars", "n_lines")
P = len(AXES)
SUBSET = 0.75
MAX_ORDINARY = 1e-7  # share of ordinary texts that the cut may reject
MIN_ROWS = 200
TOLERANCE = 1e-3  # of the log determinant
_BINS_PER_DOUBLING, _BIN_RANGE = 16, 800
_GRID = 512  # bins per unit of a statistic, for its quartiles


def chi_squared(x: float, freedom: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1.0 - math.exp(-x / 2.0) * sum((x / 2.0) ** i / math.factorial(i) for i in range(freedom // 2))


def chi_squared_quantile(share: float, freedom: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if chi_squared(mid, freedom) < share else (lo, mid)
    return lo


CONSISTENCY = SUBSET / chi_squared(chi_squared_quantile(SUBSET, P), P + 2)
LIMIT = chi_squared_quantile(1.0 - MAX_ORDINARY, P)


def let(value: Column, body) -> Column:
    """Evaluate value once and use it in body."""
    return F.transform(F.array(value), body)[0]


def once(value: Column) -> Column:
    """value, not to be evaluated again by filters and projections that the optimizer moves below it."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _repeated(windows: Column, width: int) -> Column:
    """Words covered by the windows whose hash occurs twice or more; windows: one hash for each start."""

    def covered(starts: Column) -> Column:
        each = F.transform(starts, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(starts, j + 1) - p, F.lit(width))))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated_starts(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(let(ordered, repeated_starts), covered))


def repeats(words: Column, width: int = 8) -> Column:
    """A struct of n_repeat_words, the words in windows of `width` words that occur twice or more in the text (the first
    occurrence included), and n_stutter, the words equal to the one before."""

    def count(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, width)))
        repeated = F.when(F.size(h) > width, let(windows, lambda w: _repeated(w, width))).otherwise(F.lit(0).cast("long"))
        stutter = F.size(F.filter(h, lambda x, i: F.coalesce(F.get(h, i - 1) == x, F.lit(False)))).cast("long")
        return F.struct(repeated.alias("n_repeat_words"), stutter.alias("n_stutter"))

    return let(_hashes(words), count)


def text_counts(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stutter, n_upper of a text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, WORD_GAP + "+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words, lambda w: let(repeats(w), lambda r: F.struct(F.size(w).cast("long").alias("n_words"), r["n_repeat_words"].alias("n_repeat_words"), r["n_stutter"].alias("n_stutter"))))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))

    def joined(w: Column, x: Column) -> Column:
        return F.struct(
            w["n_words"].alias("n_words"),
            (F.length(t) - F.regexp_count(t, F.lit(WORD_GAP))).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            x["n_lines"].alias("n_lines"), x["n_dup_lines"].alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"), w["n_stutter"].alias("n_stutter"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        )

    return let(by_words, lambda w: let(by_lines, lambda x: joined(w, x)))


def _with_point(df: DataFrame, counts: str = "_c") -> DataFrame:
    """Adds _failed (the plain rules), the sizes _v_<size> (at least 1) and the axes _x0.. from the struct of counts."""
    c = lambda name: F.col(f"{counts}.{name}").cast("double")
    size = {name: F.greatest(c(name), F.lit(1.0)) for name in SIZES}
    share = lambda count, of: F.sqrt(c(count) / size[of])
    axes = (F.log(size["word_chars"] / size["n_words"]), share("n_symbols", "word_chars"), share("n_upper", "word_chars"), share("n_repeat_words", "n_words"), share("n_stutter", "n_words"), share("n_dup_lines", "n_lines"))
    failed = (F.col(f"{counts}.n_words") < 20) | (100 * F.col(f"{counts}.n_repeat_words") > 30 * F.col(f"{counts}.n_words"))
    return df.withColumn("_failed", failed).withColumns({f"_v_{n}": v for n, v in size.items()} | {f"_x{k}": a for k, a in enumerate(axes)})


_PAIRS = list(combinations_with_replacement(range(P), 2))
_SUMS = ["_n", *(f"_t{i}" for i in range(P)), *(f"_p{i}{j}" for i, j in _PAIRS)]
_MODEL = ["_group", *(f"_m{i}" for i in range(P)), *(f"_c{i}" for i in range(P)), *(f"_d{i}" for i in range(P)), *(f"_l{i}{j}" for i, j in _PAIRS if i < j), *(f"_f{i}" for i in range(P)), *(f"_typical_{n}" for n in SIZES)]


def factorised(df: DataFrame) -> DataFrame:
    """From the scatter _s00.. and the least pivots _f0..: its variances _c, pivots _d and factors _l, and _logdet.

    One projection, whose later columns name earlier ones: _e<k><i><j> is the scatter after k steps of elimination.
    """
    left = lambda k, i, j: f"_e{k}{i}{j}" if k else f"_s{i}{j}"
    steps = [f"greatest(_s{k}{k}, _f{k}) AS _c{k}" for k in range(P)]
    for k in range(P):
        steps.append(f"greatest({left(k, k, k)}, _f{k}) AS _d{k}")
        steps += [f"{left(k, k, i)} / _d{k} AS _l{k}{i}" for i in range(k + 1, P)]
        steps += [f"{left(k, i, j)} - _l{k}{i} * {left(k, k, j)} AS _e{k + 1}{i}{j}" for i in range(k + 1, P) for j in range(i, P)]
    return df.selectExpr("*", *steps, f"{' + '.join(f'ln(_d{k})' for k in range(P))} AS _logdet")


def with_distance(df: DataFrame, deviations: list[Column]) -> DataFrame:
    """Adds _distance, the squared Mahalanobis distance of deviations from a centre, by forward substitution through a model's columns.

    A column for each step: as one expression the steps would hold each other, doubling its size with each axis. Filters
    aren't moved below it for the same reason.
    """
    for i, x in enumerate(deviations):
        df = df.withColumn(f"_r{i}", reduce(lambda a, k: a - F.col(f"_l{k}{i}") * F.col(f"_r{k}"), range(i), x))  # noqa: B023
    total = reduce(lambda a, b: a + b, (F.col(f"_r{k}") * F.col(f"_r{k}") / F.col(f"_d{k}") for k in range(P)))
    return df.withColumn("_distance", once(total)).drop(*(f"_r{k}" for k in range(P)))


def _deviations() -> list[Column]:
    return [F.col(f"_x{k}") - F.col(f"_m{k}") for k in range(P)]


def at_typical_length() -> list[Column]:
    """Deviations shrunk in a text shorter than the group's median, whose counts scatter more: by the ratio of standard deviations."""
    more = lambda k: F.greatest(AXES[k][1] / F.col(f"_v_{AXES[k][2]}") - AXES[k][1] / F.col(f"_typical_{AXES[k][2]}"), F.lit(0.0))
    return [x / F.sqrt(1.0 + more(k) / F.col(f"_c{k}")) for k, x in enumerate(_deviations())]


def _moments(points: DataFrame, keys: list[str]) -> DataFrame:
    """Count and sums of the axes and of their products; each task's sums first, then the keys'."""
    sums = [F.count(F.lit(1)).cast("double").alias("_n"), *(F.sum(f"_x{i}").alias(f"_t{i}") for i in range(P)), *(F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_p{i}{j}") for i, j in _PAIRS)]
    return points.groupBy(*keys).agg(*sums)


def _estimates(moments: DataFrame, widen: float) -> DataFrame:
    """Adds the centre _m0.. and the scatter _s00.. that the count and sums give."""
    w = moments.withColumns({f"_m{i}": F.col(f"_t{i}") / F.col("_n") for i in range(P)})
    return w.withColumns({f"_s{i}{j}": (F.col(f"_p{i}{j}") / F.col("_n") - F.col(f"_m{i}") * F.col(f"_m{j}")) * widen for i, j in _PAIRS}).drop(*_SUMS)


def quartiles(points: DataFrame) -> DataFrame:
    """For each group the axes' quartiles _q1_0, _q2_0, _q3_0 .. and the sizes' medians _typical_<size>, from counts on a fixed grid."""
    grids = [(F.col(f"_x{k}"), lambda at: at / _GRID, lambda x: x * _GRID) for k in range(P)] + [(F.col(f"_v_{n}"), lambda at: F.pow(F.lit(2.0), at / 16.0), lambda x: F.log2(x) * 16.0) for n in SIZES]
    cells = F.array(*(F.struct(F.lit(k).alias("axis"), F.round(to(x)).cast("int").alias("at")) for k, (x, _, to) in enumerate(grids)))
    counted = materialise(points.select("_group", F.explode(cells).alias("c")).groupBy("_group", "c.axis", "c.at").agg(F.count(F.lit(1)).alias("n")), "grid")
    of = Window.partitionBy("_group", "axis")
    ranked = counted.withColumn("upto", F.sum("n").over(of.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(of))
    quantile = lambda k, q: F.min(F.when((F.col("axis") == k) & (F.col("upto") >= q * F.col("all")), F.col("at")))
    return ranked.groupBy("_group").agg(
        *(grids[k][1](quantile(k, q / 4.0)).alias(f"_q{q}_{k}") for k in range(P) for q in (1, 2, 3)),
        *(grids[P + i][1](quantile(P + i, 0.5)).alias(f"_typical_{n}") for i, n in enumerate(SIZES)),
    )


def groups(points: DataFrame) -> DataFrame:
    """_lang, _source, _group: a group of its own for each language and source of MIN_ROWS points, the rest pooled by language, then altogether."""
    n = points.where(~F.col("_failed")).groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n"))
    small = n.where(F.col("n") < MIN_ROWS).groupBy("_lang").agg(F.sum("n").alias("pooled"))
    name = F.when(F.col("n") >= MIN_ROWS, F.to_json(F.array("_lang", "_source"))).when(F.col("pooled") >= MIN_ROWS, F.to_json(F.array("_lang"))).otherwise("[]")
    return n.join(small, "_lang", "left").select("_lang", "_source", name.alias("_group"))


def concentrated(points: DataFrame, model: DataFrame, floors: DataFrame) -> DataFrame:
    """One concentration step for all groups and starts of a model: the estimates from the nearest SUBSET of each group's points."""
    keys = ["_group", "_start"]
    at = F.floor(F.log2(F.greatest(F.col("_distance"), F.lit(1e-12))) * _BINS_PER_DOUBLING)
    binned = materialise(_moments(with_distance(points.join(model, "_group"), _deviations()).withColumn("_bin", F.least(F.greatest(at, F.lit(-_BIN_RANGE)), F.lit(_BIN_RANGE)).cast("int")), [*keys, "_bin"]), "bins")
    of = Window.partitionBy(*keys)
    placed = binned.withColumn("_before", F.coalesce(F.sum("_n").over(of.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("_wanted", SUBSET * F.sum("_n").over(of))
    # of the last bin that is needed, the share that is needed
    part = F.least(F.lit(1.0), (F.col("_wanted") - F.col("_before")) / F.col("_n"))
    inside = placed.where("_before < _wanted").groupBy(*keys).agg(*(F.sum(F.col(c) * part).alias(c) for c in _SUMS))
    was = model.select(*keys, F.col("_logdet").alias("_was"))
    return materialise(factorised(_estimates(inside, CONSISTENCY).join(floors, "_group").join(was, keys)).select("_start", "_logdet", "_was", *_MODEL), "mcd")


def fit(points: DataFrame) -> DataFrame:
    """Minimum covariance determinant estimates of points (_group, _x0.., _v_<size>..): one row for each group.

    Starts: medians with the spread of the middle halves; mean and covariance of all points; those of the points within
    three such spreads of the medians on every axis. A group of one point is its own centre. No points give no groups.
    """
    middle = materialise(quartiles(points), "quartiles")
    floors = middle.select("_group", *((v / F.col(f"_typical_{of}")).alias(f"_f{k}") for k, (_, v, of) in enumerate(AXES)), *(f"_typical_{n}" for n in SIZES))
    floors = materialise(floors, "floors")
    spread = lambda k: F.greatest((F.col(f"_q3_{k}") - F.col(f"_q1_{k}")) / 1.349, F.sqrt(f"_f{k}"))
    wide = middle.join(floors.drop(*(f"_typical_{n}" for n in SIZES)), "_group")
    # small tables are written before they meet the points: Spark then knows their size, and doesn't deal the points by group
    boxes = materialise(wide.select("_group", *(F.col(f"_q2_{k}").alias(f"_m{k}") for k in range(P)), *(spread(k).alias(f"_w{k}") for k in range(P))), "boxes")
    by_median = boxes.select("_group", F.lit(1).alias("_start"), *(f"_m{k}" for k in range(P)), *((F.col(f"_w{i}") * F.col(f"_w{i}") if i == j else F.lit(0.0)).alias(f"_s{i}{j}") for i, j in _PAIRS))
    inside = reduce(lambda a, b: a & b, (F.abs(F.col(f"_x{k}") - F.col(f"_m{k}")) <= 3.0 * F.col(f"_w{k}") for k in range(P)))
    either = points.join(boxes, "_group").select("_group", *(f"_x{k}" for k in range(P)), F.explode(F.when(inside, F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(2)))).alias("_start"))
    by_mean = _estimates(materialise(_moments(either, ["_group", "_start"]), "bins"), 1.0)
    starts = factorised(by_median.unionByName(by_mean).join(floors, "_group")).withColumn("_logdet", F.lit(float("inf")))
    model = materialise(starts.select("_start", "_logdet", *_MODEL), "mcd")
    found = []
    while True:
        after = concentrated(points, model, floors)
        found.append(after)
        model = after.where(F.col("_logdet") < F.col("_was") - TOLERANCE).drop("_was")
        if model.isEmpty():
            break
    best = reduce(DataFrame.unionByName, found).groupBy("_group").agg(F.min_by(F.struct("_logdet", "_start", *_MODEL[1:]), F.struct("_logdet", "_start")).alias("b"))
    return materialise(best.select("_group", "b.*"), "mcd")


def _grouped(df: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    return df.withColumns({"_lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")), "_source": F.coalesce(F.col(source_col).cast("string"), F.lit(""))})


def _model(points: DataFrame) -> DataFrame:
    """The estimates for each _lang and _source of a written table of points."""
    with passing(points.sparkSession):
        named = materialise(groups(points), "groups")
        narrow = points.where(~F.col("_failed")).select("_lang", "_source", *(f"_x{k}" for k in range(P)), *(f"_v_{n}" for n in SIZES))
        model = fit(materialise(narrow.join(named, ["_lang", "_source"]).drop("_lang", "_source"), "narrow"))
        return materialise(named.join(model, "_group"), "models", keep=True)


def _judged(points: DataFrame, model: DataFrame) -> DataFrame:
    """Adds _distance and _kept: false where a plain rule fails or the distance exceeds LIMIT."""
    judged = with_distance(points.join(model, ["_lang", "_source"], "left"), at_typical_length())
    return judged.withColumn("_kept", ~F.col("_failed") & ~F.coalesce(F.col("_distance") > LIMIT, F.lit(False)))


def quality_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts and verdicts of all rows: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    A null text counts as empty and fails; null language and source are a group of their own (the empty name); repeated
    rows are judged alike, each in its own row; an empty table gives an empty result; other columns aren't read.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_l"), F.col(source_col).alias("_s"), text_counts(F.col(text_col)).alias("_c"))
    points = materialise(_with_point(_grouped(rows, "_l", "_s")).drop("_l", "_s"), "points")
    judged = _judged(points, _model(points))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(F.col("_id").alias(id_col), *(F.col(f"_c.{c}").alias(c) for c in counts), F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_distance").alias("distance"))


def keep_quality(df: DataFrame) -> DataFrame:
    """The rows of df that quality_report keeps, with their columns as they are.

    Null texts go, as they fail; null ids stay or go by their texts; repeated rows stay or go together; an empty table
    gives an empty one. The counts are computed twice, for the estimates and for the verdict: a copy of the texts beside
    the counts would take more disk than the input.
    """
    rows = df.select(F.struct("*").alias("_row"), F.col("lang").alias("_l"), F.col("source").alias("_s"), once(text_counts(F.col("text"))).alias("_c"))
    flagged = _with_point(_grouped(rows, "_l", "_s"))
    with passing(df.sparkSession):
        points = materialise(flagged.select("_lang", "_source", "_failed", *(f"_x{k}" for k in range(P)), *(f"_v_{n}" for n in SIZES)), "points")
        model = _model(points)
    return _judged(flagged, model).where("_kept").select("_row.*")


def op8_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
