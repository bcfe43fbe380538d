"""Scores of features, multiple-testing correction, order and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vec
from ..functions.classify import accuracy_column
from ..functions.student_t import student_t_p
from ..matrix import FeatureMatrix
from ..storage import numbered, ranges

#: sort orders: "abs" largest absolute value first, "desc" and "asc"
ORDERS = {"ttest.padj": "asc", "ttest.pi": "desc", "snr": "abs", "dids": "desc", "lr": "desc", "bayes": "desc", "svm": "desc", "pearson": "abs", "spearman": "abs", "sd": "desc", "rsd1": "desc", "rsd2": "desc", "rsd3": "desc", "entropy": "asc", "entropy_exact": "asc"}
_TWO, _MORE, _CONTINUOUS = ("ttest.padj", "ttest.pi", "snr", "lr"), ("dids", "bayes", "svm"), ("pearson", "spearman")


def _two(counts: Column, labels: list[int]) -> tuple[Column, Column]:
    return tuple(vec.pick(counts, [i for i, y in enumerate(labels) if (y == 0) == first]) for first in (True, False))


def snr(counts: Column, labels: list[int]) -> Column:
    """(m1 - m2) / (s1 + s2) of the first class and the rest; 0 where both are constant."""
    a, b = _two(counts, labels)
    return vec.let(F.struct(vec.mean(a).alias("m"), vec.mean(b).alias("n"), (vec.sd(a) + vec.sd(b)).alias("s")), lambda x: F.when(x["s"] == 0, F.lit(0.0)).otherwise((x["m"] - x["n"]) / F.when(x["s"] != 0, x["s"])))


def dids(counts: Column, labels: list[int]) -> Column:
    """The largest over the classes of the sum of sqrt(x - class maximum) over the other samples above that maximum."""
    each = []
    for g in range(max(labels) + 1):
        own = vec.pick(counts, [i for i, y in enumerate(labels) if y == g])
        rest = vec.pick(counts, [i for i, y in enumerate(labels) if y != g])
        each.append(_above(rest, F.array_max(own)))
    return F.greatest(*each) if len(each) > 1 else each[0]


def _above(rest: Column, top: Column) -> Column:
    return vec.let(top, lambda t: F.aggregate(rest, F.lit(0.0), lambda a, x: a + F.sqrt(F.greatest(x - t, F.lit(0.0)))))


def welch(counts: Column, labels: list[int]) -> Column:
    """A struct of t, df and diff (mean of the rest less that of the first class) on log2(x + 1); t null where both are constant."""
    log = lambda c: F.transform(c, lambda x: F.log2(x + 1.0))
    a, b = (log(c) for c in _two(counts, labels))
    n, k = labels.count(0), len(labels) - labels.count(0)

    def of(s: Column) -> Column:
        va, vb = s["sa"] * s["sa"] / n, s["sb"] * s["sb"] / k
        some = va + vb > 0
        t = F.when(some, (s["ma"] - s["mb"]) / F.sqrt(F.when(some, va + vb)))
        df = F.when(some, (va + vb) * (va + vb) / F.when(some, va * va / (n - 1) + vb * vb / (k - 1)))
        return F.struct(t.alias("t"), df.alias("df"), (s["mb"] - s["ma"]).alias("diff"))

    return vec.let(F.struct(vec.mean(a).alias("ma"), vec.mean(b).alias("mb"), vec.sd(a).alias("sa"), vec.sd(b).alias("sb")), of)


def rsd(counts: Column, by: Column) -> Column:
    """The standard deviation, divided by a level where that exceeds 1."""
    return vec.let(F.struct(vec.sd(counts).alias("s"), by.alias("b")), lambda x: F.when(x["b"] <= 1, x["s"]).otherwise(x["s"] / F.when(x["b"] > 1, x["b"])))


def entropy(counts: Column) -> Column:
    """-(sum (x+1) log2(x+1) - log2(sum x) (sum x + n)) / sum x; null for a feature without counts."""
    inner = F.aggregate(counts, F.lit(0.0), lambda a, x: a + (x + 1.0) * F.log2(x + 1.0))
    return vec.let(F.struct(vec.total(counts).alias("t"), inner.alias("i")), lambda s: F.when(s["t"] > 0, (F.log2(F.greatest(s["t"], F.lit(1e-300))) * (s["t"] + F.size(counts)) - s["i"]) / F.when(s["t"] > 0, s["t"])))


def entropy_exact(counts: Column) -> Column:
    """-sum p log2 p with p = (x + 1) / sum (x + 1)."""
    return vec.let(vec.total(counts) + F.size(counts), lambda t: -F.aggregate(counts, F.lit(0.0), lambda a, x: a + (x + 1.0) / t * F.log2((x + 1.0) / t)))


def score(m: FeatureMatrix, by: str, labels: list[int] | None = None, target: list[float] | None = None, folds: int = 1) -> DataFrame:
    """df of the matrix with a column score (for ttest.padj: adjusted p-values). No shuffle but for the correction."""
    c = F.col("counts")
    if by not in ORDERS:
        raise ValueError(f"unknown score {by!r}")
    if by in _TWO + _MORE:
        classes = len(set(labels or []))
        if (by in _TWO and classes != 2) or classes < 2:
            raise ValueError(f"{by} needs {'two' if by in _TWO else 'two or more'} classes, not {classes}")
    if by in _CONTINUOUS:
        if target is None:
            raise ValueError(f"{by} needs a value for each sample")
        y = F.array(*(F.lit(float(v)) for v in target))
        return m.df.withColumn("score", vec.pearson(c, y) if by == "pearson" else vec.spearman(c, y))
    if by in ("lr", "bayes", "svm"):
        return m.df.withColumn("score", accuracy_column(c, labels, by, folds))
    if by.startswith("ttest"):
        tested = m.df.withColumn("_w", welch(c, labels)).withColumn("p", F.when(F.col("_w.t").isNull(), F.lit(1.0)).otherwise(student_t_p(F.col("_w.t"), F.col("_w.df"))))
        if by == "ttest.pi":
            return tested.withColumn("score", -F.log10(F.greatest("p", F.lit(1e-300))) * F.abs(F.col("_w.diff"))).drop("_w", "p")
        return adjust(tested.drop("_w"), "p").withColumnRenamed("p_adjusted", "score").drop("p")
    plain = {
        "snr": lambda: snr(c, labels), "dids": lambda: dids(c, labels), "sd": lambda: vec.sd(c), "rsd1": lambda: rsd(c, vec.mean(c)), "rsd2": lambda: rsd(c, F.array_min(c)), "rsd3": lambda: rsd(c, vec.median(c)),
        "entropy": lambda: entropy(c), "entropy_exact": lambda: entropy_exact(c),
    }
    return m.df.withColumn("score", plain[by]())


def adjust(df: DataFrame, p: str = "p", standard: bool = False) -> DataFrame:
    """Benjamini-Hochberg: adds p_adjusted (null where p is). The default multiplies rank r < m by m / (r + 1), `standard` by m / r.

    Rows are dealt into ranges of p and ranked by their numbers there and the ranges' sizes; the running minimum from the top is taken
    within ranges and over their minima. Rows with equal p spread over ranges, and yet end with the same value: that
    of the last of them, or a smaller one above.
    """
    n = F.col(p).isNotNull()
    placed = ranges(df, [F.col(p).asc_nulls_last()])
    sizes = placed.groupBy("_range").agg(F.count_if(n).alias("_n"))
    everything = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_n").over(everything).alias("_m"))
    m, r = F.col("_m").cast("double"), (F.col("_start") + F.col("_at") + 1).cast("double")
    raised = F.least(F.col(p) * m / r, F.lit(1.0)) if standard else F.col(p) * F.when(r < m, m / (r + 1.0)).otherwise(F.lit(1.0))
    # a row for each partition: bounded by their number
    valued = placed.join(F.broadcast(starts), "_range").withColumn("_v", F.when(n, raised))
    tails = valued.groupBy("_range").agg(F.min("_v").alias("_least"))
    tails = tails.select("_range", F.min("_least").over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    down = Window.partitionBy("_range").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = valued.withColumn("_w", F.min("_v").over(down)).join(F.broadcast(tails), "_range")
    return done.withColumn("p_adjusted", F.when(n, F.least("_w", F.coalesce("_after", "_w")))).select(*df.columns, "p_adjusted")


def _order(by: str) -> list[Column]:
    s = F.col("score")
    return [{"abs": F.abs(s).desc_nulls_last(), "desc": s.desc_nulls_last(), "asc": s.asc_nulls_last()}[ORDERS[by]], F.col("feature").asc()]


def ordered(scored: DataFrame, by: str) -> DataFrame:
    """The scorer's order, undefined scores last, ties by feature."""
    return scored.orderBy(*_order(by))


def number_selected(n: int, top: float | None) -> int:
    """How many of n rows -seltop means: all for none or 0, a share below 0.999999, else a count."""
    if top is None or top <= 0:
        return n
    if top < 0.999999:
        return int(n * top + 0.5)
    if top > n:
        raise ValueError(f"{top:g} features asked for, of {n}")
    return int(top + 0.00005)


IN_ONE_TASK = 10_000


def select_top(scored: DataFrame, by: str, top: float | None) -> DataFrame:
    """The best rows, in order. All rows are counted first, since the count tells what `top` means and whether there are enough.

    Up to IN_ONE_TASK rows are the best of each task's best; more are found by their number in ranges of the order.
    """
    if top is None or top <= 0:
        return ordered(scored, by)
    wanted = number_selected(scored.count(), top)
    if wanted <= IN_ONE_TASK:
        return ordered(scored, by).limit(wanted)
    return ordered(numbered(scored, _order(by), "_number").where(F.col("_number") < wanted).drop("_number"), by)
