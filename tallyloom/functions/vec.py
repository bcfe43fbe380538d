"""Statistics of count vectors (arrays of doubles) as Column expressions. Divisions are guarded: ANSI mode stays on."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it in body."""
    return F.transform(F.array(value), body)[0]


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def mean(c: Column) -> Column:
    return divide(total(c), F.size(c).cast("double"))


def sd(c: Column) -> Column:
    """Sample standard deviation; null for fewer than two values."""
    squares = let(mean(c), lambda m: F.aggregate(c, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
    return F.when(F.size(c) > 1, F.sqrt(squares / F.greatest(F.size(c) - 1, F.lit(1))))


def median(c: Column) -> Column:
    n = F.size(c)
    return let(F.array_sort(c), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)


def pick(c: Column, places: Sequence[int]) -> Column:
    """The values at the given places (0-based)."""
    return F.array(*(F.get(c, i) for i in places)) if places else F.array().cast("array<double>")


def argsort(c: Column) -> Column:
    """The places (from 0) of the values in ascending order, equal values by place."""
    return F.transform(F.array_sort(F.transform(c, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])


def below(s: Column, x: Column, steps: Column, inclusive: bool = False) -> Column:
    """How many values of a sorted array are less than x (inclusive: at most x), by binary search; steps: the powers of two up to its size, largest first."""
    left = lambda n: (F.get(s, n - 1) <= x) if inclusive else (F.get(s, n - 1) < x)
    return F.aggregate(steps, F.lit(0), lambda n, p: F.when((n + p <= F.size(s)) & F.coalesce(left(n + p), F.lit(False)), n + p).otherwise(n))


def ranks(c: Column) -> Column:
    """Average ranks from 0: the number of smaller values plus half the number of other equal ones, from one sort and two searches for each value."""
    powers = F.filter(F.lit([1 << b for b in range(24, -1, -1)]), lambda p: p <= F.size(c))
    of = lambda s, steps: F.transform(c, lambda x: (below(s, x, steps) + below(s, x, steps, True) - 1) / 2.0)
    return let(F.array_sort(c), lambda s: let(powers, lambda steps: of(s, steps)))


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation; 0 where either vector is constant."""

    def of_sums(s: Column) -> Column:
        n = F.size(x).cast("double")
        vx, vy = s["xx"] - s["x"] * s["x"] / n, s["yy"] - s["y"] * s["y"] / n
        return F.when((vx > 1e-12 * s["xx"]) & (vy > 1e-12 * s["yy"]), (s["xy"] - s["x"] * s["y"] / n) / F.sqrt(F.greatest(vx, F.lit(1e-300)) * F.greatest(vy, F.lit(1e-300)))).otherwise(F.lit(0.0))

    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("x", "y", "xx", "yy", "xy")))
    pairs = F.zip_with(x, y, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    add = lambda s, p: F.struct(
        (s["x"] + p["a"]).alias("x"), (s["y"] + p["b"]).alias("y"), (s["xx"] + p["a"] * p["a"]).alias("xx"), (s["yy"] + p["b"] * p["b"]).alias("yy"), (s["xy"] + p["a"] * p["b"]).alias("xy")
    )
    return F.when(F.size(x) > 0, let(F.aggregate(pairs, zero, add), of_sums))


def spearman(x: Column, y: Column) -> Column:
    return let(ranks(x), lambda a: let(ranks(y), lambda b: pearson(a, b)))


def mac(x: Column, y: Column) -> Column:
    """Mean absolute contrast: the mean of |x - y| / (x + y), a term being 0 where x = y."""
    return divide(total(F.zip_with(x, y, lambda a, b: F.when(a == b, F.lit(0.0)).otherwise(F.abs(a - b) / F.when(a + b != 0, a + b)))), F.size(x).cast("double"))


DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "pearson": lambda x, y: 0.5 * (1.0 - pearson(x, y)),
    "spearman": lambda x, y: 0.5 * (1.0 - spearman(x, y)),
    "mac": mac,
}


def half_up(c: Column) -> Column:
    """Counts as whole numbers: the floor of x + 0.5."""
    return F.transform(c, lambda x: F.floor(x + 0.5).cast("long"))
