"""Extending overlapping k-mers into contigs, by path contraction over tables.

For each overlap length, longest first, the contigs' ends of that length are grouped by sequence (canonical if unstranded). A knot
where exactly one contig ends and exactly one other begins is a joint; an optional test on the counts of the two k-mers
at the joint must pass. Every contig then has at most one joint at either side, so joints form paths, which are
contracted at once: paths are walked within buckets of the joints' minimisers and glued where they cross buckets (functions/paths.py),
and a grouping makes them contigs. Contigs are handled by two-bit codes: of their representative k-mer, their outer k-mers and the k - 1 bases
at either end; what a pass joins is written as links from new contigs to their parts. Sequences and members are made at the end, by
following the links down from the last pass to the k-mers.

Where the order of work would otherwise decide, there are two rules (`palindromes`):

"skip": in unstranded data, ends that are their own reverse complement are no knots; a contig both of whose ends lie at one knot joins nothing there;
cycles are cut before their smallest contig; among equal representative values the smallest k-mer (stranded: the leftmost)
represents the contig, and the contig is written so that its representative reads forward. Contraction changes no end that isn't joined,
so one pass settles an overlap.

"orient": what one worker does that takes contigs in the order of their representatives' codes and knots in the order of theirs. An end
that is its own reverse complement counts as its contig is written at the time. A contig both of whose ends lie at one knot is entered once, as
what the knot lacks. In a pass, a joint is made unless one of its contigs has already been taken up by another; of the two, the one with the better
representative value (of equal ones the first in the knot's orientation) takes up the other and keeps its orientation. Passes follow until nothing
joins. Here, a pass needs no sequence: whether a joint is made depends on the joint before it at the same contig alone, so the joints
that hinge on each other form chains and take turns along them, and a chain is settled by the distances from its beginning.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import medians, paths, seq, superkmers, unitigs, vec
from ..matrix import FeatureMatrix
from ..storage import materialise

REP_MODES = {"min": lambda v: v, "max": lambda v: -v, "minabs": lambda v: F.abs(v), "maxabs": lambda v: -F.abs(v)}
PALINDROMES = ("skip", "orient")
_COLUMNS = ["code", "rep_value", "head", "rear", "pre", "suf", "length", "born"]


def _store(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration."""
    return materialise(df, "merge")


def _low(code: Column, bases: int) -> Column:
    return code.bitwiseAND(F.lit((1 << 2 * bases) - 1))


def seeds(m: FeatureMatrix, values: DataFrame | None = None) -> DataFrame:
    """Contigs of one k-mer each: code, rep_value, head, rear, pre, suf, length (bases), born (the pass that made it); values: (feature, value) to start from, else all with 0.

    values of contigs that are already merged raise: a contig is no k-mer.
    """
    if values is not None and "members" in values.columns and not values.where(F.size("members") > 1).isEmpty():
        raise ValueError("contigs of several k-mers can't be merged again")
    df = m.df.select("feature") if values is None else values.join(m.df.select("feature"), "feature", "left_semi")
    value = F.lit(0.0) if values is None else F.col("value").cast("double")
    coded = df.select(seq.encode(F.col("feature"), m.k).alias("code"), value.alias("rep_value"))
    return _single(coded, m.k)


def _single(coded: DataFrame, k: int) -> DataFrame:
    c = F.col("code")
    return coded.select("code", "rep_value", c.alias("head"), c.alias("rear"), F.shiftright(c, 2).alias("pre"), _low(c, k - 1).alias("suf"), F.lit(k).cast("long").alias("length"), F.lit(0).alias("born"))


def _ends(contigs: DataFrame, overlap: int, k: int, stranded: bool) -> DataFrame:
    """code, mer (at the end), is_pre, knot, rc (whether the end is read backward at the knot), own (its own reverse complement), of both ends."""
    side = lambda end, mer, is_pre: F.struct(end.alias("end"), F.col(mer).alias("mer"), F.lit(is_pre).alias("is_pre"))
    pre, suf = F.shiftrightunsigned("pre", 2 * (k - 1 - overlap)), _low(F.col("suf"), overlap)
    each = contigs.select("code", F.explode(F.array(side(pre, "head", True), side(suf, "rear", False))).alias("e")).select("code", "e.*")
    other = F.col("end") + 1 if stranded else seq.flip_code(F.col("end"), overlap)
    return each.withColumn("other", other).select("code", "mer", "is_pre", F.least("end", "other").alias("knot"), (F.col("other") < F.col("end")).alias("rc"), (F.col("other") == F.col("end")).alias("own"))


def joints(contigs: DataFrame, overlap: int, k: int, stranded: bool) -> DataFrame:
    """knot, pred, pred_fwd, succ, succ_fwd (codes of contigs) and the k-mers at the joint (pred_mer, succ_mer) of each mergeable knot.

    pred_fwd and succ_fwd tell whether the contig is read forward in the knot's orientation.
    """
    each = _ends(contigs, overlap, k, stranded).where("not own")
    # a prefix read forward follows the knot, a suffix leads to it; read backward they change places
    pred = F.col("is_pre") == F.col("rc")
    of = lambda is_pred, c: F.max(F.when(pred == is_pred, c))  # noqa: E731  looked at where there is one
    knots = each.groupBy("knot").agg(
        F.count_if(pred).alias("np"), F.count_if(~pred).alias("ns"), *(of(is_pred, F.col(c)).alias(f"{name}{c}") for is_pred, name in ((True, "p"), (False, "s")) for c in ("code", "rc", "mer"))
    )
    return knots.where("np = 1 and ns = 1 and pcode <> scode").select("knot", F.col("pcode").alias("pred"), (~F.col("prc")).alias("pred_fwd"), F.col("scode").alias("succ"), (~F.col("src")).alias("succ_fwd"), F.col("pmer").alias("pred_mer"), F.col("smer").alias("succ_mer"))


def oriented_joints(contigs: DataFrame, overlap: int, k: int, stranded: bool) -> DataFrame:
    """The same under the rule "orient": ends by how their contigs are written, contigs with both ends at a knot once.

    A knot takes one contig before it and one behind; with a third entry it is ambiguous, so only knots of two are looked at.
    """
    each = _ends(contigs, overlap, k, stranded).groupBy("knot", "code").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("is_pre"), F.col("rc"))).alias("prc"), F.max(F.when(~F.col("is_pre"), F.col("rc"))).alias("src"), F.max(F.when(F.col("is_pre"), F.col("mer"))).alias("head"), F.max(F.when(~F.col("is_pre"), F.col("mer"))).alias("rear"),
    )
    entry = F.struct("code", F.col("n").alias("n"), "prc", "src", "head", "rear")
    pairs = each.groupBy("knot").agg(F.count(F.lit(1)).alias("n"), F.min(entry).alias("a"), F.max(entry).alias("b")).where("n = 2")
    prc, src = lambda e: F.col(f"{e}.prc"), lambda e: F.col(f"{e}.src")
    # the role of a contig with one end there, and of one with both, entered into a knot that lacks a predecessor or not
    single = lambda e: F.when(prc(e).isNotNull(), prc(e)).otherwise(~src(e))  # noqa: E731  is it a predecessor?
    single_rc = lambda e: F.coalesce(prc(e), src(e))
    as_pred = lambda e: F.when(~src(e), F.lit(False)).when(prc(e), F.lit(True))  # noqa: E731  read backward? null: can't
    as_succ = lambda e: F.when(~prc(e), F.lit(False)).when(src(e), F.lit(True))
    first_pred = F.when(F.col("a.n") == 1, single("a")).otherwise(as_pred("a").isNotNull())
    first_rc = F.when(F.col("a.n") == 1, single_rc("a")).when(as_pred("a").isNotNull(), as_pred("a")).otherwise(as_succ("a"))
    second_rc = F.when(F.col("b.n") == 1, F.when(single("b") != first_pred, single_rc("b"))).when(first_pred, as_succ("b")).otherwise(as_pred("b"))
    known = pairs.select("knot", "a", "b", first_pred.alias("first_pred"), first_rc.alias("arc"), second_rc.alias("brc")).where("brc is not null")
    pick = lambda x, y: F.when(F.col("first_pred"), x).otherwise(y)
    both = known.select("knot", pick(F.col("a"), F.col("b")).alias("p"), pick(F.col("b"), F.col("a")).alias("s"), pick(F.col("arc"), F.col("brc")).alias("prc"), pick(F.col("brc"), F.col("arc")).alias("src"))
    mer = lambda e, head: F.when(head, F.col(f"{e}.head")).otherwise(F.col(f"{e}.rear"))
    return both.select("knot", F.col("p.code").alias("pred"), (~F.col("prc")).alias("pred_fwd"), F.col("s.code").alias("succ"), (~F.col("src")).alias("succ_fwd"), mer("p", F.col("prc")).alias("pred_mer"), mer("s", ~F.col("src")).alias("succ_mer"))


def agreeing(edges: DataFrame, coded: DataFrame | None, method: str | None, threshold: float) -> DataFrame:
    """The joints whose k-mers' count vectors (coded: code, counts) are nearer than the threshold; method: pearson, spearman, mac or None."""
    if method in (None, "none"):
        return edges
    side = lambda name: coded.select(F.col("code").alias(f"{name}_mer"), F.col("counts").alias(f"{name}_counts"))
    both = edges.join(side("pred"), "pred_mer").join(side("succ"), "succ_mer")
    return both.withColumn("distance", vec.DISTANCES[method](F.col("pred_counts"), F.col("succ_counts"))).where(F.col("distance") < threshold).select(*edges.columns)


def coded_counts(m: FeatureMatrix) -> DataFrame:
    """code, counts of a matrix of k-mers."""
    return m.df.select(seq.encode(F.col("feature"), m.k).alias("code"), "counts")


def outer_counts(m: FeatureMatrix, contigs: DataFrame) -> DataFrame:
    """code, counts of the k-mers at either end of contigs, the only ones that joints can test."""
    outer = contigs.select(F.explode(F.array_distinct(F.array("head", "rear"))).alias("code")).distinct()
    return coded_counts(m).join(outer, "code", "left_semi")


def _arcs(edges: DataFrame, overlap: int, stranded: bool) -> DataFrame:
    """a, b, key: the joints as arcs of path_ranks, in both reading directions if unstranded; the key is the knot's minimiser."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            knot, p, pf, s, sf = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            least = superkmers.code_minimisers(knot, overlap)
            a, b = 2 * p + pf, 2 * s + sf
            if not stranded:
                a, b, least = np.concatenate([a, b ^ 1]), np.concatenate([b, a ^ 1]), np.concatenate([least, least])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(least)], names=["a", "b", "key"])

    return edges.select("knot", "pred", "pred_fwd", "succ", "succ_fwd").mapInArrow(cut, "a long, b long, key long")


def _ranked(edges: DataFrame, overlap: int, stranded: bool) -> DataFrame:
    """path, rank, code, fwd of every contig of a path, in both reading directions if unstranded."""
    ranks = paths.path_ranks(_store(_arcs(edges, overlap, stranded)))
    return _store(ranks.select("path", "rank", F.shiftright("node", 1).alias("code"), (F.col("node").bitwiseAND(F.lit(1)) == 1).alias("fwd")))


def _representatives(contigs: DataFrame, ranked: DataFrame, stranded: bool, rep_mode: str) -> DataFrame:
    """path, code, rep_value: of every path in the reading direction in which its best contig reads forward."""
    value = REP_MODES[rep_mode](F.col("rep_value"))
    best = F.min(F.struct(value.alias("v"), *([-F.col("rank")] if stranded else []), F.col("code").alias("code"), "rep_value", "fwd"))
    return ranked.join(contigs.select("code", "rep_value"), "code").groupBy("path").agg(best.alias("best")).where("best.fwd").select("path", F.col("best.code").alias("best"), F.col("best.rep_value").alias("rep_value"))


def contract(contigs: DataFrame, ranked: DataFrame, chosen: DataFrame, overlap: int, k: int, step: int) -> tuple[DataFrame, DataFrame]:
    """The contigs with every path made one, in the reading direction that is written (chosen: path, best, rep_value), and the links of the
    new ones to their parts: best (the new one), code, born, length, fwd and begin (the part's first base in it)."""
    parts = ranked.join(chosen, "path").join(contigs.drop("rep_value"), "code")
    turn = lambda here, there: F.when(F.col("fwd"), F.col(here)).otherwise(there)
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    turned = parts.select(
        "path", "best", "rep_value", "code", "born", "length", "fwd", (-F.col("rank")).alias("at"),
        turn("head", F.col("rear")).alias("head"), turn("rear", F.col("head")).alias("rear"),
        turn("pre", seq.flip_code(F.col("suf"), k - 1)).alias("pre"), turn("suf", seq.flip_code(F.col("pre"), k - 1)).alias("suf"),
    )
    placed = _store(turned.withColumn("begin", F.coalesce(F.sum(F.col("length") - overlap).over(before), F.lit(0))))
    first, last = (lambda c: F.min_by(c, "at").alias(c)), (lambda c: F.max_by(c, "at").alias(c))
    whole = placed.groupBy("path").agg(
        F.first("best").alias("code"), F.first("rep_value").alias("rep_value"), first("head"), last("rear"), first("pre"), last("suf"), F.max(F.col("begin") + F.col("length")).alias("length"), F.lit(step).alias("born"),
    )
    rest = contigs.join(ranked.select("code").distinct(), "code", "left_anti")
    return rest.select(*_COLUMNS).union(whole.select(*_COLUMNS)), placed.select("best", "code", "born", "length", "fwd", "begin")


def joined_first(m: FeatureMatrix, values: DataFrame | None, rep_mode: str, method: str | None, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The contigs that overlaps of k - 1 make under the rule "skip", and their stretches: best (the contig), begin, length, bases, ways.

    Joints are found, tested and walked within buckets of k-mers (functions/unitigs.py); only stretches are moved from there.
    """
    k = m.k
    kmers = seeds(m, values).select("code", "rep_value")
    if method not in (None, "none"):
        # without values, a k-mer's row has all that is needed
        kmers = coded_counts(m).select("code", F.lit(0.0).alias("rep_value"), "counts") if values is None else kmers.join(coded_counts(m), "code")
    if values is not None:
        kmers = _store(kmers)
    found = _store(unitigs.stretches(kmers, k, m.stranded, rep_mode, method, threshold))
    some, alone = found.where("head is not null and not alone"), found.where("alone")
    ranks = lambda s: paths.chain_ranks(s.select(F.col("head").alias("a"), F.col("tail").alias("b"), "length", "low")).withColumnRenamed("node", "head")
    columns = ("head", "path", "rank", "length", "best", "rep_value", "best_fwd", "best_at", "bases", "ways")
    on_paths = lambda s, r: s.join(r.where("not loose").select("head", "path", "rank"), "head").select(*columns)
    ranked = ranks(some)
    placed = on_paths(some, ranked).union(alone.withColumns({"path": F.col("tail"), "rank": F.col("length")}).select(*columns))
    loose = ranked.where("loose")
    if not loose.isEmpty():
        opened = _store(unitigs.opened(some.join(loose.select("head", F.col("low").alias("cycle")), "head"), k))
        placed = placed.union(on_paths(opened, ranks(opened)))
    value = REP_MODES[rep_mode](F.col("rep_value"))
    leftmost = [(F.col("best_at") - F.col("rank")).alias("at")] if m.stranded else []
    best = F.min(F.struct(value.alias("v"), *leftmost, F.col("best").alias("code"), "rep_value", "best_fwd"))
    every = placed.groupBy("path").agg(best.alias("x"), F.max_by("head", "rank").alias("first"), F.max("rank").alias("joints")).where("x.best_fwd")
    whole = _store(every.select("path", F.col("x.code").alias("code"), F.col("x.rep_value").alias("rep_value"), "first", "joints"))
    pieces = placed.select("path", "rank", "length", "bases", "ways").join(whole.select("path", F.col("code").alias("best"), "joints"), "path")
    pieces = _store(pieces.select("best", (F.col("joints") - F.col("rank")).alias("begin"), (F.col("length") + k).alias("length"), "bases", "ways"))
    code = lambda node: F.shiftright(node, 1)
    read = lambda node: F.when(F.col(node).bitwiseAND(F.lit(1)) == 1, code(node)).otherwise(seq.flip_code(code(node), k))
    long = whole.select("code", "rep_value", code("first").alias("head"), code("path").alias("rear"), F.shiftright(read("first"), 2).alias("pre"), _low(read("path"), k - 1).alias("suf"), (F.col("joints") + k).alias("length"), F.lit(1).alias("born"))
    apart = found.where("head is null").select(F.col("best").alias("code"), "rep_value", "ends")
    halves = apart.where("ends < 3").groupBy("code").agg(F.first("rep_value").alias("rep_value"), F.sum("ends").alias("ends")).where("ends = 3")
    return long.union(_single(apart.where("ends = 3").union(halves.select(*apart.columns)), k)), pieces


def written_out(contigs: DataFrame, links: list[DataFrame], k: int) -> DataFrame:
    """code, rep_value, contig, nb_merged, members (k-mers, from the contig's start) of contigs; links: those of each pass, from the first (or its stretches).

    From the last pass back, the parts of what it made are placed in the contigs; every part is written once.
    """
    tables = [contigs.where("born > 0").select(F.col("code").alias("whole"), "rep_value", "code", "born", "length", F.lit(True).alias("fwd"), F.lit(0).cast("long").alias("begin"))]
    born = lambda step: functools.reduce(DataFrame.union, (t.where(F.col("born") == step) for t in tables))
    none = F.lit(None).cast("binary")
    stretches = None
    for step in range(len(links), 0, -1):
        made = born(step).select("whole", "rep_value", F.col("code").alias("best"), F.col("length").alias("all"), F.col("fwd").alias("forward"), F.col("begin").alias("start"))
        at = F.col("start") + F.when(F.col("forward"), F.col("begin")).otherwise(F.col("all") - F.col("begin") - F.col("length"))
        parts = made.join(links[step - 1], "best")
        if "bases" in parts.columns:
            stretches = parts.select("whole", "rep_value", at.alias("begin"), F.col("forward").alias("fwd"), "length", F.lit(None).cast("long").alias("code"), "bases", "ways")
        else:
            tables.append(_store(parts.select("whole", "rep_value", "code", "born", "length", (F.col("fwd") == F.col("forward")).alias("fwd"), at.alias("begin"))))
    pieces = born(0).select("whole", "rep_value", "begin", "fwd", "length", "code", none.alias("bases"), none.alias("ways"))
    pieces = pieces if stretches is None else pieces.union(stretches.select(*pieces.columns))
    placed = unitigs.spelled(pieces, k).groupBy("whole").agg(F.first("rep_value").alias("rep_value"), F.sort_array(F.collect_list(F.struct("begin", "text", "marks"))).alias("p"))
    shared = lambda x, i: F.when(i == 0, F.lit(0)).otherwise(F.get("p", i - 1)["begin"] + F.length(F.get("p", i - 1)["text"]) - x["begin"]).cast("int")
    # stretches of one path have a k-mer in common, which is counted once
    begin = lambda x, i: F.when(shared(x, i) == k, F.lit(1)).otherwise(F.lit(0))

    def kmers(x: Column, i: Column) -> Column:
        window = lambda j: F.substring(x["text"], j + 1, F.lit(k))
        return F.transform(F.sequence(begin(x, i), F.length(x["marks"]) - 1), lambda j: F.when(F.substring(x["marks"], j + 1, F.lit(1)) == "1", window(j)).otherwise(seq.flip(window(j))))

    several = placed.select(
        F.col("whole").alias("code"), "rep_value", F.array_join(F.transform("p", lambda x, i: F.substring(x["text"], shared(x, i) + 1, F.length(x["text"]))), "").alias("contig"),
        F.aggregate(F.transform("p", lambda x, i: F.length(x["marks"]) - begin(x, i)), F.lit(0), lambda a, n: a + n).alias("nb_merged"), F.flatten(F.transform("p", kmers)).alias("members"),
    )
    kmer = seq.decode(F.col("code"), k)
    return contigs.where("born = 0").select("code", "rep_value", kmer.alias("contig"), F.lit(1).alias("nb_merged"), F.array(kmer).alias("members")).union(several)


def made_joints(edges: DataFrame, contigs: DataFrame, rep_mode: str) -> DataFrame:
    """The joints that one pass of the sequential worker makes, with loser: the contig that is taken up.

    A joint hinges on an earlier one (a smaller knot) at the same contig if that one takes the contig up. Then exactly one of the two
    is made, unless the joint hinges on two. Nothing hinges on a joint that hinges on two: both its neighbours come before it.
    """
    value = REP_MODES[rep_mode](F.col("rep_value"))
    side = lambda name: contigs.select(F.col("code").alias(name), value.alias(f"{name}_value"))
    ruled = _store(edges.join(side("pred"), "pred").join(side("succ"), "succ").withColumn("loser", F.when(F.col("pred_value") <= F.col("succ_value"), F.col("succ")).otherwise(F.col("pred"))).select(*edges.columns, "loser"))
    at = ruled.select("knot", "loser", F.explode(F.array("pred", "succ")).alias("contig"))
    both = at.groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("knot", "loser")).alias("first"), F.max("knot").alias("then")).where("n = 2 and first.loser = contig")
    hinges = _store(both.select(F.col("then").alias("a"), F.col("first.knot").alias("b")))
    twice = hinges.groupBy("a").count().where("count > 1").select("a")
    turns = paths.distances(_store(hinges.join(twice, "a", "left_anti")))
    later = _store(turns.select(F.col("node").alias("b"), (F.col("rank") % 2 == 0).alias("made")))
    # a joint that hinges on two is made if neither is; what no other hinges on and hinges on none is always made
    lost = hinges.join(twice, "a", "left_semi").join(later.where("not made"), "b", "left_anti").select("a").distinct()
    never = later.where("not made").select(F.col("b").alias("knot")).union(lost.withColumnRenamed("a", "knot"))
    return ruled.join(never, "knot", "left_anti")


def _survivors(contigs: DataFrame, ranked: DataFrame, made: DataFrame) -> DataFrame:
    """path, best, rep_value: the contig of each path that no joint takes up, in its own reading direction."""
    left = ranked.where("fwd").join(made.select(F.col("loser").alias("code")), "code", "left_anti")
    return left.join(contigs.select("code", "rep_value"), "code").select("path", F.col("code").alias("best"), "rep_value")


def merge(
    m: FeatureMatrix, values: DataFrame | None = None, longest: int | None = None, shortest: int | None = None, intervention: tuple[str | None, float] = ("pearson", 0.20), rep_mode: str = "min", min_members: int = 1,
    palindromes: str = "skip",
) -> DataFrame:
    """Contigs of the matrix's k-mers: contig, nb_merged, rep, rep_value, members (from the contig's start).

    Overlaps go from `longest` (default k - 1) down to `shortest` (default k // 2).
    """
    if not m.k:
        raise ValueError("merging needs a matrix of k-mers")
    longest, shortest = longest or m.k - 1, shortest or m.k // 2
    if not 1 <= shortest <= longest < m.k:
        raise ValueError("overlaps must satisfy 1 <= shortest <= longest < k")
    if rep_mode not in REP_MODES:
        raise ValueError(f"unknown representative {rep_mode!r}")
    if palindromes not in PALINDROMES:
        raise ValueError(f"unknown rule {palindromes!r}: one of {', '.join(PALINDROMES)}")
    method, threshold = intervention
    tested = method not in (None, "none")
    links: list[DataFrame] = []
    if palindromes == "skip" and longest == m.k - 1:
        joined, stretches = joined_first(m, values, rep_mode, method, threshold)
        contigs, longest = _store(joined), longest - 1
        links.append(stretches)
        coded = _store(outer_counts(m, contigs)) if tested else None
    else:
        contigs = _store(seeds(m, values))
        coded = _store(coded_counts(m)) if tested else None
    for overlap in range(longest, shortest - 1, -1):
        while True:
            found = (joints if palindromes == "skip" else oriented_joints)(contigs, overlap, m.k, m.stranded)
            edges = _store(agreeing(found, coded, method, threshold))
            if edges.isEmpty():
                break
            if palindromes == "skip":
                ranked = _ranked(edges, overlap, m.stranded)
                joined, made = contract(contigs, ranked, _representatives(contigs, ranked, m.stranded, rep_mode), overlap, m.k, len(links) + 1)
                contigs = _store(joined)
                links.append(made)
                break
            made = _store(made_joints(edges, contigs, rep_mode))
            ranked = _ranked(made, overlap, m.stranded)
            joined, parts = contract(contigs, ranked, _survivors(contigs, ranked, made), overlap, m.k, len(links) + 1)
            contigs = _store(joined)
            links.append(parts)
    out = written_out(contigs, links, m.k).select("contig", "nb_merged", seq.decode(F.col("code"), m.k).alias("rep"), "rep_value", "members")
    return out.where(F.col("nb_merged") >= min_members)


def member_counts(contigs: DataFrame, m: FeatureMatrix, how: str = "rep") -> DataFrame:
    """contig, nb_merged, rep, rep_value, members, counts: of the representative k-mer (without need of members), or the mean or median of each sample over the members."""
    if how not in ("rep", "mean", "median"):
        raise ValueError(f"unknown aggregation {how!r}")
    columns = [c for c in ("contig", "nb_merged", "rep", "rep_value", "members") if c in contigs.columns]
    head = contigs.select(*columns, seq.encode(F.col("rep"), m.k).alias("code"))
    # k-mers meet their counts as codes, not as sequences
    if how == "rep":
        vectors = coded_counts(m).join(head.select("code"), "code", "left_semi")
    else:
        members = contigs.select(seq.encode(F.col("rep"), m.k).alias("of"), F.explode("members").alias("member"))
        each = members.select("of", seq.encode(F.col("member"), m.k).alias("code")).join(coded_counts(m), "code").select(F.col("of").alias("code"), "counts")
        vectors = (medians.group_medians(each, "code", len(m.samples)) if how == "median" else medians.group_means(each, "code")).drop("n")
    return head.join(vectors, "code").select(*columns, "counts")
