"""Companion tools: building matrices from reads, comparing lists of contigs, splitting, models and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import seq, superkmers, vec
from ..functions.student_t import student_t_p
from ..matrix import FeatureMatrix
from ..storage import materialise, numbered, running_sums
from .score import IN_ONE_TASK

LIBRARY_TYPES = ("unstranded", "fr", "rf")


def library_strand(reads: DataFrame, library_type: str) -> DataFrame:
    """Reads (mate 1 or 2, seq, ...) turned to the strand that a library type stands for: rf turns mate 1, fr mate 2."""
    if library_type not in LIBRARY_TYPES:
        raise ValueError(f"unknown library type {library_type!r}: one of {', '.join(LIBRARY_TYPES)}")
    turned = {"rf": 1, "fr": 2}.get(library_type)
    return reads if turned is None else reads.withColumn("seq", F.when(F.col("mate") == turned, seq.revcomp(F.upper("seq"))).otherwise(F.col("seq")))


def count_kmers(reads: DataFrame, k: int, stranded: bool = True, least: int = 2, sample: str = "sample_idx") -> DataFrame:
    """sample, feature, cnt: k-mers of column seq by sample, of at least `least` occurrences there; stretches that share a minimiser are shuffled."""
    counted = superkmers.counted(reads, "seq", sample, k, not stranded).where(F.col("cnt") >= least)
    return counted.select(sample, seq.decode(F.col("code"), k).alias("feature"), "cnt")


def join_counts(long: DataFrame, min_recurrence: int, min_abundance: int) -> DataFrame:
    """The cells (feature, sample_idx, cnt) of features that have min_abundance or more in min_recurrence or more samples."""
    kept = long.groupBy("feature").agg(F.count_if(F.col("cnt") >= min_abundance).alias("r")).where(F.col("r") >= min_recurrence).select("feature")
    return long.join(kept, "feature", "left_semi")


def reverse_reads(reads: DataFrame) -> DataFrame:
    """FASTQ records read from the other strand: sequences reverse-complemented, qualities reversed."""
    return reads.withColumn("seq", seq.revcomp(F.col("seq"))).withColumn("qual", F.reverse("qual"))


def bad_samples(sheet: DataFrame) -> DataFrame:
    """Rows (sample, ...) of a sample sheet whose name isn't a letter followed by letters, digits and underscores."""
    return sheet.where(F.col("sample").isNull() | ~F.col("sample").rlike(r"^[A-Za-z][0-9A-Za-z_]*$"))


def select_samples(m: FeatureMatrix, wanted: list[str]) -> FeatureMatrix:
    """The columns of the list, in its order; unknown names are skipped."""
    names = [s for s in wanted if s in m.samples]
    cut = vec.pick(F.col("counts"), [m.samples.index(s) for s in names])
    return FeatureMatrix(m.df.withColumn("counts", cut), names, m.k, m.stranded, [m.nf[m.samples.index(s)] for s in names] if m.nf else [], m.feature_name)


def split_folds(sheet: DataFrame, folds: int, seed: int = 0) -> DataFrame:
    """Adds fold: the samples of each condition in a seeded order, dealt out in turn."""
    order = Window.partitionBy("condition").orderBy(F.md5(F.concat(F.col("sample"), F.lit(f":{seed}"))), "sample")
    return sheet.withColumn("fold", ((F.row_number().over(order) - 1) % folds).cast("int"))


def train_and_test(folded: DataFrame, folds: int) -> DataFrame:
    """sample, condition, split, part: every sample of split_folds once for each split, in its test part or its training part."""
    each = folded.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return each.select("sample", "condition", "split", F.when(F.col("fold") == F.col("split"), "test").otherwise("train").alias("part"))


def count_zeros(m: FeatureMatrix) -> DataFrame:
    """One row: cells, zeros."""
    return m.df.agg(F.sum(F.size("counts")).alias("cells"), F.sum(F.size(F.filter("counts", lambda x: x == 0))).alias("zeros"))


def log2_fold_change(m: FeatureMatrix, labels: list[int]) -> DataFrame:
    """feature, log2fc = log2((mean of class 1 + 1) / (mean of class 0 + 1))."""
    a, b = (vec.mean(vec.pick(F.col("counts"), [i for i, y in enumerate(labels) if y == g])) for g in (0, 1))
    return m.df.select("feature", F.log2((b + 1.0) / (a + 1.0)).alias("log2fc"))


def annotation_table(scored: DataFrame, labels: list[int], samples: list[str]) -> DataFrame:
    """Scored contigs (feature, nb_merged, rep, score, counts) as annotation wants them.

    nb_merged first, then contig, rep, score, the means of both classes, their log2 fold change, and a column for each sample.
    """
    a, b = (vec.mean(vec.pick(F.col("counts"), [i for i, y in enumerate(labels) if y == g])) for g in (0, 1))
    means = scored.withColumns({"meanA": a, "meanB": b})
    change = F.round(F.log2((F.col("meanB") + 1.0) / (F.col("meanA") + 1.0)), 6).alias("log2FC")
    return means.select("nb_merged", F.col("feature").alias("contig"), "rep", "score", "meanA", "meanB", change, *(F.get("counts", F.lit(i)).alias(s) for i, s in enumerate(samples)))


def _contig_codes(contigs: DataFrame, name: str, k: int, stranded: bool) -> DataFrame:
    """The distinct (name, kmer) of contigs (contig, seq)."""
    return seq.window_codes(contigs.select(F.col("contig").alias(name), "seq"), "seq", k, not stranded, "kmer").distinct()


HOT_KMER = 64  # contigs of one list that hold a k-mer


def _by_sets(codes: dict[str, DataFrame], how: str) -> DataFrame:
    """The same as _combinations, by sets of contigs.

    K-mers are joined and counted by the set of contigs that hold them in each list, told by the set's size and two hashes that are
    combined without order, so no set is gathered; sets become contigs at the end. A k-mer in n contigs of one list and m of another is one row until then.
    """
    joined, members = None, {}
    for name, each in codes.items():
        held = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(name)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), name)).alias("y"))
        sets = each.groupBy("kmer").agg(held.alias(f"_set_{name}"))
        members[name] = each.join(sets, "kmer").select(f"_set_{name}", name).distinct()
        joined = sets if joined is None else joined.join(sets, "kmer", how)
    out = joined.groupBy(*(f"_set_{name}" for name in codes)).agg(F.count(F.lit(1)).alias("n"))
    for name in codes:
        out = out.join(members[name], f"_set_{name}", "left" if how == "full" else "inner").drop(f"_set_{name}")
    return out.groupBy(*codes).agg(F.sum("n").alias("n"))


FEW_KMERS = 1 << 20  # of a list, that are sent to every task


def _labelled(lists: dict[str, DataFrame]) -> DataFrame:
    """key (the list's number and the contig), seq of all contigs."""
    out = None
    for i, contigs in enumerate(lists.values()):
        each = contigs.select(F.concat(F.lit(str(i)), F.coalesce(F.concat(F.lit(":"), F.col("contig").cast("string")), F.lit(""))).alias("key"), "seq")
        out = each if out is None else out.union(each)
    return out


def _by_all_sets(lists: dict[str, DataFrame], k: int, stranded: bool, how: str) -> DataFrame:
    """The same as _combinations, of large lists: all contigs' k-mers meet in buckets of their minimisers, where they are counted by the sets that hold them.

    What leaves a bucket is a row for each combination of sets, and the sets' members. One list's sets become contigs after the other's, and
    counts are added up in between.
    """
    found = materialise(superkmers.held_sets(_labelled(lists), "seq", "key", k, not stranded, len(lists), how == "full"), "held_sets")
    sets = [f"_set_{name}" for name in lists]
    out = found.where("sets is not null").select(*(F.get("sets", F.lit(i)).alias(s) for i, s in enumerate(sets)), "n").groupBy(*sets).agg(F.sum("n").alias("n"))
    for i, (name, contigs) in enumerate(lists.items()):
        members = found.where(F.col("list") == i).select(F.col("sig").alias(sets[i]), F.col("name").cast(contigs.schema["contig"].dataType).alias(name)).distinct()
        out = out.join(members, sets[i], "left" if how == "full" else "inner").groupBy(*list(lists)[: i + 1], *sets[i + 1 :]).agg(F.sum("n").alias("n"))
    return out


def _combinations(lists: dict[str, DataFrame], k: int, stranded: bool, how: str) -> DataFrame:
    """A column for each list, n: distinct k-mers of each combination of contigs, one from each list; how: inner or full (a missing contig is null).

    Where k-mers must be in all lists and the smallest list has FEW_KMERS at most, the other lists' windows are met with these first.
    """
    if how == "inner":
        least = min(lists, key=lambda name: superkmers.bases(lists[name], "seq"))
        codes = {least: materialise(_contig_codes(lists[least], least, k, stranded), "contig_codes")}
        wanted = materialise(codes[least].select("kmer").distinct(), "few_kmers")
        if wanted.count() <= FEW_KMERS:
            for name, contigs in lists.items():
                if name != least:
                    windows = seq.window_codes(contigs.select(F.col("contig").alias(name), "seq"), "seq", k, not stranded, "kmer")
                    codes[name] = materialise(windows.join(F.broadcast(wanted), "kmer", "left_semi").distinct(), "contig_codes")
            return _joined_codes({name: codes[name] for name in lists}, how)
    return _by_all_sets(lists, k, stranded, how)


def _joined_codes(codes: dict[str, DataFrame], how: str) -> DataFrame:
    """The combinations of written tables of codes. K-mers that more than HOT_KMER contigs of a list hold are counted by sets, the others joined as they are."""
    lists = list(codes)
    hot = None
    for each in codes.values():
        many = each.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_KMER).select("kmer")
        hot = many if hot is None else hot.union(many)
    hot = materialise(hot.distinct(), "hot_kmers")
    some = not hot.isEmpty()
    joined = None
    for each in codes.values():
        each = each.join(hot, "kmer", "left_anti") if some else each
        joined = each if joined is None else joined.join(each, "kmer", how)
    out = joined.groupBy(*lists).agg(F.count(F.lit(1)).alias("n"))
    if not some:
        return out
    sets = _by_sets({name: each.join(hot, "kmer", "left_semi") for name, each in codes.items()}, how)
    return out.union(sets.select(*out.columns)).groupBy(*lists).agg(F.sum("n").alias("n"))


def shared_kmers(left: DataFrame, right: DataFrame, k: int, stranded: bool = False, how: str = "inner") -> DataFrame:
    """left_contig, right_contig, n: distinct k-mers that contigs (contig, seq) of two lists share; how: inner or full."""
    return _combinations({"left_contig": left, "right_contig": right}, k, stranded, how)


def compare_contig_lists(lists: dict[str, DataFrame], k: int, stranded: bool = False, show_unique: bool = False) -> DataFrame:
    """For lists of contigs (contig, seq) by name: a column for each list, nb_kmer, nb_shared_contig.

    A row for each combination of contigs, one from each list, with the number of distinct k-mers that they share, and how many of
    the lists have one of them: show_unique also counts k-mers that some lists lack, where "-" stands for their contig.
    """
    if len(lists) < 2:
        raise ValueError("two lists at least are compared")
    found = _combinations(lists, k, stranded, "full" if show_unique else "inner")
    counted = found.select(*(F.coalesce(n, F.lit("-")).alias(n) for n in lists), F.col("n").alias("nb_kmer"))
    return counted.withColumn("nb_shared_contig", sum((F.when(F.col(n) != "-", 1).otherwise(0) for n in lists), F.lit(0)))


def signature_sharing(contigs: DataFrame, k: int, stranded: bool = False) -> DataFrame:
    """contigs (the sorted names that hold a k-mer, comma-joined), n_kmers."""
    lists = _contig_codes(contigs, "contig", k, stranded).groupBy("kmer").agg(F.array_join(F.array_sort(F.collect_set("contig")), ",").alias("contigs"))
    return lists.groupBy("contigs").agg(F.count(F.lit(1)).alias("n_kmers"))


def select_features(m: FeatureMatrix, wanted: DataFrame) -> FeatureMatrix:
    """Rows of the matrix among `wanted` (feature), each sample scaled by the mean column sum over its own; missing features raise."""
    from .index import column_sums

    sums = {r["sample_idx"]: r["total"] for r in column_sums(m).collect()}  # one row for each sample
    mean = sum(sums.values()) / len(m.samples)
    nf = [round(mean / sums[i], 6) if sums.get(i) else 0.0 for i in range(len(m.samples))]
    missing = wanted.select("feature").join(m.df.select("feature"), "feature", "left_anti").first()
    if missing:
        raise ValueError(f"feature {missing['feature']} isn't in the matrix")
    scaled = F.zip_with("counts", F.array(*(F.lit(x) for x in nf)), lambda c, f: c * f)
    return m.with_df(m.df.join(wanted.select("feature").distinct(), "feature", "left_semi").withColumn("counts", scaled))


def samples_as_rows(m: FeatureMatrix, labels: list[int]) -> DataFrame:
    """label, features (a vector) for each sample, for a matrix of few features, in the features' order."""
    from pyspark.ml.functions import array_to_vector

    cells = m.long().groupBy("sample_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "value"))), lambda s: s["value"]).alias("x"))
    label = F.get(F.array(*(F.lit(float(y)) for y in labels)), F.col("sample_idx"))
    return cells.select("sample_idx", label.alias("label"), array_to_vector("x").alias("features"))


def fit_model(rows: DataFrame, kind: str, strength: float = 0.1, runs: int = 20, seed: int = 0):
    """A pyspark.ml model of rows (label, features): lasso, elasticnet (both with stability selection over `runs` draws of
    three quarters of each class), ridge or randomforest."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    if kind == "randomforest":
        return RandomForestClassifier(seed=seed, numTrees=100).fit(rows)
    if kind == "ridge":
        return LogisticRegression(regParam=strength, elasticNetParam=0.0).fit(rows)
    from pyspark.ml.feature import VectorSlicer
    from pyspark.ml.pipeline import Pipeline

    net = LogisticRegression(regParam=strength, elasticNetParam={"lasso": 1.0, "elasticnet": 0.5}[kind])
    shares = {r["label"]: 0.75 for r in rows.select("label").distinct().collect()}  # two classes
    if len(shares) < 2:
        raise ValueError("a model needs rows of two classes")
    kept: dict[int, int] = {}
    for run in range(runs):
        drawn = rows.sampleBy("label", shares, seed=seed + run)
        # a small class may not be drawn at all
        w = net.fit(drawn if drawn.select("label").distinct().count() == len(shares) else rows).coefficients.toArray()
        for i in w.nonzero()[0]:
            kept[int(i)] = kept.get(int(i), 0) + 1
    stable = sorted(i for i, n in kept.items() if n >= runs / 2) or [0]
    return Pipeline(stages=[VectorSlicer(inputCol="features", outputCol="chosen", indices=stable), LogisticRegression(featuresCol="chosen", regParam=strength)]).fit(rows)


def fit_top_ridge(rows: DataFrame, top: int, strength: float = 0.1):
    """Ridge, then ridge again on the features with the largest absolute coefficients."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorSlicer
    from pyspark.ml.pipeline import Pipeline

    w = abs(LogisticRegression(regParam=strength).fit(rows).coefficients.toArray())
    best = sorted(w.argsort()[::-1][:top].tolist())
    return Pipeline(stages=[VectorSlicer(inputCol="features", outputCol="chosen", indices=best), LogisticRegression(featuresCol="chosen", regParam=strength)]).fit(rows)


def predict(model, rows: DataFrame) -> DataFrame:
    """sample_idx, prob_1 (the probability of label 1), pred_class for samples_as_rows under a fitted model."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).select("sample_idx", F.get(vector_to_array("probability"), F.lit(1)).alias("prob_1"), F.col("prediction").cast("int").alias("pred_class"))


def balanced_accuracy(predictions: DataFrame) -> DataFrame:
    """One row, balanced_accuracy: the mean over the labels of the share predicted right (columns label, prediction)."""
    each = predictions.groupBy("label").agg(F.avg(F.when(F.col("label") == F.col("prediction"), 1.0).otherwise(0.0)).alias("recall"))
    return each.agg(F.avg("recall").alias("balanced_accuracy"))


def roc_auc(scores: DataFrame) -> DataFrame:
    """One row, auc: the chance that a row of label 1 scores above one of label 0, ties half; from the counts of distinct scores."""
    counted = scores.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    sums = running_sums(counted, "score", ["neg"])
    wins = sums.select("pos", "neg", (F.col("pos") * (F.col("sum_neg") - F.col("neg") / 2.0)).alias("w"))
    return wins.agg((F.sum("w") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def pr_auc(scores: DataFrame) -> DataFrame:
    """One row, auc: the average precision (columns label, score), rows of equal score entering together."""
    counted = scores.groupBy((-F.col("score")).alias("down")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    sums = running_sums(counted, "down", ["pos", "n"])
    return sums.agg((F.sum(F.col("pos") * F.col("sum_pos") / F.col("sum_n")) / F.nullif(F.sum("pos"), F.lit(0))).alias("auc"))


def rank_correlation(scores: DataFrame, names: list[str]) -> DataFrame:
    """left, right, correlation: Spearman's, of each two score columns over all rows; ranks are averages over ties."""
    ranked = scores
    for name in names:
        counted = scores.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
        rank = running_sums(counted, name, ["n"]).select(F.col(name).alias("_v"), (F.col("sum_n") - (F.col("n") - 1) / 2.0).alias(f"rank_{name}"))
        ranked = ranked.join(rank, F.col(name) == F.col("_v")).drop("_v")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    sums = ranked.agg(*(F.struct(F.covar_pop(f"rank_{a}", f"rank_{b}").alias("c"), F.var_pop(f"rank_{a}").alias("v"), F.var_pop(f"rank_{b}").alias("w")).alias(f"{a}_{b}") for a, b in pairs))
    each = F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"{a}_{b}").alias("s")) for a, b in pairs))
    known = F.when(F.col("s.v") * F.col("s.w") > 0, F.col("s.c") / F.sqrt(F.when(F.col("s.v") * F.col("s.w") > 0, F.col("s.v") * F.col("s.w"))))
    return sums.select(F.explode(each).alias("e")).select("e.*").select("left", "right", known.alias("correlation"))


def top_membership(scores: DataFrame, names: list[str], top: int, key: str = "feature") -> DataFrame:
    """members (the score columns in whose top rows a key is, comma-joined), n. Large tops are numbered in ranges of the order, not gathered."""
    few = lambda n: scores.orderBy(F.desc(n), key).limit(top) if top <= IN_ONE_TASK else numbered(scores.select(key, n), [F.desc(n), F.col(key)]).where(F.col("number") < top)
    tops = [few(n).select(key, F.lit(n).alias("which")) for n in names]
    every = tops[0]
    for t in tops[1:]:
        every = every.union(t)
    sets = every.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("which")), ",").alias("members"))
    return sets.groupBy("members").agg(F.count(F.lit(1)).alias("n"))


def jaccard(a: DataFrame, b: DataFrame, key: str = "kmer") -> DataFrame:
    """One row, jaccard: distinct keys in both over distinct keys in either."""
    both = a.select(key, F.lit(1).alias("x")).union(b.select(key, F.lit(2).alias("x"))).groupBy(key).agg(F.count_distinct("x").alias("n"))
    return both.agg((F.count_if(F.col("n") == 2) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("jaccard"))


def kmer_jaccard(left: DataFrame, right: DataFrame, k: int, stranded: bool = False) -> DataFrame:
    """One row, jaccard: distinct k-mers in the sequences (column seq) of both over those of either; stretches that share a minimiser are shuffled."""
    both = left.select(F.lit("0:").alias("key"), "seq").union(right.select(F.lit("1:").alias("key"), "seq"))
    found = superkmers.held_sets(both, "seq", "key", k, not stranded, 2, True).where("sets is not null")
    shared = F.get("sets", F.lit(0)).isNotNull() & F.get("sets", F.lit(1)).isNotNull()
    return found.agg((F.sum(F.when(shared, F.col("n")).otherwise(0)) / F.nullif(F.sum("n"), F.lit(0))).alias("jaccard"))


def alignment_quality(hits: DataFrame, contigs: DataFrame) -> DataFrame:
    """One row of percentages of all contigs, to two digits: perfect, identical, complete.

    hits: alignments (qlen, qstart, qend, length, nident, pident, slen, sstart, send, qcovs). Perfect ones hold the whole
    contig without a difference; identical ones are the whole subject too; complete: the query coverage is 100.
    """
    c = F.col
    perfect = (c("qlen") == c("qend")) & (c("qstart") == 1) & (c("qlen") == c("length")) & (c("qlen") == c("nident")) & (c("pident") == 100)
    identical = perfect & (c("sstart") == 1) & (c("send") == c("slen")) & (c("slen") == c("qlen"))
    n = hits.agg(F.count_if(perfect).alias("p"), F.count_if(identical).alias("i"), F.count_if(c("qcovs") == 100).alias("q"), F.lit(1).alias("one"))
    total = contigs.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("one"))  # both sides have one row
    share = lambda x: F.round(100.0 * F.col(x) / F.nullif(F.col("n"), F.lit(0)), 2)
    return n.join(total, "one").select(share("p").alias("perfect"), share("i").alias("identical"), share("q").alias("complete"))


def pairwise_t_tests(df: DataFrame, group: str, value: str) -> DataFrame:
    """group_1, group_2, p, p_adjusted, significant: Welch's t-test of each two groups' values, Bonferroni over all pairs.

    Groups of one value, and pairs of two constant groups, have no p. Values are summed up by group before the shuffle; pairs are made of
    the groups' sums.
    """
    each = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    every = each.agg(F.array_sort(F.collect_list(F.struct("g", "n", "m", "v"))).alias("s"))
    pairs = every.select(F.explode(F.flatten(F.transform("s", lambda a, i: F.transform(F.filter("s", lambda b: b["g"] > a["g"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("x"))
    va, vb = (F.col(f"x.{k}.v") / F.col(f"x.{k}.n") for k in "ab")
    some = F.coalesce(va + vb > 0, F.lit(False))
    t = F.when(some, (F.col("x.a.m") - F.col("x.b.m")) / F.sqrt(F.when(some, va + vb)))
    df_ = F.when(some, (va + vb) * (va + vb) / F.when(some, va * va / (F.col("x.a.n") - 1) + vb * vb / (F.col("x.b.n") - 1)))
    tested = pairs.select(F.col("x.a.g").alias("group_1"), F.col("x.b.g").alias("group_2"), t.alias("t"), df_.alias("df"))
    tested = tested.withColumn("p", F.when(F.col("t").isNotNull(), student_t_p(F.col("t"), F.col("df"))))
    n = F.count("p").over(Window.partitionBy(F.lit(1)))  # a row for each pair of groups
    done = tested.withColumn("p_adjusted", F.least(F.col("p") * n, F.lit(1.0)))
    return done.select("group_1", "group_2", "p", "p_adjusted", (F.col("p_adjusted") < 0.05).alias("significant"))


def fold_summary(results: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median, min, max of a value over the folds of each."""
    return results.groupBy(*keys).agg(F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"))
