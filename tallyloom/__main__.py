"""Command line: python -m tallyloom index|filter|mask|merge|score|query ...

Every verb reads a stored matrix (index writes it) and writes a table, FASTA or Parquet selection.
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from .matrix import FeatureMatrix
from .operators import filter as filters
from .operators import index, mask, merge, score
from .sources.tables import wide


def _pair(text: str) -> tuple[float, int]:
    a, _, r = text.partition(":")
    return float(a), int(r)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyloom", description="Reduce a feature by sample count matrix.")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, text: str, *formats: str, aliases: tuple[str, ...] = ()) -> argparse.ArgumentParser:
        v = verbs.add_parser(name, help=text, aliases=list(aliases))
        v.add_argument("--out", required=True, help="output folder")
        if name != "index":
            v.add_argument("--index", required=True, help="folder that index wrote")
        if formats:
            v.add_argument("--format", choices=formats, default="tab")
            v.add_argument("--counts", choices=("int", "float"), default="int")
        return v

    v = verb("index", "store a count table, normalised if asked for")
    v.add_argument("--table", required=True)
    v.add_argument("--klen", type=int, default=0)
    v.add_argument("--unstranded", action="store_true")
    v.add_argument("--nf-base", type=float)
    v.add_argument("--nf-file")
    v = verb("filter", "by abundance and recurrence among UP and DOWN samples", "tab", "fa", "bin")
    v.add_argument("--design", required=True)
    v.add_argument("--up-min", type=_pair, default=(0, 0))
    v.add_argument("--down-max", type=_pair, default=(float("inf"), 0))
    v.add_argument("--neutral-unlisted", action="store_true")
    v.add_argument("--reverse", action="store_true")
    v = verb("mask", "select and suppress k-mers of sequences", "tab", "fa", "bin")
    v.add_argument("--select")
    v.add_argument("--suppress")
    v = verb("merge", "extend k-mers into contigs", "tab", "fa", "bin")
    v.add_argument("--overlap", default="", help="longest-shortest")
    v.add_argument("--with", dest="selection", help="a bin selection, with :min, :max, :minabs or :maxabs for its values")
    v.add_argument("--intervention", default="pearson:0.20")
    v.add_argument("--aggregate", choices=("rep", "mean", "median"), default="rep")
    v.add_argument("--min-members", type=int, default=1)
    v.add_argument("--palindromes", choices=merge.PALINDROMES, default="skip")
    v = verb("score", "score and rank features", "tab", "fa", "bin", aliases=("rank",))
    v.add_argument("--by", required=True, help="scorer, for classifiers with :folds")
    v.add_argument("--design")
    v.add_argument("--with", dest="selection", help="a bin selection, with :rep, :mean or :median for contigs' counts")
    v.add_argument("--top", type=float)
    v = verb("query", "counts of sequences", "tab")
    v.add_argument("--fasta", required=True)
    v.add_argument("--how", choices=("mean", "median"), default="mean")
    v.add_argument("--with-absent", action="store_true")
    return p


def _write(m: FeatureMatrix, extra: list[str], args: argparse.Namespace, in_order: bool = True) -> None:
    """tab: a column for each sample, in the order of the input where that is known and asked for; fa: sequences; bin: the rows as Parquet for another verb's --with."""
    if args.format == "bin":
        m.df.write.parquet(args.out)
    elif args.format == "fa":
        sources.write_fasta(m.df, args.out, "feature", "score" if "score" in extra else None)
    else:
        m = m.with_df(m.df.orderBy("ordinal")) if in_order and "ordinal" in m.df.columns else m
        wide(m, args.counts == "int", *extra).write.option("sep", "\t").option("header", True).csv(args.out)


def _contig_columns(m: FeatureMatrix, df: DataFrame, has_value: bool) -> tuple[FeatureMatrix, list]:
    """A matrix of contigs (column feature) to be written under the headings contig, nb-merged-kmer, rep-value and the k-mers' own."""
    value = [F.col("rep_value").alias("rep-value")] if has_value else []
    return replace(m, df=df, feature_name="contig"), [F.col("nb_merged").alias("nb-merged-kmer"), *value, F.col("rep").alias(m.feature_name)]


def _selection(spark: SparkSession, text: str | None, default: str) -> tuple[DataFrame | None, str]:
    if not text:
        return None, default
    path, _, mode = text.rpartition(":") if text.rsplit(":", 1)[-1] in (*merge.REP_MODES, "rep", "mean", "median") else (text, "", default)
    return spark.read.parquet(path), mode


def _restricted(m: FeatureMatrix, selection: DataFrame, how: str) -> FeatureMatrix:
    """The matrix of a selection: its features, or its contigs with counts of their members, and what else is known of them."""
    if "members" in selection.columns:
        contigs = selection if "contig" in selection.columns else selection.withColumnRenamed("feature", "contig")
        return m.with_df(merge.member_counts(contigs, m, how).withColumnRenamed("contig", "feature"))
    return m.with_df(m.df.join(selection.select("feature"), "feature", "left_semi"))


def run(spark: SparkSession, argv: list[str]) -> None:
    args = parser().parse_args(argv)
    if args.verb == "index":
        m = sources.read_counts(spark, args.table)
        if args.klen:
            m = index.index_sequences(m, args.klen, not args.unstranded)
        elif args.unstranded:
            raise SystemExit("--unstranded needs --klen")
        if args.nf_file:
            m = index.normalise(m, sources.normalisation_factors(spark, args.nf_file, m.samples), True)
        elif args.nf_base:
            m = index.normalise(m, index.compute_nf(m, args.nf_base), True)
        sources.write_index(m, args.out)
        return
    m = sources.read_index(spark, args.index)
    if args.verb == "filter":
        _write(filters.filter_features(m, sources.up_down_design(spark, args.design, m.samples, args.neutral_unlisted), args.up_min, args.down_max, args.reverse), [], args)
    elif args.verb == "mask":
        read = lambda p: sources.read_fasta(spark, p) if p else None
        _write(mask.mask(m, read(args.select), read(args.suppress)), [], args)
    elif args.verb == "merge":
        longest, _, shortest = args.overlap.partition("-")
        method, _, limit = args.intervention.partition(":")
        chosen, mode = _selection(spark, args.selection, "min")
        value = F.col("score") if chosen is not None and "score" in chosen.columns else F.lit(0.0)
        scored = chosen is not None and "score" in chosen.columns
        if args.format == "bin" and scored:
            raise SystemExit("a bin selection can't be written from scored input: merge first, then score")
        values = None if chosen is None else chosen.select("feature", value.alias("value"), *(["members"] if "members" in chosen.columns else []))
        contigs = merge.merge(m, values, int(longest or 0) or None, int(shortest or 0) or None, (method, float(limit or 0)), mode, palindromes=args.palindromes)
        enough = F.col("nb_merged") >= args.min_members
        if args.format == "bin":
            contigs.where(enough).write.parquet(args.out)
        elif args.format == "fa":
            # numbers count the contigs that are left out, too
            numbered = sources.in_input_order(contigs.select(F.col("rep").alias("feature"), "contig", "nb_merged"))
            sources.write_fasta(numbered.where(enough).select("number", F.col("contig").alias("feature")), args.out, "ctg")
        else:
            counted = merge.member_counts(contigs.where(enough), m, args.aggregate).withColumnRenamed("contig", "feature")
            out, extra = _contig_columns(m, counted, scored)
            _write(out, extra, args)
    elif args.verb in ("score", "rank"):
        chosen, how = _selection(spark, args.selection, "rep")
        m = m if chosen is None else _restricted(m, chosen, how)
        by, _, folds = args.by.partition(":")
        needs = {"labels": sources.label_design(spark, args.design, m.samples)} if args.design and by not in ("pearson", "spearman") else {"target": sources.continuous_design(spark, args.design, m.samples)} if args.design else {}
        best = score.select_top(score.score(m, by, folds=int(folds or 1), **needs), by, args.top)
        if "rep" in best.columns and args.format == "tab":
            out, extra = _contig_columns(m, best, False)
            _write(out, [*extra, "score"], args)
        else:
            _write(m.with_df(best), ["score"], args, chosen is not None)
    else:
        found = mask.query(m, sources.read_fasta(spark, args.fasta), args.how, args.with_absent)
        _write(m.with_df(found.select(F.col("name").alias("feature"), "counts")), [], args)


def main() -> None:
    import sys

    parser().parse_args(sys.argv[1:])
    spark = SparkSession.builder.appName("tallyloom").getOrCreate()
    try:
        run(spark, sys.argv[1:])
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
