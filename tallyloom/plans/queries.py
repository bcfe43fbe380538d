"""One query for each operator, with the SQL that gives the same rows.

Doubles are rounded to six digits in both. Queries without SQL (iterative merging, fitted classifiers) are tested
against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq, vec
from ..matrix import FeatureMatrix
from ..operators import filter as filters
from ..operators import index, mask, merge, models, score, tools
from ..storage import materialise
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rows(m: FeatureMatrix) -> DataFrame:
    """The matrix as feature, sample_idx, value."""
    return m.long().select("feature", "sample_idx", r6("value").alias("value"))


def stored(m: FeatureMatrix) -> FeatureMatrix:
    """The matrix from a written table, as the verbs read it from an index: for what goes through it more than once."""
    return m.with_df(materialise(m.df, "matrix"))


P, U, K = fx.PARTS_SQL, fx.USERS_SQL, fx.kmers_sql()
ALL = "SELECT feature, sample_idx, round(x, 6) + 0.0 AS value FROM d"

# --- index ---

NF = "nf AS (SELECT sample_idx, 1e6 / sum(x) nf FROM d GROUP BY 1)"


@register("index_nf", f"WITH {P}, {NF} SELECT sample_idx, round(nf, 6) + 0.0 AS nf FROM nf")
def index_nf(spark, d):
    return index.factors(fx.parts(spark, d), 1e6).select("sample_idx", r6("nf").alias("nf"))


@register("index_normalize", f"WITH {P}, {NF} SELECT feature, sample_idx, round(x * nf, 6) + 0.0 AS value FROM d JOIN nf USING (sample_idx)")
def index_normalize(spark, d):
    m = stored(fx.parts(spark, d))
    return rows(index.normalise(m, index.compute_nf(m, 1e6)))


CODE = "CAST(list_sum(list_transform(range(1, 14), lambda i: (instr('ACGT', substr(feature, CAST(i AS int), 1)) - 1) * CAST(power(4, 13 - i) AS bigint))) AS bigint)"


@register("index_encode", f"WITH {K} SELECT DISTINCT feature, {CODE} AS code, feature AS decoded FROM g")
def index_encode(spark, d):
    coded = fx.kmers(spark, d).df.select("feature", seq.encode(F.col("feature"), 13).alias("code"))
    return coded.withColumn("decoded", seq.decode(F.col("code"), 13))


@register("index_canonical", f"WITH {fx.kmers_sql(13, True)} SELECT DISTINCT feature, least(feature, translate(reverse(feature), 'ACGT', 'TGCA')) AS canonical FROM g")
def index_canonical(spark, d):
    return fx.kmers(spark, d, 13, True).df.select("feature", seq.canonical(F.col("feature")).alias("canonical"))


@register("index_unique_check", f"WITH {fx.kmers_sql(13, True)}, c AS (SELECT DISTINCT feature, least(feature, translate(reverse(feature), 'ACGT', 'TGCA')) c FROM g) SELECT c AS feature, count(*) AS n FROM c GROUP BY 1 HAVING count(*) > 1")
def index_unique_check(spark, d):
    m = fx.kmers(spark, d, 13, True)
    return index.repeated(m.with_df(m.df.withColumn("feature", seq.canonical(F.col("feature")))))


# --- filter ---

UP, DOWN = (20.0, 5), (40.0, 6)


def keeps(up: str = "sample_idx >= 10", down: str = "sample_idx < 10") -> str:
    return f"k AS (SELECT feature FROM d GROUP BY 1 HAVING count(*) FILTER (WHERE {up} AND x >= 20) >= 5 AND count(*) FILTER (WHERE {down} AND x <= 40) >= 6)"


@register("filter_up_down", f"WITH {P}, {keeps()} {ALL} WHERE feature IN (SELECT feature FROM k)")
def filter_up_down(spark, d):
    return rows(filters.filter_features(fx.parts(spark, d), fx.STATUS, UP, DOWN))


@register("filter_reverse", f"WITH {P}, {keeps()} {ALL} WHERE feature NOT IN (SELECT feature FROM k)")
def filter_reverse(spark, d):
    return rows(filters.filter_features(fx.parts(spark, d), fx.STATUS, UP, DOWN, reverse=True))


@register("filter_neutral", f"WITH {P}, {keeps(down='sample_idx BETWEEN 2 AND 9')} {ALL} WHERE feature IN (SELECT feature FROM k)")
def filter_neutral(spark, d):
    return rows(filters.filter_features(fx.parts(spark, d), [None, None, *fx.STATUS[2:]], UP, DOWN))


@register("round_int", f"WITH {P}, {NF} SELECT feature, sample_idx, CAST(floor(x * nf + 0.5) AS bigint) AS value FROM d JOIN nf USING (sample_idx)")
def round_int(spark, d):
    m = stored(fx.parts(spark, d))
    n = index.normalise(m, index.compute_nf(m, 1e6))
    return n.df.select("feature", F.posexplode(vec.half_up(F.col("counts"))).alias("sample_idx", "value"))


# --- mask and query ---

SEL, SUP = fx.mask_sql("sel", "benchmark", 13), fx.mask_sql("sup", "conversations", 13)


def _masked(spark, d, select: bool, suppress: bool) -> DataFrame:
    return rows(
        mask.mask(
            fx.kmers(spark, d),
            fx.sequences(spark, d, "benchmark", "item_id") if select else None,
            fx.sequences(spark, d, "conversations", "conv_id") if suppress else None,
        )
    )


@register("mask_select", f"WITH {K}, {SEL} {ALL} WHERE feature IN (SELECT feature FROM sel)")
def mask_select(spark, d):
    return _masked(spark, d, True, False)


@register("mask_suppress", f"WITH {K}, {SUP} {ALL} WHERE feature NOT IN (SELECT feature FROM sup)")
def mask_suppress(spark, d):
    return _masked(spark, d, False, True)


@register("mask_both", f"WITH {K}, {SEL}, {SUP} {ALL} WHERE feature IN (SELECT feature FROM sel) AND feature NOT IN (SELECT feature FROM sup)")
def mask_both(spark, d):
    return _masked(spark, d, True, True)


def query_sql(agg: str, absent: bool = False, stranded: bool = False) -> str:
    known = f"r AS (SELECT name, sample_idx, {agg}(x) v FROM qw JOIN d USING (feature) GROUP BY 1, 2)"
    head = f"WITH {fx.kmers_sql(13, stranded)}, {fx.QUERY_SQL}, qw AS ({fx.windows_sql('q', 13, 'name', not stranded)}), {known} "
    if absent:
        return head + f"SELECT q.name, CAST(s.i AS int) AS sample_idx, round(coalesce(r.v, 0.0), 6) + 0.0 AS value FROM q CROSS JOIN range({fx.N}) s(i) LEFT JOIN r ON r.name = q.name AND r.sample_idx = s.i"
    return head + "SELECT name, sample_idx, round(v, 6) + 0.0 AS value FROM r"


def _queried(m: FeatureMatrix, spark, d, how: str, absent: bool = False) -> DataFrame:
    found = mask.query(m, fx.query_sequences(spark, d), how, absent)
    return found.select("name", F.posexplode("counts").alias("sample_idx", "value")).withColumn("value", r6("value"))


@register("query_mean", query_sql("avg"))
def query_mean(spark, d):
    return _queried(fx.kmers(spark, d), spark, d, "mean")


@register("query_median", query_sql("median"))
def query_median(spark, d):
    return _queried(fx.kmers(spark, d), spark, d, "median")


@register("query_withabsent", query_sql("avg", absent=True))
def query_withabsent(spark, d):
    return _queried(fx.kmers(spark, d), spark, d, "mean", True)


@register("query_stranded", query_sql("avg", stranded=True))
def query_stranded(spark, d):
    return _queried(fx.kmers(spark, d, 13, True), spark, d, "mean")


# --- score ---


def _scored(m: FeatureMatrix, by: str, **more) -> DataFrame:
    return score.score(m, by, **more).select("feature", r6("score").alias("score"))


def score_sql(source: str, expression: str) -> str:
    return f"WITH {source} SELECT feature, round({expression}, 6) + 0.0 AS score FROM d GROUP BY feature"


A, B = "FILTER (WHERE sample_idx < 10)", "FILTER (WHERE sample_idx >= 10)"
SNR = f"CASE WHEN stddev_samp(x) {A} + stddev_samp(x) {B} = 0 THEN 0 ELSE (avg(x) {A} - avg(x) {B}) / (stddev_samp(x) {A} + stddev_samp(x) {B}) END"


@register("score_snr", score_sql(P, SNR))
def score_snr(spark, d):
    return _scored(fx.parts(spark, d), "snr", labels=fx.LABELS)


TOPS = "t AS (SELECT feature, sample_idx % 3 g, max(x) top FROM d GROUP BY 1, 2)"


@register("score_dids", f"WITH {P}, {TOPS}, s AS (SELECT d.feature, g, sum(CASE WHEN sample_idx % 3 <> g AND x > top THEN sqrt(x - top) ELSE 0 END) v FROM d JOIN t ON d.feature = t.feature GROUP BY 1, 2) SELECT feature, round(max(v), 6) + 0.0 AS score FROM s GROUP BY 1")
def score_dids(spark, d):
    return _scored(fx.parts(spark, d), "dids", labels=fx.THREE)


SD = "stddev_samp(x)"
SINGLE = {
    "sd": SD,
    "rsd1": f"CASE WHEN avg(x) <= 1 THEN {SD} ELSE {SD} / avg(x) END",
    "rsd2": f"CASE WHEN min(x) <= 1 THEN {SD} ELSE {SD} / min(x) END",
    "rsd3": f"CASE WHEN median(x) <= 1 THEN {SD} ELSE {SD} / median(x) END",
    "entropy": "CASE WHEN sum(x) > 0 THEN -(sum((x + 1) * log2(x + 1)) - log2(sum(x)) * (sum(x) + count(*))) / sum(x) END",
}


def _single(by: str) -> Query:
    return lambda spark, d: _scored(fx.users(spark, d), by)


for _by, _expression in SINGLE.items():
    register(f"score_{_by}", score_sql(U, _expression))(_single(_by))
register("score_entropy_exact", f"WITH {U}, t AS (SELECT feature, sum(x + 1) t FROM d GROUP BY 1) SELECT feature, round(-sum((x + 1) / t * log2((x + 1) / t)), 6) + 0.0 AS score FROM d JOIN t USING (feature) GROUP BY 1")(_single("entropy_exact"))

DAY_VALUES = [53.5 + (i * 37) % 101 for i in range(fx.DAYS)]
Y = "y AS (SELECT *, CAST(53.5 + (sample_idx * 37) % 101 AS double) y FROM d)"
RANKS = "(rank() OVER (PARTITION BY feature ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY feature, {c}) - 1) / 2.0)"
CORR = "CASE WHEN var_pop({a}) = 0 OR var_pop({b}) = 0 THEN 0 ELSE covar_pop({a}, {b}) / sqrt(var_pop({a}) * var_pop({b})) END"


@register("score_pearson", f"WITH {U}, {Y} SELECT feature, round({CORR.format(a='x', b='y')}, 6) + 0.0 AS score FROM y GROUP BY 1")
def score_pearson(spark, d):
    return _scored(fx.users(spark, d), "pearson", target=DAY_VALUES)


@register("score_spearman", f"WITH {U}, {Y}, r AS (SELECT feature, {RANKS.format(c='x')} x, {RANKS.format(c='y')} y FROM y) SELECT feature, round({CORR.format(a='x', b='y')}, 6) + 0.0 AS score FROM r GROUP BY 1")
def score_spearman(spark, d):
    return _scored(fx.users(spark, d), "spearman", target=DAY_VALUES)


# the tail of Student's t by Simpson's rule on cos(u)^(df - 1), u from atan(|t| / sqrt(df)) to pi / 2
WELCH = f"""w AS (SELECT feature, avg(log2(x + 1)) {A} ma, avg(log2(x + 1)) {B} mb, var_samp(log2(x + 1)) {A} / 10 va, var_samp(log2(x + 1)) {B} / 10 vb FROM d GROUP BY 1),
t AS (SELECT feature, abs(mb - ma) diff, va + vb v, CASE WHEN va + vb > 0 THEN (ma - mb) / sqrt(va + vb) END t, CASE WHEN va + vb > 0 THEN (va + vb) * (va + vb) / (va * va / 9 + vb * vb / 9) END df FROM w),
a AS (SELECT feature, df, atan(abs(t) / sqrt(df)) lo, pi() / 2 - atan(abs(t) / sqrt(df)) span FROM t WHERE t IS NOT NULL),
q AS (SELECT feature, df, sum((CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * power(greatest(cos(lo + span * i / 1000), 0), df - 1)) * any_value(span) / 3000 area FROM a CROSS JOIN range(1001) s(i) GROUP BY 1, 2),
p AS (SELECT t.feature, diff, CASE WHEN t IS NULL THEN 1.0 WHEN t = 0 THEN 1.0 ELSE least(1.0, 2 * exp(lgamma((t.df + 1) / 2) - lgamma(t.df / 2)) / sqrt(pi()) * area) END p FROM t LEFT JOIN q USING (feature))"""
ADJUST = "r AS (SELECT feature, p, row_number() OVER (ORDER BY p) rn, count(*) OVER () m FROM p), b AS (SELECT feature, p, p * {factor} v, rn FROM r), z AS (SELECT feature, p, min(v) OVER (ORDER BY rn DESC) s FROM b), o AS (SELECT feature, p, min(s) OVER (PARTITION BY p) s FROM z)"
VARIANT, STANDARD = "(CASE WHEN rn < m THEN m / (rn + 1.0) ELSE 1 END)", "(m / CAST(rn AS double))"


@register("score_ttest_padj", f"WITH {P}, {WELCH}, {ADJUST.format(factor=VARIANT)} SELECT feature, round(s, 6) + 0.0 AS score FROM o")
def score_ttest_padj(spark, d):
    return _scored(fx.parts(spark, d), "ttest.padj", labels=fx.LABELS)


@register("score_ttest_pi", f"WITH {P}, {WELCH} SELECT feature, round(-log10(p) * diff, 6) + 0.0 AS score FROM p")
def score_ttest_pi(spark, d):
    return _scored(fx.parts(spark, d), "ttest.pi", labels=fx.LABELS)


def _adjusted(spark, d, standard: bool) -> DataFrame:
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("feature"), ((F.col("p_retailprice").cast("double") % 1000 + 0.5) / 1001).alias("p"))
    return score.adjust(p, "p", standard).select("feature", r6("p_adjusted").alias("p_adjusted"))


PART_P = "p AS (SELECT p_partkey feature, (CAST(p_retailprice AS double) % 1000 + 0.5) / 1001 p FROM part)"


@register("bh_adjust", f"WITH {PART_P}, {ADJUST.format(factor=VARIANT)} SELECT feature, round(s, 6) + 0.0 AS p_adjusted FROM o")
def bh_adjust(spark, d):
    return _adjusted(spark, d, False)


@register("bh_standard", f"WITH {PART_P}, {ADJUST.format(factor=STANDARD)} SELECT feature, round(least(s, 1.0), 6) + 0.0 AS p_adjusted FROM o")
def bh_standard(spark, d):
    return _adjusted(spark, d, True)


BAYES = """c AS (SELECT feature, avg(x) m, stddev_samp(x) s FROM d GROUP BY 1),
z AS (SELECT d.feature, sample_idx, CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END z, CAST(sample_idx >= 10 AS int) y FROM d JOIN c USING (feature)),
e AS (SELECT feature, y g, avg(z) m, var_samp(z) + 1e-10 v FROM z GROUP BY 1, 2),
l AS (SELECT z.feature, sample_idx, y, g, ln(0.5) - 0.5 * ln(2 * pi() * v) - (z - m) * (z - m) / (2 * v) ll FROM z JOIN e ON z.feature = e.feature),
b AS (SELECT feature, sample_idx, any_value(y) y, max(ll) FILTER (WHERE g = 0) l0, max(ll) FILTER (WHERE g = 1) l1 FROM l GROUP BY 1, 2)
SELECT feature, round(avg(CASE WHEN CAST(l1 > l0 AS int) = y THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS score FROM b GROUP BY 1"""


@register("score_bayes", f"WITH {P}, {BAYES}")
def score_bayes(spark, d):
    return _scored(fx.parts(spark, d), "bayes", labels=fx.LABELS)


@register("score_lr")
def score_lr(spark, d):
    return _scored(fx.parts(spark, d), "lr", labels=fx.LABELS, folds=5)


@register("score_svm")
def score_svm(spark, d):
    return _scored(fx.parts(spark, d), "svm", labels=fx.THREE, folds=5)


@register("seltop_count", f"WITH {P}, s AS (SELECT feature, {SNR} s FROM d GROUP BY 1) SELECT feature, round(s, 6) + 0.0 AS score FROM s ORDER BY round(abs(s), 9) DESC, feature LIMIT 50")
def seltop_count(spark, d):
    ranked = score.score(fx.parts(spark, d), "snr", labels=fx.LABELS).withColumn("score", F.round("score", 9))
    return score.select_top(ranked, "snr", 50).select("feature", r6("score").alias("score"))


@register("seltop_ratio", f"WITH {P}, s AS (SELECT feature, {SD} s, count(*) OVER () n FROM d GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY round(s, 9) DESC, feature) rn FROM s) SELECT feature, round(s, 6) + 0.0 AS score FROM r WHERE rn <= floor(n * 0.1 + 0.5)")
def seltop_ratio(spark, d):
    ranked = score.score(fx.parts(spark, d), "sd").withColumn("score", F.round("score", 9))
    return score.select_top(ranked, "sd", 0.1).select("feature", r6("score").alias("score"))


# --- distances: each part against the next one by number ---

NEXT = "n AS (SELECT a.feature, a.sample_idx, a.x, b.x y FROM d a JOIN d b ON b.feature = concat('P', CAST(CAST(substr(a.feature, 2) AS bigint) + 1 AS varchar)) AND a.sample_idx = b.sample_idx)"


def _neighbours(spark, d, method: str) -> DataFrame:
    m = fx.parts(spark, d).df
    nxt = m.select(F.concat(F.lit("P"), (F.substring("feature", 2, 20).cast("long") - 1).cast("string")).alias("feature"), F.col("counts").alias("next"))
    return m.join(nxt, "feature").select("feature", r6(vec.DISTANCES[method](F.col("counts"), F.col("next"))).alias("distance"))


@register("dist_pearson", f"WITH {P}, {NEXT} SELECT feature, round(0.5 * (1 - ({CORR.format(a='x', b='y')})), 6) + 0.0 AS distance FROM n GROUP BY 1")
def dist_pearson(spark, d):
    return _neighbours(spark, d, "pearson")


@register("dist_spearman", f"WITH {P}, {NEXT}, r AS (SELECT feature, {RANKS.format(c='x')} x, {RANKS.format(c='y')} y FROM n) SELECT feature, round(0.5 * (1 - ({CORR.format(a='x', b='y')})), 6) + 0.0 AS distance FROM r GROUP BY 1")
def dist_spearman(spark, d):
    return _neighbours(spark, d, "spearman")


@register("dist_mac", f"WITH {P}, {NEXT} SELECT feature, round(avg(CASE WHEN x = y THEN 0 ELSE abs(x - y) / (x + y) END), 6) + 0.0 AS distance FROM n GROUP BY 1")
def dist_mac(spark, d):
    return _neighbours(spark, d, "mac")


# --- merge ---


def joints_sql(stranded: bool, overlap: int = 30) -> str:
    rc = "translate(reverse(e), 'ACGT', 'TGCA')"
    ends = f"e AS (SELECT feature, substr(feature, 1, {overlap}) e, true is_pre FROM g GROUP BY 1 UNION ALL SELECT feature, substr(feature, {32 - overlap}, {overlap}), false FROM g GROUP BY 1)"
    each = "c AS (SELECT feature, e knot, false rc, is_pre FROM e)" if stranded else f"c AS (SELECT feature, least(e, {rc}) knot, {rc} < e rc, is_pre FROM e WHERE e <> {rc})"
    knots = "k AS (SELECT knot, count(*) FILTER (WHERE is_pre = rc) np, count(*) FILTER (WHERE is_pre <> rc) ns, max(feature) FILTER (WHERE is_pre = rc) p, max(feature) FILTER (WHERE is_pre <> rc) s, bool_or(rc) FILTER (WHERE is_pre = rc) prc, bool_or(rc) FILTER (WHERE is_pre <> rc) src FROM c GROUP BY 1)"
    return f"{fx.kmers_sql(31, stranded)}, {ends}, {each}, {knots}, j AS (SELECT p pred, NOT prc pred_fwd, s succ, NOT src succ_fwd FROM k WHERE np = 1 AND ns = 1 AND p <> s)"


def _joints(spark, d, stranded: bool, method: str | None = None) -> DataFrame:
    m = stored(fx.kmers(spark, d, 31, stranded))
    edges = merge.agreeing(merge.joints(merge.seeds(m), 30, 31, stranded), merge.coded_counts(m), method, 0.2)
    kmer = lambda c: seq.decode(F.col(c), 31).alias(c)
    return edges.select(kmer("pred"), "pred_fwd", kmer("succ"), "succ_fwd")


@register("merge_edges_stranded", f"WITH {joints_sql(True)} SELECT * FROM j")
def merge_edges_stranded(spark, d):
    return _joints(spark, d, True)


@register("merge_edges_unstranded", f"WITH {joints_sql(False)} SELECT * FROM j")
def merge_edges_unstranded(spark, d):
    return _joints(spark, d, False)


AGREE = "v AS (SELECT pred, succ, {v} v FROM j JOIN d a ON a.feature = pred JOIN d b ON b.feature = succ AND a.sample_idx = b.sample_idx GROUP BY 1, 2) SELECT j.* FROM j JOIN v USING (pred, succ) WHERE v < 0.2"


@register("merge_edges_pearson", f"WITH {joints_sql(False)}, " + AGREE.format(v=f"0.5 * (1 - ({CORR.format(a='a.x', b='b.x')}))"))
def merge_edges_pearson(spark, d):
    return _joints(spark, d, False, "pearson")


@register("merge_edges_mac", f"WITH {joints_sql(False)}, " + AGREE.format(v="avg(CASE WHEN a.x = b.x THEN 0 ELSE abs(a.x - b.x) / (a.x + b.x) END)"))
def merge_edges_mac(spark, d):
    return _joints(spark, d, False, "mac")


RANKED_CELLS = f"rk AS (SELECT feature, sample_idx, {RANKS.format(c='x')} x FROM d)"
RANKS_AGREE = f"z AS (SELECT pred, succ, 0.5 * (1 - ({CORR.format(a='a.x', b='b.x')})) v FROM j JOIN rk a ON a.feature = pred JOIN rk b ON b.feature = succ AND a.sample_idx = b.sample_idx GROUP BY 1, 2) SELECT j.* FROM j JOIN z USING (pred, succ) WHERE v < 0.2"


@register("merge_edges_spearman", f"WITH {joints_sql(False)}, {RANKED_CELLS}, {RANKS_AGREE}")
def merge_edges_spearman(spark, d):
    return _joints(spark, d, False, "spearman")


def _contigs(spark, d, members=False, **more) -> tuple[DataFrame, FeatureMatrix]:
    """Contigs over the operator's own overlaps, 30 to 15."""
    m = stored(fx.kmers(spark, d, 31))
    contigs = merge.merge(m, **more)
    return materialise(contigs if members else contigs.drop("members"), "contigs"), m


def _counted(how: str) -> Query:
    def run(spark, d):
        contigs, m = _contigs(spark, d, how != "rep")
        return merge.member_counts(contigs, m, how).select("contig", "nb_merged", "rep", F.posexplode("counts").alias("sample_idx", "value")).withColumn("value", r6("value"))

    return run


@register("merge_contigs")
def merge_contigs(spark, d):
    return _contigs(spark, d, intervention=(None, 0.0))[0]


for _how in ("rep", "mean", "median"):
    register(f"merge_counts_{_how}")(_counted(_how))


@register("merge_min_members")
def merge_min_members(spark, d):
    return _contigs(spark, d, min_members=3)[0]


@register("merge_scored_maxabs")
def merge_scored_maxabs(spark, d):
    """Score, then merge with the score as representative value."""
    m = stored(fx.kmers(spark, d, 31))
    values = score.score(m, "sd").select("feature", F.col("score").alias("value"))
    return merge.merge(m, values, rep_mode="maxabs").select("contig", "nb_merged", "rep", r6("rep_value").alias("rep_value"))


# --- tools ---

CELLS = f"src AS (SELECT CAST(substr(source, 4) AS int) sample_idx, {fx.dna_sql()} dna FROM documents), w AS ({fx.windows_sql('src', 13, 'sample_idx')}), l AS (SELECT sample_idx, feature, count(*) cnt FROM w GROUP BY 1, 2)"


def _cells(spark, d, least: int) -> DataFrame:
    return tools.count_kmers(fx.reads(spark, d), 13, stranded=False, least=least)


@register("tool_kmer_count", f"WITH {CELLS} SELECT sample_idx, feature, cnt FROM l WHERE cnt >= 2")
def tool_kmer_count(spark, d):
    return _cells(spark, d, 2)


@register("tool_join_counts", f"WITH {CELLS}, r AS (SELECT feature FROM l GROUP BY 1 HAVING count(*) FILTER (WHERE cnt >= 2) >= 3) SELECT sample_idx, feature, cnt FROM l WHERE feature IN (SELECT feature FROM r)")
def tool_join_counts(spark, d):
    return tools.join_counts(_cells(spark, d, 1), 3, 2).select("sample_idx", "feature", "cnt")


@register("tool_select_columns", f"WITH {P} SELECT feature, CASE sample_idx WHEN 7 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS sample_idx, x AS value FROM d WHERE sample_idx IN (7, 3, 12)")
def tool_select_columns(spark, d):
    return rows(tools.select_samples(fx.parts(spark, d), ["S07", "nobody", "S03", "S12"]))


@register("tool_split_cv", "SELECT sample, condition, CAST((row_number() OVER (PARTITION BY condition ORDER BY md5(concat(sample, ':7')), sample) - 1) % 5 AS int) AS fold FROM (SELECT CAST(c_custkey AS varchar) sample, c_mktsegment AS condition FROM customer)")
def tool_split_cv(spark, d):
    sheet = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("sample"), F.col("c_mktsegment").alias("condition"))
    return tools.split_folds(sheet, 5, 7)


@register("tool_sample_sheet", "SELECT sample, condition FROM (SELECT c_name sample, c_mktsegment AS condition FROM customer UNION ALL SELECT p_name, p_brand FROM part UNION ALL SELECT replace(c_name, '#', '_'), 'renamed' FROM customer) WHERE NOT (substr(sample, 1, 1) BETWEEN 'A' AND 'Z' OR substr(sample, 1, 1) BETWEEN 'a' AND 'z') OR length(translate(sample, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_', '')) > 0")
def tool_sample_sheet(spark, d):
    customer = fx.table(spark, d, "customer")
    names = customer.select(F.col("c_name").alias("sample"), F.col("c_mktsegment").alias("condition"))
    more = fx.table(spark, d, "part").select(F.col("p_name").alias("sample"), F.col("p_brand").alias("condition"))
    return tools.bad_samples(names.union(more).union(customer.select(F.replace("c_name", F.lit("#"), F.lit("_")), F.lit("renamed"))))


SPLIT = "f AS (SELECT sample, condition, (row_number() OVER (PARTITION BY condition ORDER BY md5(concat(sample, ':7')), sample) - 1) % 5 AS fold FROM (SELECT CAST(c_custkey AS varchar) sample, c_mktsegment AS condition FROM customer))"


@register("tool_train_test", f"WITH {SPLIT} SELECT sample, condition, CAST(i AS int) AS split, CASE WHEN fold = i THEN 'test' ELSE 'train' END AS part FROM f CROSS JOIN range(5) s(i)")
def tool_train_test(spark, d):
    return tools.train_and_test(tool_split_cv(spark, d), 5)


@register("tool_zero_count", f"WITH {P} SELECT count(*) AS cells, count(*) FILTER (WHERE x = 0) AS zeros FROM d")
def tool_zero_count(spark, d):
    return tools.count_zeros(fx.parts(spark, d))


@register("tool_log2fc", f"WITH {P} SELECT feature, round(log2((avg(x) {B} + 1) / (avg(x) {A} + 1)), 6) + 0.0 AS log2fc FROM d GROUP BY 1")
def tool_log2fc(spark, d):
    return tools.log2_fold_change(fx.parts(spark, d), fx.LABELS).select("feature", r6("log2fc").alias("log2fc"))


ANNOTATED = f"a AS (SELECT feature, avg(x) {A} meanA, avg(x) {B} meanB, {SNR} score, " + ", ".join(f"max(x) FILTER (WHERE sample_idx = {i}) S{i:02d}" for i in range(3)) + " FROM d GROUP BY 1)"


@register("tool_annotation", f"WITH {P}, {ANNOTATED} SELECT 1 AS nb_merged, feature AS contig, feature AS rep, round(score, 6) + 0.0 AS score, round(meanA, 6) + 0.0 AS \"meanA\", round(meanB, 6) + 0.0 AS \"meanB\", round(log2((meanB + 1) / (meanA + 1)), 6) + 0.0 AS \"log2FC\", S00, S01, S02 FROM a")
def tool_annotation(spark, d):
    scored = score.score(fx.parts(spark, d), "snr", labels=fx.LABELS).select("feature", F.lit(1).alias("nb_merged"), F.col("feature").alias("rep"), "score", "counts")
    return tools.annotation_table(scored, fx.LABELS, fx.names(3)).withColumns({c: r6(c) for c in ("score", "meanA", "meanB", "log2FC")})


def contigs_sql(name: str, source: str, key: str) -> str:
    return f"{name}_src AS (SELECT CAST({key} AS varchar) contig, {fx.dna_sql()} dna FROM {source}), {name} AS (SELECT DISTINCT contig, feature kmer FROM ({fx.windows_sql(f'{name}_src', 31, 'contig')}))"


def _contig_list(spark, d, name: str, key: str) -> DataFrame:
    return fx.sequences(spark, d, name, key).withColumnRenamed("name", "contig")


@register("tool_contig_compare", f"WITH {contigs_sql('a', 'benchmark', 'item_id')}, {contigs_sql('b', 'documents', 'doc_id')} SELECT a.contig AS left_contig, b.contig AS right_contig, count(*) AS n FROM a JOIN b USING (kmer) GROUP BY 1, 2")
def tool_contig_compare(spark, d):
    return tools.shared_kmers(_contig_list(spark, d, "benchmark", "item_id"), _contig_list(spark, d, "documents", "doc_id"), 31)


@register("tool_contig_compare_full", f"WITH {contigs_sql('a', 'benchmark', 'item_id')}, {contigs_sql('b', 'conversations', 'conv_id')} SELECT a.contig AS left_contig, b.contig AS right_contig, count(*) AS n FROM a FULL JOIN b USING (kmer) GROUP BY 1, 2")
def tool_contig_compare_full(spark, d):
    return tools.shared_kmers(_contig_list(spark, d, "benchmark", "item_id"), _contig_list(spark, d, "conversations", "conv_id"), 31, how="full")


THREE_LISTS = ", ".join(contigs_sql(*x) for x in (("a", "benchmark", "item_id"), ("b", "conversations", "conv_id"), ("c", "documents", "source")))
NAMED = "coalesce(a.contig, '-') AS bench, coalesce(b.contig, '-') AS conv, coalesce(c.contig, '-') AS docs"


@register("tool_contig_lists", f"WITH {THREE_LISTS}, m AS (SELECT {NAMED} FROM a FULL JOIN b ON a.kmer = b.kmer FULL JOIN c ON coalesce(a.kmer, b.kmer) = c.kmer) SELECT bench, conv, docs, count(*) AS nb_kmer, CAST((bench <> '-') AS int) + CAST((conv <> '-') AS int) + CAST((docs <> '-') AS int) AS nb_shared_contig FROM m GROUP BY ALL")
def tool_contig_lists(spark, d):
    docs = fx.spread(fx.table(spark, d, "documents").select("source", "text")).select(F.col("source").alias("contig"), fx.dna(F.col("text")).alias("seq"))
    return tools.compare_contig_lists({"bench": _contig_list(spark, d, "benchmark", "item_id"), "conv": _contig_list(spark, d, "conversations", "conv_id"), "docs": docs}, 31, show_unique=True)


@register("tool_signature_sharing", f"WITH {contigs_sql('a', 'conversations', 'conv_id')}, s AS (SELECT kmer, string_agg(contig, ',' ORDER BY contig) contigs FROM a GROUP BY 1) SELECT contigs, count(*) AS n_kmers FROM s GROUP BY 1")
def tool_signature_sharing(spark, d):
    return tools.signature_sharing(_contig_list(spark, d, "conversations", "conv_id"), 31)


@register("tool_select_genes", f"WITH {P}, c AS (SELECT sample_idx, sum(x) t FROM d GROUP BY 1), n AS (SELECT sample_idx, round(avg(t) OVER () / t, 6) nf FROM c) SELECT feature, sample_idx, round(x * nf, 6) + 0.0 AS value FROM d JOIN n USING (sample_idx) WHERE feature IN (SELECT concat('P', CAST(l_partkey AS varchar)) FROM lineitem WHERE l_returnflag = 'R')")
def tool_select_genes(spark, d):
    wanted = fx.table(spark, d, "lineitem").where(F.col("l_returnflag") == "R").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("feature"))
    return rows(tools.select_features(stored(fx.parts(spark, d)), wanted))


LABELLED = "SELECT quality AS label, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS prediction, n_chars AS score FROM labels JOIN documents USING (doc_id)"


def _labelled(spark, d) -> DataFrame:
    both = fx.table(spark, d, "labels").join(fx.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.select(F.col("quality").alias("label"), F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("prediction"), F.col("n_chars").alias("score"))


@register("tool_balanced_accuracy", f"WITH l AS ({LABELLED}), r AS (SELECT label, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) r FROM l GROUP BY 1) SELECT round(avg(r), 6) AS balanced_accuracy FROM r")
def tool_balanced_accuracy(spark, d):
    return tools.balanced_accuracy(_labelled(spark, d)).select(r6("balanced_accuracy").alias("balanced_accuracy"))


@register("tool_roc_auc", f"WITH l AS ({LABELLED}), c AS (SELECT score, count(*) FILTER (WHERE label = 1) p, count(*) FILTER (WHERE label = 0) n FROM l GROUP BY 1), w AS (SELECT p, n, p * (coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2.0) w FROM c) SELECT round(CAST(sum(w) / (sum(p) * sum(n)) AS double), 6) AS auc FROM w")
def tool_roc_auc(spark, d):
    return tools.roc_auc(_labelled(spark, d)).select(r6("auc").alias("auc"))


@register("tool_pr_auc", f"WITH l AS ({LABELLED}), c AS (SELECT score, count(*) FILTER (WHERE label = 1) p, count(*) n FROM l GROUP BY 1), w AS (SELECT p, sum(p) OVER (ORDER BY score DESC) sp, sum(n) OVER (ORDER BY score DESC) sn FROM c) SELECT round(sum(p * sp / CAST(sn AS double)) / CAST(sum(p) AS double), 6) + 0.0 AS auc FROM w")
def tool_pr_auc(spark, d):
    return tools.pr_auc(_labelled(spark, d)).select(r6("auc").alias("auc"))


SCORES = f"s AS (SELECT feature, round({SD}, 6) sd, round({SINGLE['rsd1']}, 6) rsd1, round(max(x), 6) top FROM d GROUP BY 1)"


def _scores(spark, d) -> DataFrame:
    c = F.col("counts")
    return fx.parts(spark, d).df.select("feature", F.round(vec.sd(c), 6).alias("sd"), F.round(score.rsd(c, vec.mean(c)), 6).alias("rsd1"), F.round(F.array_max(c), 6).alias("top"))


def _pair_sql(a: str, b: str) -> str:
    return f"SELECT '{a}' AS left, '{b}' AS right, round(covar_pop({a}, {b}) / sqrt(var_pop({a}) * var_pop({b})), 6) + 0.0 AS correlation FROM k"


RANKED = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in ("sd", "rsd1", "top"))


@register("tool_rank_correlation", f"WITH {P}, {SCORES}, k AS (SELECT {RANKED} FROM s) " + " UNION ALL ".join(_pair_sql(*p) for p in (("sd", "rsd1"), ("sd", "top"), ("rsd1", "top"))))
def tool_rank_correlation(spark, d):
    return tools.rank_correlation(_scores(spark, d), ["sd", "rsd1", "top"]).withColumn("correlation", r6("correlation"))


TOPS_SQL = " UNION ALL ".join(f"(SELECT feature, '{c}' w FROM s ORDER BY {c} DESC, feature LIMIT 50)" for c in ("sd", "rsd1", "top"))


@register("tool_top_membership", f"WITH {P}, {SCORES}, t AS ({TOPS_SQL}), m AS (SELECT feature, string_agg(w, ',' ORDER BY w) members FROM t GROUP BY 1) SELECT members, count(*) AS n FROM m GROUP BY 1")
def tool_top_membership(spark, d):
    return tools.top_membership(_scores(spark, d), ["sd", "rsd1", "top"], 50)


@register("tool_kmer_jaccard", f"WITH {contigs_sql('a', 'benchmark', 'item_id')}, {contigs_sql('b', 'documents', 'doc_id')}, x AS (SELECT DISTINCT kmer FROM a), y AS (SELECT DISTINCT kmer FROM b) SELECT round((SELECT count(*) FROM x JOIN y USING (kmer)) / CAST((SELECT count(*) FROM (SELECT * FROM x UNION SELECT * FROM y)) AS double), 6) AS jaccard")
def tool_kmer_jaccard(spark, d):
    side = lambda name, key: fx.sequences(spark, d, name, key)
    return tools.kmer_jaccard(side("benchmark", "item_id"), side("documents", "doc_id"), 31).select(r6("jaccard").alias("jaccard"))


REVERSED = "translate(reverse({s}), 'ACGT', 'TGCA')"


@register("tool_fastq_revcomp", f"WITH s AS (SELECT conv_id, turn, {fx.dna_sql()} dna, text FROM conversations) SELECT conv_id, turn, {REVERSED.format(s='dna')} AS seq, reverse(text) AS qual FROM s")
def tool_fastq_revcomp(spark, d):
    c = fx.table(spark, d, "conversations").select("conv_id", "turn", fx.dna(F.col("text")).alias("seq"), F.col("text").alias("qual"))
    return tools.reverse_reads(c)


# lineitems as alignments, parts as contigs
HITS = "SELECT l_linenumber + 1 qlen, 1 + l_orderkey % 2 qstart, l_linenumber + 1 - l_suppkey % 2 qend, l_linenumber + 1 length, l_linenumber + 1 nident, 100.0 pident, l_linenumber + 1 + l_partkey % 3 slen, 1 sstart, l_linenumber + 1 + l_partkey % 3 send, CASE WHEN l_suppkey % 2 = 0 THEN 100 ELSE 90 END qcovs FROM lineitem"
PERFECT = "qlen = qend AND qstart = 1 AND qlen = length AND qlen = nident AND pident = 100"


@register("tool_alignment_quality", f"WITH h AS ({HITS}), n AS (SELECT count(*) n FROM part) SELECT round(100.0 * count(*) FILTER (WHERE {PERFECT}) / any_value(n), 2) AS perfect, round(100.0 * count(*) FILTER (WHERE {PERFECT} AND sstart = 1 AND send = slen AND slen = qlen) / any_value(n), 2) AS identical, round(100.0 * count(*) FILTER (WHERE qcovs = 100) / any_value(n), 2) AS complete FROM h CROSS JOIN n")
def tool_alignment_quality(spark, d):
    line, n = fx.table(spark, d, "lineitem"), F.col("l_linenumber") + 1
    hits = line.select(
        n.alias("qlen"), (1 + F.col("l_orderkey") % 2).alias("qstart"), (n - F.col("l_suppkey") % 2).alias("qend"), n.alias("length"), n.alias("nident"), F.lit(100.0).alias("pident"),
        (n + F.col("l_partkey") % 3).alias("slen"), F.lit(1).alias("sstart"), (n + F.col("l_partkey") % 3).alias("send"), F.when(F.col("l_suppkey") % 2 == 0, 100).otherwise(90).alias("qcovs"),
    )
    return tools.alignment_quality(hits, fx.table(spark, d, "part"))


TAIL = WELCH[WELCH.index("a AS (") : WELCH.index("p AS (")].rstrip().rstrip(",")
GROUPS = "w AS (SELECT CAST(c_custkey % 4 AS int) g, CAST(count(*) AS double) n, avg(CAST(c_acctbal AS double)) m, var_samp(CAST(c_acctbal AS double)) v FROM customer GROUP BY 1), c AS (SELECT a.g g1, b.g g2, a.m - b.m diff, a.v / a.n va, b.v / b.n vb, a.n n1, b.n n2 FROM w a JOIN w b ON a.g < b.g), t AS (SELECT concat(g1, ':', g2) feature, g1, g2, diff / sqrt(va + vb) t, (va + vb) * (va + vb) / (va * va / (n1 - 1) + vb * vb / (n2 - 1)) df FROM c)"


@register("tool_pairwise_t", f"WITH {GROUPS}, {TAIL}, p AS (SELECT g1, g2, least(1.0, 2 * exp(lgamma((t.df + 1) / 2) - lgamma(t.df / 2)) / sqrt(pi()) * area) p FROM t JOIN q USING (feature)) SELECT g1 AS group_1, g2 AS group_2, round(p, 6) + 0.0 AS p, round(least(1.0, p * count(*) OVER ()), 6) + 0.0 AS p_adjusted, least(1.0, p * count(*) OVER ()) < 0.05 AS significant FROM p")
def tool_pairwise_t(spark, d):
    c = fx.table(spark, d, "customer").select((F.col("c_custkey") % 4).cast("int").alias("g"), F.col("c_acctbal").cast("double").alias("v"))
    return tools.pairwise_t_tests(c, "g", "v").withColumns({c: r6(c) for c in ("p", "p_adjusted")})


@register("tool_fold_summary", "SELECT o_orderpriority AS method, o_orderstatus AS workflow, round(median(CAST(o_totalprice AS double)), 6) + 0.0 AS median, round(min(CAST(o_totalprice AS double)), 6) + 0.0 AS min, round(max(CAST(o_totalprice AS double)), 6) + 0.0 AS max FROM orders GROUP BY 1, 2")
def tool_fold_summary(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("workflow"), F.col("o_totalprice").cast("double").alias("v"))
    return tools.fold_summary(o, ["method", "workflow"], "v").withColumns({c: r6(c) for c in ("median", "min", "max")})


@register("tool_ridge_predict")
def tool_ridge_predict(spark, d):
    """Ridge on the busiest parts, and its prediction of every sample."""
    m = stored(fx.parts(spark, d))
    best = score.select_top(score.score(m, "snr", labels=fx.LABELS), "snr", 20)
    samples = tools.samples_as_rows(m.with_df(best.select("feature", "counts")), fx.LABELS)
    return tools.predict(tools.fit_model(samples, "ridge"), samples).withColumn("prob_1", F.round("prob_1", 4))


def _busiest(spark, d) -> FeatureMatrix:
    """The twenty parts that tell the classes apart best."""
    m = stored(fx.parts(spark, d))
    return m.with_df(score.select_top(score.score(m, "snr", labels=fx.LABELS), "snr", 20).select("feature", "counts"))


@register("tool_lasso_path")
def tool_lasso_path(spark, d):
    """Cross-validated deviance along the path of penalties."""
    found = models.cross_validation(spark, models.design(_busiest(spark, d), fx.LABELS), 1.0, 5, 50)
    return found.withColumns({c: r6(c) for c in ("penalty", "mean", "sd")})


@register("tool_stability_selection")
def tool_stability_selection(spark, d):
    """In how many of 2,000 resamples a lasso at the chosen penalty selects each feature."""
    design = models.design(_busiest(spark, d), fx.LABELS)
    return models.stability(spark, design, models.fit_path(spark, design, 1.0, 5, 50).penalty, 1.0)


@register("tool_elastic_net")
def tool_elastic_net(spark, d):
    """Coefficients of an elastic net over the features that 2,000 resamples agree on."""
    return models.fit_model(_busiest(spark, d), fx.LABELS, "elasticnet", folds=5).table(spark).withColumn("coefficient", r6("coefficient"))


@register("tool_top_ridge")
def tool_top_ridge(spark, d):
    """Coefficients of ridge on the five features with the largest ones among all."""
    return models.fit_top_ridge(_busiest(spark, d), fx.LABELS, 5, 5).table(spark).withColumn("coefficient", r6("coefficient"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index, normalise, filter, round: feature, sample_idx, value."""
    m = stored(fx.parts(spark, sf_dir))
    kept = filters.filter_features(index.normalise(m, index.compute_nf(m, 1e6)), fx.STATUS, (1.0, 3), (1e9, 3))
    return kept.df.select("feature", F.posexplode(vec.half_up(F.col("counts"))).alias("sample_idx", "value"))


register("index_filter_round", f"WITH {P}, {NF}, n AS (SELECT feature, sample_idx, x * nf x FROM d JOIN nf USING (sample_idx)), k AS (SELECT feature FROM n GROUP BY 1 HAVING count(*) FILTER (WHERE sample_idx >= 10 AND x >= 1) >= 3 AND count(*) FILTER (WHERE sample_idx < 10 AND x <= 1e9) >= 3) SELECT feature, sample_idx, CAST(floor(x + 0.5) AS bigint) AS value FROM n WHERE feature IN (SELECT feature FROM k)")(flagship)
