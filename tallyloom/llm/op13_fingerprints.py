"""Order MinHash fingerprints, by DataFrame functions only.

A text is a sequence of tokens (TOKEN: runs of letters and digits in pieces of at most eight, single letters of scripts written without
spaces, single symbols), and its k-mers are runs of `k` tokens. A k-mer that recurs is told apart by its occurrence number, so
repeats count. Under each of `size` orders of all numbered k-mers, the `tuple_size` smallest are selected, put back in text order,
and hashed as a tuple: two texts agree in a place if they agree in the selected k-mers and in their order. The share of
places in which they agree falls with their edit distance, also where an edit moves text about and leaves the set of k-mers as it was.

The orders are turns of one: every numbered k-mer has a place on a circle by its hash, and order f begins f / size round the circle. A
text's places are sorted once, and each order's smallest are found by a binary search, whatever the text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vec import let
from .shared import materialise, table

_SINGLE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
TOKEN = rf"[{_SINGLE}]|[\p{{L}}\p{{M}}\p{{N}}&&[^{_SINGLE}]]{{1,8}}|[^\s\p{{L}}\p{{M}}\p{{N}}]"
POSITION_BITS = 28  # of a packed k-mer; the other 35 bits are its hash
_POSITION = (1 << POSITION_BITS) - 1
RANGES_EACH = 8  # ranges of the documents' order for each shuffle partition
MAX_RANGES = 2000


def _steps(n: Column) -> Column:
    """The powers of two up to n, largest first: the steps of a binary search."""
    return F.filter(F.lit([1 << b for b in range(POSITION_BITS - 1, -1, -1)]), lambda p: p <= n)


def _packed(h: Column, position: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(h, 64 - 63 + POSITION_BITS), POSITION_BITS).bitwiseOR(position.cast("long"))


def _kmers(tokens: Column, k: int) -> Column:
    """Hashes of all runs of k tokens; of the whole sequence where it is shorter."""
    whole = F.array(F.xxhash64(tokens))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - k + 1, F.lit(1))), lambda i: F.xxhash64(*(F.get(tokens, i + (d - 1)) for d in range(k))))
    return F.when(F.size(tokens) < k, whole).otherwise(runs)


def _numbered(kmers: Column) -> Column:
    """Each k-mer with its occurrence number as a place on the circle, packed with its position (from 1), in order."""
    by_hash = F.sort_array(F.transform(kmers, lambda h, i: _packed(h, i + 1)))
    value = lambda x: F.shiftright(x, POSITION_BITS)

    def place(s: Column, steps: Column) -> Column:
        def of(x: Column, j: Column) -> Column:
            same = lambda i: (i >= 0) & (value(F.get(s, i)) == value(x))
            first = F.aggregate(steps, j, lambda p, step: F.when(same(p - step), p - step).otherwise(p))
            number = F.when(same(j - 1), j - first).otherwise(F.lit(0))
            return _packed(F.xxhash64(value(x), number), x.bitwiseAND(F.lit(_POSITION)))

        return F.sort_array(F.transform(s, of))

    return let(by_hash, lambda s: let(_steps(F.size(s)), lambda steps: place(s, steps)))


def fingerprint(text: Column, k: int = 3, tuple_size: int = 2, size: int = 64) -> Column:
    """The `size` tuple hashes (32 bits each, as longs) of a text; null and texts without a token have those of their letters as one k-mer."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    tokens = let(found, lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(text)))

    def tuples(kmers: Column, items: Column, steps: Column) -> Column:
        n = F.size(items)

        def one(begin: Column) -> Column:
            below = F.aggregate(steps, F.lit(0), lambda c, step: F.when((c + step <= n) & (F.coalesce(F.get(items, c + step - 1), F.lit(0)) < begin), c + step).otherwise(c))
            chosen = let(below, lambda c: F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(tuple_size - 1)), lambda t: F.get(items, (c + t) % n).bitwiseAND(F.lit(_POSITION)))))
            return F.xxhash64(F.transform(chosen, lambda p: F.get(kmers, (p - 1).cast("int")))).bitwiseAND(F.lit(0xFFFFFFFF))

        begins = F.lit([((f << 35) // size) << POSITION_BITS for f in range(size)])
        return F.transform(begins.cast("array<long>"), one)

    return let(
        F.coalesce(text, F.lit("")),
        lambda _: let(tokens, lambda t: let(_kmers(t, k), lambda kmers: let(_numbered(kmers), lambda items: let(_steps(F.size(items)), lambda steps: tuples(kmers, items, steps))))),
    )


def likeness(a: Column, b: Column) -> Column:
    """The share of places in which two fingerprints agree: 1 for equal texts."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def written(f: Column) -> Column:
    return F.array_join(F.transform(f, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def with_next(df: DataFrame, id_col: str, text_col: str, more: dict[str, Column]) -> DataFrame:
    """id, text and further columns (expressions of column text), and those of the next row in descending order of the id as next_*.

    After the last row comes the first; ids may repeat (then by text) or be null (last). Texts cross one exchange: ids alone tell the ranges of
    the order, each of which then is a window of its own, with a copy of the next range's first row at its end.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = rows.where("id is not null")
    ranges = min(MAX_RANGES, RANGES_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = known.select("id").repartitionByRange(ranges, F.desc("id")).groupBy(F.spark_partition_id().alias("r")).agg(F.max("id").alias("id"))
    firsts = [r["id"] for r in dealt.orderBy(F.desc("id")).select("id").collect()]  # one for each range
    nulls = not rows.where("id is null").isEmpty()
    if not firsts and not nulls:
        return rows.select("id", "text", *(c.alias(n) for n, c in more.items())).select("*", *(F.col(c).alias(f"next_{c}") for c in ("text", *more)))
    kind = rows.schema["id"].dataType
    bounds = F.array(*(F.lit(x) for x in firsts)).cast(f"array<{kind.simpleString()}>") if firsts else F.lit(None).cast(f"array<{kind.simpleString()}>")
    powers = F.lit([1 << b for b in range(max(1, len(firsts)).bit_length() - 1, -1, -1)])
    # the number of bounds at or above the id, less one
    at = F.aggregate(powers, F.lit(0), lambda c, step: F.when((c + step <= len(firsts)) & (F.get(bounds, c + step - 1) >= F.col("id")), c + step).otherwise(c)) - 1
    count = len(firsts) + nulls
    placed = rows.select("id", "text", F.when(F.col("id").isNull(), F.lit(len(firsts))).otherwise(at).alias("range"), F.lit(False).alias("guard"))
    # first rows, by their ids: as many as there are ranges
    wanted = spark.createDataFrame([(x,) for x in firsts], rows.select("id").schema)
    heads = known.join(F.broadcast(wanted), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    if nulls:
        heads = heads.union(rows.where("id is null").groupBy("id").agg(F.min("text")))
    heads = materialise(heads, "heads")
    before = F.when(F.col("id").isNull(), F.lit(len(firsts))).otherwise(at) + (count - 1)
    guards = heads.select("id", "text", (before % count).cast("int").alias("range"), F.lit(True).alias("guard"))
    order = Window.partitionBy("range").orderBy("guard", F.desc_nulls_last("id"), "text")
    every = placed.union(guards).select("*", *(c.alias(n) for n, c in more.items()))
    return every.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("text", *more))).where("not guard").drop("range", "guard")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, tuple_size: int = 2, size: int = 64) -> DataFrame:
    """The id (its type kept) and fingerprint (array of longs) of every row.

    Null is an empty text, whose letters are its only k-mer; so are those of a text without a token. Null ids and repeated rows are kept; an
    empty table gives an empty result; other columns aren't read.
    """
    return df.select(F.col(id_col), fingerprint(F.coalesce(F.col(text_col), F.lit("")), k, tuple_size, size).alias("fingerprint"))


def edit_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, tuple_size: int = 2, size: int = 64) -> DataFrame:
    """The id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the text's last third replaced by as much of the next row's beginning, or all of it. Rows as in with_next and
    fingerprints: the only row of a table is its own next.
    """
    f = fingerprint(F.col("text"), k, tuple_size, size)
    both = with_next(df, id_col, text_col, {"f": f})
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    again = both.select("id", n.cast("long").alias("n_chars"), edited.alias("text"), F.col("f").alias("own"), "next_f").withColumn("e", f)
    return again.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("text", 256).alias("edited_sha256"), written(F.col("own")).alias("fingerprint"), written(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("e")).alias("near_edited"), likeness(F.col("own"), F.col("next_f")).alias("near_next"),
    )


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(table(spark, sf_dir, "documents")).withColumn("doc_id", F.col("doc_id").cast("long"))
