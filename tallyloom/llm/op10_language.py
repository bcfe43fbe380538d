"""Language identification as a mixture of languages, inferred for each text by expectation-maximisation.

The model holds, for each language, the smoothed likelihoods of hashed letter n-grams (two sizes), counted over all training texts.
A text's n-grams are explained by a mixture of languages: expectation-maximisation finds the proportions that make
them likeliest. Languages enter the set one by one, each time the one that gains most, as long as twice the gain in
log-likelihood exceeds PENALTY * log(n-grams) (a Bayesian information criterion). The prediction is the language with
the largest proportion and the score is that proportion.

The model has 2^HASH_BITS numbers of 4 bytes for each language, whatever the corpus, in blocks of BLOCK languages; the
driver gathers one block at a time and broadcasts it. A thousand languages are 131 MB in a worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, table
from .words import U, mix

HASH_BITS = 15
SIZES = (2, 3)
SMOOTHING = 0.5
PENALTY = 8.0
ROUNDS = 30
BLOCK = 32  # languages whose numbers are in one array
HELD_LANGUAGES = 64  # whose counts a task holds at once
CHUNK_CHARS = 1 << 19
_LETTERS = None


def _letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _LETTERS


def buckets(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts: the number of the first, n-gram buckets, the number of the text each is from, letters in each text.

    Letters are lower-cased; every stretch of other characters is one space; n-grams of only spaces don't occur.
    """
    letter, mask = _letter_table(), U((1 << HASH_BITS) - 1)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHUNK_CHARS):
            size += len(texts[end] or "") + 2
            end += 1
        joined = [" " + (t or "").lower() + " " for t in texts[at:end]]
        c = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(end - at), [len(t) for t in joined])
        is_letter = letter[c]
        letters = np.bincount(owner[is_letter], minlength=end - at)
        c = np.where(is_letter, c, 32)
        keep = np.ones(len(c), bool)
        keep[1:] = is_letter[1:] | is_letter[:-1] | (owner[1:] != owner[:-1])
        c, owner = c[keep].astype(U), owner[keep]
        grams, owners = [], []
        for n in SIZES:
            if len(c) >= n:
                h = np.full(len(c) - n + 1, U(n))
                for k in range(n):
                    h = h << U(21) | c[k : len(c) - n + 1 + k]
                inside = owner[: len(h)] == owner[n - 1 :]
                grams.append((mix(h[inside]) & mask).astype(np.int32))
                owners.append(owner[: len(h)][inside])
        yield at, np.concatenate(grams) if grams else np.zeros(0, np.int32), np.concatenate(owners) if owners else np.zeros(0, np.int64), letters
        at = end


def gram_counts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, bucket, n over all rows with a language, summed up in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for at, grams, owner, _ in buckets(batch.column(0).to_pylist()):
                names = {}
                which = np.array([names.setdefault(x, len(names)) for x in langs[at : at + (int(owner.max()) + 1 if len(owner) else 0)]], np.int64)
                if not len(which):
                    continue
                both = np.bincount((which[owner] << HASH_BITS) + grams, minlength=len(names) << HASH_BITS).reshape(len(names), -1)
                for name, i in names.items():
                    sums[name] = sums.get(name, 0) + both[i]
            while len(sums) > HELD_LANGUAGES:
                name = next(iter(sums))
                yield _counted(name, sums.pop(name))
        for name, n in sums.items():
            yield _counted(name, n)

    rows = df.where(F.col(lang_col).isNotNull()).select(F.col(text_col), F.col(lang_col).cast("string"))
    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _counted(name: str, n: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[Broadcast]]:
    """The languages in order of name, and their n-gram likelihoods: for each BLOCK of them 2^HASH_BITS x languages."""
    spark = df.sparkSession
    counts = materialise(gram_counts(df, text_col, lang_col), "grams")
    langs = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    blocks = []
    for at in range(0, len(langs), BLOCK):
        names = langs[at : at + BLOCK]
        part = counts.where(F.col("lang").isin(names)).select((F.array_position(F.array(*map(F.lit, names)), F.col("lang")) - 1).alias("i"), "bucket", "n").toArrow()  # at most BLOCK x 2^HASH_BITS rows
        model = np.full((1 << HASH_BITS, len(names)), SMOOTHING)
        model[part["bucket"].to_numpy(), part["i"].to_numpy()] += part["n"].to_numpy()
        blocks.append(spark.sparkContext.broadcast((model / model.sum(axis=0)).astype(np.float32)))
    return langs, blocks


def proportions(p: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Mixture proportions of the columns of p (n-grams x languages) by expectation-maximisation, and the log-likelihood."""
    share = np.full(p.shape[1], 1.0 / p.shape[1])
    for _ in range(rounds):
        mixed = p @ share
        new = share * (p.T @ (weight / mixed)) / weight.sum()
        if np.abs(new - share).max() < 1e-4:
            share = new
            break
        share = new
    return share, float(weight @ np.log(p @ share))


def mixture(blocks: list[np.ndarray], grams: np.ndarray, weight: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The languages of a text with these n-grams, chosen forward under the penalty, and their proportions."""
    alone = np.concatenate([weight @ np.log(b[grams].astype(float)) for b in blocks])
    width = blocks[0].shape[1]
    column = lambda k: blocks[k // width][grams, k % width].astype(float)
    chosen, share, best = [int(np.argmax(alone))], np.ones(1), float(alone.max())
    p = column(chosen[0])[:, None]
    penalty = PENALTY * np.log(max(2.0, weight.sum()))
    while len(chosen) < len(alone):
        # what a language adds at a small proportion: the slope of the log-likelihood there, none where it doesn't rise
        steep = weight / (p @ share)
        slope = np.concatenate([steep @ b[grams] for b in blocks]) - weight.sum()
        slope[chosen] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= 0:
            break
        wider = np.column_stack([p, column(k)])
        trial, likelihood = proportions(wider, weight)
        if 2.0 * (likelihood - best) <= penalty:
            break
        chosen, p, share, best = [*chosen, k], wider, trial, likelihood
    return chosen, share


def detect(df: DataFrame, langs: list[str], model: list[Broadcast], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixture of each row: the id, lang_pred, score, languages and their proportions, the largest first.

    A null text and one without letters give `und` with score 0 and no languages, as does a model of no language. Repeated
    rows are all predicted; ids aren't looked at; an empty table gives an empty result; other columns aren't read.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likelihood = [b.value for b in model]
        for batch in batches:
            pred, score, sets, shares = [], [], [], []
            for _, grams, owner, letters in buckets(batch.column(1).to_pylist()):
                order = np.argsort(owner, kind="stable")
                grams, cuts = grams[order], np.searchsorted(owner[order], np.arange(len(letters) + 1))
                for i in range(len(letters)):
                    if not letters[i] or not langs:
                        pred.append("und"), score.append(0.0), sets.append([]), shares.append([])
                        continue
                    g, n = np.unique(grams[cuts[i] : cuts[i + 1]], return_counts=True)
                    chosen, share = mixture(likelihood, g, n.astype(float))
                    by = np.argsort(-share, kind="stable")
                    pred.append(langs[chosen[by[0]]])
                    score.append(float(min(1.0, max(0.0, share[by[0]]))))
                    sets.append([langs[chosen[k]] for k in by])
                    shares.append([float(share[k]) for k in by])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                names=[id_col, "lang_pred", "score", "languages", "proportions"],
            )

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(predict, f"`{id_col}` {kind}, lang_pred string, score double, languages array<string>, proportions array<double>")


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    langs, model = train(docs.where(fold != 0))
    found = detect(docs, langs, model)
    return found.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score")
