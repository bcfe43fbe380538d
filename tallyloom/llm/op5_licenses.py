"""License scans by conditional compression.

1. Candidate blocks. A notice with at most E edited words keeps one of E + 1 disjoint stretches of its template's words
   intact, so texts are searched for the templates' stretches, and nothing else is needed to find every notice. Hits of one
   template that put its beginning at about one place are a candidate; its block is as long as the template, and E more
   words to either side.
2. Ranking. Each block is compressed by itself and with the template as zstandard raw dictionary. The bytes saved, doubled,
   over the block's and the template's own compressed sizes rank a text's candidates: what a template has and the
   block lacks counts against it, as does what the block has and the template lacks.
3. Confirmation, from the first in rank on. The template's words are aligned with the block's by least edits
   (insertions, deletions, replacements). At most the share MAX_EDITS may be edited, none of them a strict word (a number, a
   name of a licence or of a condition, a negation), and no negation may stand shortly before the notice. A confirmed
   notice takes its words; candidates further down the ranking may be confirmed in what is left.

Words are runs of characters other than ASCII white space and punctuation, A-Z lower-cased. The templates are a parameter; the default is
license_texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .shared import table
from .words import ASCII_LOWER, U, Words, chunks, encoded, shingles, slices, words

MAX_EDITS = 0.2
LEVEL = 3
CONTEXT = 4  # words before a notice that may negate it
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TABLE = bytes(32 if c in _PUNCTUATION else ASCII_LOWER[c] for c in range(256))
# fixed values: words whose change changes the licence, and those that deny one
_NEGATIONS = frozenset(b"no not never longer without isn wasn cannot neither nor unless formerly except".split())
_NAMES = frozenset(b"by nc sa nd attribution noncommercial sharealike noderivatives mit bsd isc apache gnu gpl lesser affero mozilla eclipse only later".split())


def _strict(word: bytes) -> bool:
    return word in _NAMES or word in _NEGATIONS or word.lstrip(b"v").isdigit()


@dataclass
class Template:
    name: str
    words: list[bytes]
    hashes: np.ndarray
    size: int  # compressed by itself
    compressor: object

    @property
    def edits(self) -> int:
        return int(MAX_EDITS * len(self.words))


def align(want: np.ndarray, have: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """Least edits that turn all of `want` into a stretch of `have`, and the steps (place in want or -1, place in have or -1)."""
    steps = np.arange(len(have) + 1)
    table = np.zeros((len(want) + 1, len(have) + 1), np.int32)
    for i, x in enumerate(want):
        row = np.append(i + 1, np.minimum(table[i, 1:] + 1, table[i, :-1] + (have != x)))
        table[i + 1] = np.minimum.accumulate(row - steps) + steps
    j, i, path = int(np.argmin(table[-1])), len(want), []
    least = int(table[-1, j])
    while i:
        if j and table[i, j] == table[i - 1, j - 1] + (have[j - 1] != want[i - 1]):
            i, j = i - 1, j - 1
            path.append((i, j))
        elif table[i, j] == table[i - 1, j] + 1:
            i -= 1
            path.append((i, -1))
        else:
            j -= 1
            path.append((-1, j))
    return least, path[::-1]


class Matcher:
    """Templates as zstandard raw dictionaries, as words, and as the stretches that find them."""

    def __init__(self, templates: dict[str, list[str]]):
        import zstandard

        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        self.templates: list[Template] = []
        stretches: dict[int, list[tuple[int, int, int]]] = {}  # by number of words: hash, template, place
        for name, notices in templates.items():
            for notice in notices:
                w = words([notice.encode()], _TABLE)
                n = len(w.hashes)
                if not n:
                    continue
                texts = [w.bytes(i) for i in range(n)]
                raw = b" ".join(texts)
                held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                t = Template(name, texts, w.hashes, len(self.alone.compress(raw)), zstandard.ZstdCompressor(level=LEVEL, dict_data=held))
                cuts = np.linspace(0, n, t.edits + 2).astype(int)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    h = shingles(Words(w.buffer, w.starts[a:b], w.ends[a:b], w.hashes[a:b], np.array([0, b - a])), int(b - a))[0][0]
                    stretches.setdefault(int(b - a), []).append((int(h), len(self.templates), int(a)))
                self.templates.append(t)
        self.stretches = {}
        for n, found in stretches.items():
            found.sort()
            self.stretches[n] = tuple(np.array(x, d) for x, d in zip(zip(*found, strict=True), (U, np.int64, np.int64), strict=True))

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every stretch found in the texts of a chunk: the text, the template, and the word where that would begin."""
        text, which, begins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, (hashes, template, place) in self.stretches.items():
            h, first = shingles(w, n)
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            at = np.flatnonzero(hi > lo)
            each = (hi - lo)[at]
            entry = np.repeat(lo[at], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            text.append(np.repeat(np.searchsorted(w.first, first[at], "right") - 1, each))
            which.append(template[entry])
            begins.append(np.repeat(first[at], each) - place[entry])
        return np.concatenate(text), np.concatenate(which), np.concatenate(begins)

    def candidates(self, w: Words) -> Iterator[tuple[int, list[tuple[float, int, int, int]]]]:
        """Each text with candidates, and these by rank: saving, template, first word and end of the block."""
        text, which, begins = self.hits(w)
        order = np.lexsort((begins, which, text))
        text, which, begins = text[order], which[order], begins[order]
        spare = np.array([t.edits for t in self.templates])[which]
        apart = np.ones(len(text), bool)
        apart[1:] = (text[1:] != text[:-1]) | (which[1:] != which[:-1]) | (np.diff(begins) > np.maximum(spare[1:], 1))
        cuts = np.append(np.flatnonzero(apart), len(text))
        now: list = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            t = self.templates[which[a]]
            lo, hi = max(begins[a] - t.edits, w.first[text[a]]), min(begins[b - 1] + len(t.words) + t.edits, w.first[text[a] + 1])
            now.append((self.saving(w, int(lo), int(hi), int(which[a])), int(which[a]), int(lo), int(hi)))
            if b == len(text) or text[b] != text[a]:
                yield int(text[a]), sorted(now, key=lambda x: (-x[0], *x[1:]))
                now = []

    def saving(self, w: Words, lo: int, hi: int, k: int) -> float:
        """Twice the bytes that template k saves in words lo to hi - 1, over both compressed sizes."""
        block = b" ".join(w.bytes(i) for i in range(lo, hi))
        size = len(self.alone.compress(block))
        return 2.0 * (size - len(self.templates[k].compressor.compress(block))) / (size + self.templates[k].size)

    def confirmed(self, w: Words, lo: int, hi: int, start: int, k: int) -> tuple[int, int, int, list[str]] | None:
        """First word, end, edits and wording where words lo to hi - 1 hold template k; start: the text's first word."""
        t = self.templates[k]
        edits, path = align(t.hashes, w.hashes[lo:hi])
        if edits > t.edits:
            return None
        have = lambda j: w.bytes(lo + j)
        wording = []
        for i, j in path:
            a, b = t.words[i] if i >= 0 else b"", have(j) if j >= 0 else b""
            if a != b:
                if _strict(a) or _strict(b):
                    return None
                wording.append(f"-{a.decode()}+{b.decode('utf-8', 'replace')}")
        places = [j for _, j in path if j >= 0]
        if not places:
            return None
        first, end = lo + places[0], lo + places[-1] + 1
        if any(w.bytes(x) in _NEGATIONS for x in range(max(start, first - CONTEXT), first)):
            return None
        return first, end, edits, wording

    def notices(self, w: Words) -> Iterator[tuple[int, str, int, int, float, int, list[str]]]:
        """Text, license, first word, end, saving, edits, wording of each notice in the texts of a chunk."""
        taken = np.zeros(len(w.hashes), bool)
        for text, ranked in self.candidates(w):
            for saving, k, lo, hi in ranked:
                edges = np.flatnonzero(np.diff(taken[lo:hi].astype(np.int8), prepend=1, append=1))
                free = [(lo + int(a), lo + int(b)) for a, b in edges.reshape(-1, 2)]
                while free:
                    a, b = free.pop()
                    if b > a and (found := self.confirmed(w, a, b, int(w.first[text]), k)):
                        first, end, edits, wording = found
                        taken[first:end] = True
                        yield text, self.templates[k].name, first, end, saving, edits, wording
                        free += [(a, first), (end, b)]


def license_notices(df: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Notices found in df: the id, license, start, end (code points), saving, edits, differences, notice.

    Of notices that overlap, the one further up the text's ranking is reported. Null and empty texts have none; repeated rows are all scanned; an empty table
    gives an empty result; other columns aren't read.
    """
    chosen = TEMPLATES if templates is None else templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(chosen)
        for batch in slices(batches):
            rows: list[tuple] = []
            for at, run in chunks(encoded(batch.column(1))):
                w = words(run, _TABLE)
                begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in run])])
                for text, name, first, end, saving, edits, wording in matcher.notices(w) if len(w.hashes) and matcher.templates else ():
                    raw, a, b = run[text], int(w.starts[first] - begins[text]), int(w.ends[end - 1] - begins[text])
                    start, notice = len(raw[:a].decode("utf-8", "surrogatepass")), raw[a:b].decode("utf-8", "surrogatepass")
                    rows.append((at + text, name, start, start + len(notice), saving, edits, "; ".join(wording), notice))
            c = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(c[0], pa.int64())), *(pa.array(x, t) for x, t in zip(c[1:], kinds, strict=True))], names=[id_col, "license", "start", "end", "saving", "edits", "differences", "notice"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(scan, f"`{id_col}` {kind}, license string, start long, end long, saving double, edits long, differences string, notice string")


def op5_conditional_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_notices(table(spark, sf_dir, "documents"))
    return found.withColumn("saving", F.round("saving", 6))
