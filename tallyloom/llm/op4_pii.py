"""Personal data by anchor expansion.

One Aho-Corasick pass over each text finds the anchors: at-signs, digits, plus signs, scheme marks and identifier cues. At
each anchor a small deterministic parser expands to the value's boundaries and validates it:

* `@`: local part to the left, domain labels to the right (email);
* a digit that begins a run: four dotted numbers (ip), 12 to 19 digits with single separators that pass Luhn (card);
* `+`: an international number of 9 to 15 digits (phone);
* `://`: the scheme to the left, authority and path to the right (url), kept where it names a user or an account: user
  information before an at-sign, a `~name` or `@name` path part, or a query field named like an identifier;
* a cue word such as "account" or "iban" as a word of its own, in any case: the value after it (account: 6 or more
  letters and digits with a digit; IBANs by their check digits), or the mailing address after it (address: a number and
  words up to a five-digit code).

Within one kind matches don't overlap; one that fails validation still takes its place. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "address")
# fixed values: identifier cues, and the names of query fields that hold identifiers
ACCOUNT_CUES = ("account number", "account no", "account", "iban", "passport", "customer id", "member id", "ssn", "social security", "tax id")
ADDRESS_CUES = ("address", "ship to", "mail to", "deliver to")
ID_FIELDS = ("user", "uid", "userid", "email", "account", "token", "session", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_REST = re.compile(r"://([^\x00-\x20\"'<>()\[\]{}]+)")
_VALUE = re.compile(r"(?:\x20*(?:no\.?|number|nr\.?|#))?\x20*[:#=]?\x20*([A-Za-z]{0,4}[0-9][A-Za-z0-9]*(?:[\x20-]?[A-Za-z0-9]*[0-9][A-Za-z0-9]*)*)", re.I)
_ADDRESS = re.compile(r"\x20*:?\x20*([0-9]{1,5}[A-Za-z]?(?:\x20+[^\W\d_][\w.'-]*,?){1,8}\x20+[0-9]{5}(?:-[0-9]{4})?)(?![0-9A-Za-z])")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes_iban(value: str) -> bool:
    s = re.sub(r"[\x20-]", "", value).upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _names_someone(rest: str) -> bool:
    authority, _, tail = rest.partition("/")
    path, _, query = tail.partition("?")
    return "@" in authority or any(len(p) > 1 and p[0] in "~@" for p in path.split("/")) or any(f.split("=")[0].lower() in ID_FIELDS and "=" in f for f in query.split("&"))


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for anchor, kind in [("@", "at"), ("+", "plus"), ("://", "scheme"), *((str(d), "digit") for d in range(10))]:
        a.add_word(anchor, (kind, len(anchor)))
    for cue in ACCOUNT_CUES:
        a.add_word(cue, ("account", len(cue)))
    for cue in ADDRESS_CUES:
        a.add_word(cue, ("address", len(cue)))
    a.make_automaton()
    return a


def _folded(text: str) -> str:
    """Lower case that never changes a text's length, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def find_personal_data(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, kind's number, end) of one text, in order."""
    out: list[tuple[int, int, int]] = []
    end = dict.fromkeys(KINDS, 0)
    kind_no = {k: i for i, k in enumerate(KINDS)}

    def take(kind: str, start: int, stop: int, valid: bool) -> None:
        end[kind] = stop
        if valid:
            out.append((start, kind_no[kind], stop))

    for last, (anchor, size) in automaton().iter(_folded(text)):
        at = last + 1 - size
        if anchor == "digit":
            run_goes_on = at > 0 and "0" <= text[at - 1] <= "9"
            if at >= end["ip"] and (not run_goes_on or at == end["ip"]) and (m := _IP.match(text, at)):
                take("ip", at, m.end(), all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))))
            if at >= end["card"] and (not run_goes_on or at == end["card"]) and (m := _CARD.match(text, at)):
                d = _digits(m[0])
                take("card", at, m.end(), 12 <= len(d) <= 19 and passes_luhn(d))
        elif anchor == "plus":
            if at >= end["phone"] and (m := _PHONE.match(text, at)):
                take("phone", at, m.end(), 9 <= len(_digits(m[0])) <= 15)
        elif anchor == "at":
            start = at
            while start > end["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                take("email", start, m.end(), True)
        elif anchor == "scheme":
            start = at
            while start > end["url"] and text[start - 1] in _SCHEME:
                start -= 1
            if start < at and (m := _REST.match(text, at)):
                stop = at + 3 + len(m[1].rstrip(".,;:!?"))
                take("url", start, stop, _names_someone(text[at + 3 : stop]))
        else:
            alone = (at == 0 or not text[at - 1].isalnum()) and (last + 1 == len(text) or not text[last + 1].isalnum())
            if alone and last + 1 >= end[anchor] and (m := (_VALUE if anchor == "account" else _ADDRESS).match(text, last + 1)):
                value = m[1]
                solid = re.sub(r"[\x20-]", "", value)
                good = anchor == "address" or (len(solid) >= 6 and (not text[at : last + 1].lower().startswith("iban") or passes_iban(value)))
                take(anchor, m.start(1), m.end(1), good)
    return sorted(set(out))


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of all rows: the id, found (array of start, kind, end, value), a count for each base kind, base_sha256, spans.

    A null or empty text has none (the SHA-256 is that of the empty string); null ids and repeated rows are kept, each
    reported by itself; an empty table gives an empty result; other columns aren't read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts, digests, written = [], [[] for _ in BASE_KINDS], [], []
            for text in batch.column(1).to_pylist():
                spans = find_personal_data(text) if text else []
                say = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
                found.append([{"start": a, "kind": KINDS[k], "end": b, "value": text[a:b]} for a, k, b in spans])
                for i in range(len(BASE_KINDS)):
                    counts[i].append(sum(k == i for _, k, _ in spans))
                digests.append(hashlib.sha256(",".join(s for s, (_, k, _) in zip(say, spans, strict=True) if k < len(BASE_KINDS)).encode()).hexdigest())
                written.append(",".join(say))
            item = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("value", pa.string())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(item)), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(written, pa.string())],
                names=[id_col, "found", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
            )

    kind = df.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, found array<struct<start:int,kind:string,end:int,value:string>>, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string"
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(scan, schema)


def op4_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).drop("found")
