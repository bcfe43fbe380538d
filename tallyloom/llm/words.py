"""Array kernels over the bytes of many texts at once; they run inside Arrow tasks.

A chunk of texts is joined into one byte buffer. Words are runs of bytes other than a set of separators. A word's 64-bit
hash takes in its bytes eight at a time, with a bijective mix of the state after each eight; words of over LONG bytes
are hashed by BLAKE2. Whoever needs certainty compares the bytes as well (`same_words`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
LONG = 256

SPACES = b" \t\n\x0b\x0c\r"
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
CHUNK_BYTES = 2 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def blocks(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For k = 0, 1, ...: which words are longer than 8 k bytes, and their bytes from 8 k on, eight as one integer (zeros after the end).

    The buffer needs seven bytes after the last word's end.
    """
    eights = np.ndarray((max(0, len(buffer) - 7),), "<u8", buffer, 0, (1,))
    which, at, left = np.arange(len(starts)), starts, ends - starts
    while len(which):
        x = eights[at]
        short = np.flatnonzero(left < 8)
        x[short] &= (U(1) << (left[short].astype(U) * U(8))) - U(1)
        yield which, x
        more = left > 8
        which, at, left = which[more], at[more] + 8, left[more] - 8


def word_hashes(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    h = mix(size.astype(U) + U(0xD6E8FEB86659FD93))
    brief = np.flatnonzero(size <= LONG)
    for which, x in blocks(buffer, starts[brief], ends[brief]):
        at = brief[which]
        h[at] = mix(h[at] ^ x)
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(blake2b(buffer[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


@dataclass
class Words:
    buffer: bytes  # all texts of the chunk, each followed by a space, and seven more
    starts: np.ndarray  # of each word, in the buffer
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # for each text, the number of words before it; one entry more than texts

    def bytes(self, i: int) -> bytes:
        return self.buffer[self.starts[i] : self.ends[i]]

    def text(self, i: int, j: int) -> str:
        """Words i to j - 1 with what stands between them."""
        return self.buffer[self.starts[i] : self.ends[j - 1]].decode("utf-8", "replace") if j > i else ""


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about CHUNK_BYTES, with the number of the first; a longer text is a run of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]


def words(texts: list[bytes], translate: bytes | None = None, cut_after_alnum: bool = False) -> Words:
    """The words of each text, after a bytewise translation of the same length.

    cut_after_alnum also begins a word where ASCII punctuation follows an ASCII letter or digit.
    """
    buffer = b" ".join(texts) + b" " * 8
    if translate:
        buffer = buffer.translate(translate)
    b = np.frombuffer(buffer, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    step = np.diff(space.view(np.int8), prepend=1)
    begins, stops = step == -1, step == 1
    if cut_after_alnum:
        alnum = ((b >= 97) & (b <= 122)) | ((b >= 65) & (b <= 90)) | ((b >= 48) & (b <= 57))
        cut = np.zeros(len(b), bool)
        cut[1:] = alnum[:-1] & ~alnum[1:] & ~space[1:] & (b[1:] < 128)
        begins, stops = begins | cut, stops | cut
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]) if texts else np.zeros(1, np.int64)
    return Words(buffer, starts, ends, word_hashes(buffer, starts, ends), np.searchsorted(starts, offsets))


def same_words(w: Words, like: np.ndarray) -> bool:
    """Whether each word has the bytes of the word whose number `like` gives, and which has the same hash.

    Up to eight bytes a word's hash is a bijection of them, for each length, so those needn't be looked at.
    """
    size = w.ends - w.starts
    if not (size == size[like]).all():
        return False
    brief = np.flatnonzero((size > 8) & (size <= LONG) & (like != np.arange(len(size))))
    other = like[brief]
    pairs = zip(blocks(w.buffer, w.starts[brief], w.ends[brief]), blocks(w.buffer, w.starts[other], w.ends[other]), strict=True)
    return all((x == y).all() for (_, x), (_, y) in pairs) and all(w.bytes(i) == w.bytes(like[i]) for i in np.flatnonzero(size > LONG) if like[i] != i)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within one text, and the number of the word each begins with."""
    count = len(w.hashes) - n + 1
    if count <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    with np.errstate(over="ignore"):
        h = np.zeros(count, U)
        for k in range(n):
            h = (h ^ (h >> U(29))) * U(0xFF51AFD7ED558CCD) + w.hashes[k : k + count]
    at = np.flatnonzero(owner[:count] == owner[n - 1 :])
    return mix(h[at]), at


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows: bounds what a task holds as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encoded(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in column.to_pylist()]
