"""Words of many texts at once, as NumPy arrays over their UTF-8 bytes.

A word is a run of bytes other than U+0020 and U+0009 to U+000D. Those bytes never occur inside a
multi-byte character, so working on bytes gives the same words as working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled in one pass; one longer text makes a pass of its own.
PASS_BYTES = 1 << 20
U64 = np.uint64


def splitmix(x: np.ndarray | int) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit integers that mixes all bits."""
    with np.errstate(over="ignore"):
        z = np.asarray(x, U64) + U64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


def _odd(seed: int, n: int) -> np.ndarray:
    return splitmix(np.arange(n, dtype=U64) + U64(seed << 32)) | U64(1)


_NEAR = 64
_BYTE = np.arange(256)
_LOWER = _BYTE + 32 * ((_BYTE >= 65) & (_BYTE <= 90))
_PLACE = _odd(2, 64)
#: An unrelated number for each of _NEAR places and each byte, as it is and with A-Z as a-z. Places
#: further on take them again, times a number of their own for each stretch of _NEAR.
_TABLES = [splitmix(splitmix(np.repeat(np.arange(_NEAR, dtype=U64), 256)) + np.tile(t, _NEAR).astype(U64)) for t in (_BYTE, _LOWER)]


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


@dataclass
class Texts:
    """Some texts: their bytes, where each begins (one more entry than texts) and their words."""

    first: int  # index in the batch of the first text
    raw: np.ndarray
    at: np.ndarray
    start: np.ndarray  # of words, in raw
    end: np.ndarray
    doc: np.ndarray  # text of each word
    word_at: np.ndarray  # first word of each text, one more entry than texts

    @property
    def n(self) -> int:
        return len(self.at) - 1

    def text(self, i: int) -> str:
        return self.raw[self.at[i] : self.at[i + 1]].tobytes().decode()

    def span_hashes(self, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
        """64-bit hashes of byte ranges of raw: sums of unrelated numbers for each place and byte."""
        size = end - start
        stop = np.cumsum(size)
        place = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size, size)
        byte = self.raw[place + np.repeat(start, size)]
        value = _TABLES[lower][(place & (_NEAR - 1)) << 8 | byte]
        sums = np.zeros(len(value) + 1, U64)
        with np.errstate(over="ignore"):
            if len(size) and (most := int(size.max())) > _NEAR:
                value *= np.concatenate([[U64(1)], _odd(3, most // _NEAR)])[place >> 6]
            np.cumsum(value, out=sums[1:])
            return splitmix(sums[stop] - sums[stop - size] + size.astype(U64))

    def hashes(self, lower: bool) -> np.ndarray:
        return self.span_hashes(self.start, self.end, lower)

    def counts(self, of_words: np.ndarray | None = None) -> np.ndarray:
        """Words of each text, or the sum over them."""
        if of_words is None:
            return np.diff(self.word_at)
        sums = np.concatenate([[0], np.cumsum(of_words, dtype=np.int64)])
        return sums[self.word_at[1:]] - sums[self.word_at[:-1]]

    def counts_sum(self, of_words: np.ndarray) -> np.ndarray:
        """Sums of numbers over each text's words."""
        return np.bincount(self.doc, of_words, minlength=self.n)

    def byte_sums(self, of_bytes: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(of_bytes, dtype=np.int64)])
        return sums[self.at[1:]] - sums[self.at[:-1]]


def passes(texts: pa.Array, limit: int = PASS_BYTES) -> Iterator[Texts]:
    """A large_string array without nulls, in passes of about `limit` bytes."""
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield _cut(lo, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def _cut(first: int, raw: np.ndarray, at: np.ndarray) -> Texts:
    n = len(raw)
    inside = ~IS_SPACE[raw]
    edge = np.zeros(n + 1, bool)  # a word may begin here although the byte before is a word's
    edge[at] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    word_at = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(word_at))
    return Texts(first, raw, at, start, end, doc, word_at)


def windows(t: Texts, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside one text, and the index of each run's first word."""
    m = len(h) - size + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        x = h[:m] * _PLACE[0]
        for k in range(1, size):
            x = x + h[k : k + m] * _PLACE[k]
    keep = np.flatnonzero(t.doc[:m] == t.doc[size - 1 :])
    return splitmix(x[keep]), keep


def short_sequences(t: Texts, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts of 1 to size-1 words: the hash of the whole sequence, and the text."""
    n = t.counts()
    docs = np.flatnonzero((n > 0) & (n < size))
    out = np.zeros(len(docs), U64)
    with np.errstate(over="ignore"):
        for k in range(size - 1):
            has = n[docs] > k
            out[has] += h[t.word_at[docs[has]] + k] * _PLACE[k]
        return splitmix(out ^ (n[docs].astype(U64) << U64(56))), docs
