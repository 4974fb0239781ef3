"""Exact token counts at every prefix of a text, for word-end merge vocabularies.

A dynamic programme over a word's symbols: the encoding of the first p symbols ends in exactly one
token t with which the encoding of the first p - len(t) symbols, whose last token is known, is
compatible; the count there is one more than at p - len(t). A prefix that is a text by itself ends
in a token with the word-end mark, found in the same way from the same table. So one pass over a
word answers how many tokens each of its prefixes has.

A text's counts are those of its runs between white space, one upon the other. Each worker makes a
run's counts once and keeps them in flat arrays; the counts of all prefixes of all texts of a pass
are put together at once. They are stored as changes from one code point to the next, a byte each as
a rule. How long a prefix may be for a budget, how many tokens a prefix has and where to cut a text
into pieces are then lookups in these counts; nothing is encoded again.
"""

from __future__ import annotations

import itertools
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .merges import Memo, compatible, last_merges
from .shared import column, text_column
from .tokens import RunTable, look_up
from .words import Texts, passes

#: White space as the vocabulary's own patterns see it.
WHITE = r"\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it is a visible
    Latin-1 character, else the next free code point from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Code points that can join one before them: second ones of canonical pairs, vowels and ends of Korean syllables."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    second = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"}
    return frozenset(second | {*map(chr, range(0x1161, 0x1176)), *map(chr, range(0x11A8, 0x11C3))})


@lru_cache(maxsize=1 << 16)
def _stands_alone(c: str) -> bool:
    """Whether a code point and what follows it are normalised as if nothing were before it."""
    first = unicodedata.normalize("NFD", c)[0]
    return not unicodedata.combining(first) and first not in _joining()


class PrefixCounter:
    """Counts for a tokenizers file: NFC, white space, lower case; a split pattern; bytes with a word end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rules = spec["normalizer"]["normalizers"]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        bpe = spec["model"]
        if [r["type"] for r in rules] != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] or not bpe["end_of_word_suffix"]:
            raise ValueError("not a word-end vocabulary of the supported kind")
        self.end = bpe["end_of_word_suffix"]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"].replace(r"\s", WHITE))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.letters = _byte_letters()
        order = {(a, b): i for i, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in bpe["merges"])}
        made = {a + b for a, b in order}
        singles = {t for t in bpe["vocab"] if t not in made}
        self.rank = lambda a, b: order.get((a, b))
        tokens = {t: self._symbols(t) for t in bpe["vocab"] if t not in self.special}
        self.last = last_merges(tokens, self.rank)
        self.singles = singles
        # Tokens inside a word and at its end, found by their letters: (how many these are, token).
        self.inner, self.final = ahocorasick.Automaton(), ahocorasick.Automaton()
        for t in self.last:
            body = t.removesuffix(self.end)
            (self.final if body != t else self.inner).add_word(body, (len(body), t))
        self.longest = max(len(t.removesuffix(self.end)) for t in self.last)
        self.inner.make_automaton()
        self.final.make_automaton()
        self.compatible = Memo(lambda pair: compatible(*pair, self.last, self.rank))
        self.words = Memo(self._word_prefixes, 200_000)
        self.table = RunTable(np.dtype("<i4"))

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1:] + self.end]
        return [*token]

    def _letters_of(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])

    def _ending(self, letters: str, skipped: int) -> tuple[list[list[tuple[int, str]]], list[list[tuple[int, str]]]]:
        """Tokens inside a word and at its end that end behind each letter but the first `skipped`, longest first."""
        out = [[] for _ in range(len(letters) - skipped)], [[] for _ in range(len(letters) - skipped)]
        for found, automaton in zip(out, (self.inner, self.final), strict=True):
            for at, token in automaton.iter(letters):
                if at >= skipped:
                    found[at - skipped].append(token)
        return out

    def _states(self, letters: str, token_at: list[str], count: list[int]) -> list[int]:
        """By p, for the letters of a word: the last token of the first p letters without a word end, and
        their count, from where the two lists (with a first entry for no letter) are known to, which they
        are extended from; returns for each new p the count with a word end."""
        known, ended = len(count) - 1, []
        fits = self.compatible
        for p, (inner, final) in enumerate(zip(*self._ending(letters, known), strict=True), known + 1):
            for size, t in inner:
                q = p - size
                if not q or fits[token_at[q], t]:
                    token_at.append(t)
                    count.append(count[q] + 1)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            for size, t in final:
                q = p - size
                if not q or fits[token_at[q], t]:
                    ended.append(count[q] + 1)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return ended

    def _word_prefixes(self, word: str) -> list[int]:
        """Token counts of a word's prefixes of 1, 2, ... code points, each as a text of its own."""
        letters = self._letters_of(word)
        ended = self._states(letters, [""], [0])
        return ended if letters is word else [ended[p - 1] for p in itertools.accumulate(len(c.encode()) for c in word)]

    def _normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")  # a final sigma is a matter of words, not of characters
        return text.lower()

    def _segment(self, text: str) -> list[int]:
        """Counts of all prefixes of a text without special tokens."""
        if text.isascii():
            if text.isalpha():
                return self._plain(text.lower())
            if text[:-1].isalpha():
                counts = self._plain(text[:-1].lower())
                return [*counts, counts[-1] + self._plain(text[-1])[-1]]
        small = self._normal(text)
        if len(small) == len(text) and unicodedata.is_normalized("NFC", text):
            return self._small(small)[0]
        return self._merging(text)

    def _small(self, small: str) -> tuple[list[int], list[int]]:
        """Counts of all prefixes of a normalised text, and for each place where its word begins (behind
        the place if it is in none)."""
        out, starts, total = [0] * len(small), [*range(1, len(small) + 1)], 0
        at = 0
        for m in self.pattern.finditer(small):
            word = m.group()
            if len(word) > 1 and word[0] == "'" and word[1].isalpha():
                counts = [self._total(word[:k]) for k in range(1, len(word))] + [self._plain(word)[-1]]
            else:
                counts = self._plain(word)
            out[at : m.start()] = [total] * (m.start() - at)
            out[m.start() : m.end()] = [total + c for c in counts]
            starts[m.start() : m.end()] = [m.start()] * len(word)
            total, at = out[m.end() - 1], m.end()
        out[at:] = [total] * (len(small) - at)
        return out, starts

    def _merging(self, text: str) -> list[int]:
        """Counts of all prefixes of a text with code points that merge or multiply when it is normalised.

        Normalisation works on stretches, from one code point that never joins what is before it to the
        next. A prefix that ends where a stretch ends is a prefix of the normalised text; another one
        ends in the normalised begin of a stretch, and only that is counted on from where the last
        whole stretch ended."""
        cuts = [0, *(i for i, c in enumerate(text) if i and _stands_alone(c)), len(text)]
        stretches = [self._normal(text[a:b]) for a, b in itertools.pairwise(cuts)]
        small = "".join(stretches)
        counts, starts = self._small(small)
        words: dict[int, tuple] = {}
        out, at = [], 0
        for (a, b), whole in zip(itertools.pairwise(cuts), stretches, strict=True):
            out += [self._with_tail(small, at, counts, starts, words, self._normal(text[a:k])) for k in range(a + 1, b)]
            at += len(whole)
            out.append(counts[at - 1])
        return out

    def _with_tail(self, small: str, size: int, counts: list[int], starts: list[int], words: dict[int, tuple], tail: str) -> int:
        """The count of a text's first `size` code points with others behind them. words: what is known of
        long words by their places (letters, tokens and counts at them, letters before each code point)."""
        first = starts[size - 1] if size else 0
        before = counts[first - 1] if first else 0
        if size - first <= 64:
            return before + self._total(small[first:size] + tail)
        near = max(first, size - 16)
        while near > first and small[near] == "'":
            near -= 1
        joined = self.pattern.match(small[near:size] + tail).end() - (size - near)
        own = counts[size - 1] - before
        if joined > 0:
            if first not in words:
                word = self.pattern.match(small, first).group()
                letters, token_at, count = self._letters_of(word), [""], [0]
                self._states(letters, token_at, count)
                words[first] = letters, token_at, count, [0, *itertools.accumulate(1 if letters is word else len(c.encode()) for c in word)]
            letters, token_at, count, place = words[first]
            known = place[size - first]
            back = max(0, known - self.longest)  # no token reaches further
            more = letters[back:known] + "".join([self.letters[x] for x in tail[:joined].encode()])
            own = self._states(more, token_at[back : known + 1], count[back : known + 1])[-1]
        return before + own + self._total(tail[max(joined, 0) :])

    def _plain(self, word: str) -> list[int]:
        return self.words[word] if len(word) <= 64 else self._word_prefixes(word)

    def _total(self, small: str) -> int:
        return sum(self._plain(w)[-1] for w in self.pattern.findall(small))

    def run_counts(self, run: str) -> list[int]:
        """Token counts of a run's prefixes of 1, 2, ... code points, each as a text of its own."""
        if self.cut is None or "<" not in run or not self.cut.search(run):
            return self._segment(run)
        out, done, at = [], 0, 0
        for m in self.cut.finditer(run):
            before = run[at : m.start()]
            counts = self._segment(before)
            out += [done + c for c in counts]
            # Inside a special token, what is there of it goes on with the text before it.
            out += [done + self.run_counts(before + m.group()[:k])[-1] for k in range(1, len(m.group()))]
            done += (counts[-1] if counts else 0) + 1
            out.append(done)
            at = m.end()
        return out + [done + c for c in self._segment(run[at:])]

    def _steps(self, runs: list[str]) -> list[bytes]:
        each = [self.run_counts(r) for r in runs]
        stop = np.cumsum([len(x) for x in each]) if each else np.zeros(0, np.int64)
        flat = np.fromiter(itertools.chain.from_iterable(each), np.int32, int(stop[-1]) if each else 0)
        steps = np.diff(flat, prepend=0)
        first = np.concatenate([[0], stop[:-1]]) if each else stop
        steps[first] = flat[first]
        data = steps.astype("<i4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)]

    def steps(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """By how much the count changes at each code point of a pass's texts, and where each text's
        code points begin, with the end of the last."""
        lead = (t.raw & 0xC0) != 0x80
        place = np.concatenate([[0], np.cumsum(lead)])
        out = np.zeros(int(place[-1]), np.int32)
        steps, count = look_up(self.table, t, t.start, t.end, False, self._steps, self._steps)
        if len(count):
            first = place[t.start]
            out[np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(steps))] = steps
        return out, place[t.at]

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of all prefixes of 0, 1, ... code points."""
        t = next(passes(pa.array([text], pa.large_string())))
        return np.concatenate([[0], np.cumsum(self.steps(t)[0])])


def packed(steps: np.ndarray) -> tuple[int, bytes]:
    """(bytes a step, the steps): a byte each if all fit, else four."""
    width = 1 if not len(steps) or (-128 <= steps.min() and steps.max() <= 127) else 4
    return width, steps.astype("i1" if width == 1 else "<i4").tobytes()


def counts_of(width: int, steps: bytes) -> np.ndarray:
    """Token counts of all prefixes of 0, 1, ... code points, from what is stored."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, "i1" if width == 1 else "<i4"), dtype=np.int64)])


def count_at(counts: np.ndarray, size: int) -> int:
    """Tokens of the first `size` code points."""
    return int(counts[min(size, len(counts) - 1)])


def longest(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most `budget` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fits, step_bytes, steps) of every whole text. fits: code
    points of the longest prefix of at most `limit` tokens. steps: the count at every prefix, stored as
    changes of step_bytes bytes a code point (see counts_of). No shuffle.

    Null and empty texts have no bytes, tokens or steps. Rows are counted each by itself, whatever
    their ids.
    """
    source = docs.select(id_col, text_col)
    kinds = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType(), "fits": T.LongType(), "step_bytes": T.IntegerType(), "steps": T.BinaryType()}
    out = T.StructType([source.schema[id_col], *(T.StructField(n, t) for n, t in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for t in passes(text_column(batch, text_col)):
                steps, at = c.steps(t)
                sums = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
                n, size = sums[at[1:]] - sums[at[:-1]], np.diff(at)
                fits, each = size.copy(), []
                for i, (a, b) in enumerate(itertools.pairwise(at.tolist())):
                    each.append(packed(steps[a:b]))
                    if n[i] > limit:
                        fits[i] = longest(sums[a : b + 1] - sums[a], limit)
                cols = [column(batch, id_col).slice(t.first, t.n), pa.array(np.diff(t.at)), pa.array(n), pa.array(n > limit), pa.array(fits), pa.array([w for w, _ in each], pa.int32()), pa.array([x for _, x in each], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return source.mapInArrow(run, out)
