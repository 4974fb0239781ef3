"""Token ids by the tokenizers library, with texts cut where the vocabulary never merges.

Both byte-level and word-end patterns start a new word at every change from a visible character to
white space. So a text's ids are those of its runs (white space and what follows it), one after the
other. Each worker gives a run to the library once and keeps its bytes and its ids in flat arrays,
found by the run's hash; all runs of a pass are looked up, compared byte by byte, and their ids
gathered, at once. A run whose hash another one has taken goes to the library each time.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .words import Texts

#: Runs that a worker keeps at most, and their bytes; then it starts afresh. Longer runs than LONG
#: bytes aren't kept.
RUNS = 1 << 21
RUN_BYTES = 1 << 24
LONG = 1 << 12
#: Runs given to the library as one text.
_AT_ONCE = 2000
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class RunTable:
    """A hash table of runs over flat arrays, probed linearly by whole arrays of keys."""

    def __init__(self, width: np.dtype, bits: int = 16):
        self.width = width
        self.clear(bits)

    def clear(self, bits: int = 16) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.key = np.zeros(1 << bits, np.uint64)
        self.entry = np.zeros(1 << bits, np.int64)  # of the run in a slot
        self.n = 0
        # By entry: where its ids begin and where its bytes begin, with the end of the last.
        self.at, self.text_at = np.zeros((1 << bits) + 1, np.int64), np.zeros((1 << bits) + 1, np.int64)
        self.ids, self.text = np.zeros(1 << bits, self.width), np.zeros(1 << bits, np.uint8)

    @property
    def full(self) -> bool:
        return self.n > RUNS or int(self.text_at[self.n]) > RUN_BYTES

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entries of keys, -1 where they are missing."""
        slot = (keys & self.mask).astype(np.int64)
        got = self.key[slot]
        out = np.where(got == keys, self.entry[slot], -1)
        open_ = np.flatnonzero((got != keys) & (got != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(self.mask)
            got = self.key[slot[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.entry[slot[open_[hit]]]
            open_ = open_[~hit & (got != 0)]
        return out

    def differ(self, entries: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which of the byte ranges of raw aren't the text of their entry."""
        size = end - start
        out = self.text_at[entries + 1] - self.text_at[entries] != size
        same = np.flatnonzero(~out)
        size = size[same]
        stop = np.cumsum(size)
        place = np.arange(stop[-1] if len(stop) else 0)
        wrong = raw[place + np.repeat(start[same] - stop + size, size)] != self.text[place + np.repeat(self.text_at[entries[same]] - stop + size, size)]
        if wrong.any():
            out[same[np.unique(np.searchsorted(stop, np.flatnonzero(wrong), "right"))]] = True
        return out

    def _place(self, keys: np.ndarray, entries: np.ndarray) -> None:
        slot = (keys & self.mask).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            s = slot[left]
            free = left[self.key[s] == 0]
            self.key[slot[free]] = keys[free]
            won = self.key[slot[left]] == keys[left]
            self.entry[slot[left[won]]] = entries[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & int(self.mask)

    def add(self, keys: np.ndarray, texts: list[bytes], ids: list[bytes]) -> None:
        """New, distinct keys that aren't 0, their runs and what these are encoded as."""
        n = self.n + len(keys)
        if n > len(self.key) // 2:
            old = np.flatnonzero(self.key)
            kept = self.key[old], self.entry[old]
            size = len(self.key)
            while n > size // 2:
                size *= 2
            self.mask, self.key, self.entry = np.uint64(size - 1), np.zeros(size, np.uint64), np.zeros(size, np.int64)
            self._place(*kept)
        self.at = _grown(self.at, n + 1)
        self.text_at = _grown(self.text_at, n + 1)
        for starts, parts, width, name in ((self.at, ids, self.width.itemsize, "ids"), (self.text_at, texts, 1, "text")):
            starts[self.n + 1 : n + 1] = starts[self.n] + np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // width)
            store = _grown(getattr(self, name), int(starts[n]))
            store[starts[self.n] : starts[n]] = np.frombuffer(b"".join(parts), store.dtype)
            setattr(self, name, store)
        self._place(keys, np.arange(self.n, n))
        self.n = n


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    while len(a) < n:
        a = np.concatenate([a, np.zeros_like(a)])
    return a


def look_up(table: RunTable, t: Texts, start: np.ndarray, end: np.ndarray, lower: bool, kept: Callable[[list[str]], list[bytes]], alone: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """What runs are encoded as, one after the other, and how many items each has. kept makes it for
    runs that the table then holds, alone for those that it can't: long ones, and those whose hash
    another one has taken. lower: runs that differ in the case of A-Z alone are the same."""
    text = _SMALL[t.raw] if lower else t.raw
    keys = t.span_hashes(start, end, lower) | np.uint64(1)
    if table.full:
        table.clear()
    entry = table.find(keys)
    own = end - start > LONG
    if len(missing := np.flatnonzero((entry < 0) & ~own)):
        new, at = np.unique(keys[missing], return_index=True)
        at = missing[at]
        raw, small = t.raw.tobytes(), text.tobytes()
        cuts = list(zip(start[at].tolist(), end[at].tolist(), strict=True))
        table.add(new, [small[a:b] for a, b in cuts], kept([raw[a:b].decode() for a, b in cuts]))
        entry[missing] = table.find(keys[missing])
    entry[own] = 0
    some = np.flatnonzero(~own)
    own[some] = table.differ(entry[some], text, start[some], end[some])
    count = table.at[entry + 1] - table.at[entry]
    made: dict[int, bytes] = {}
    if len(others := np.flatnonzero(own)):
        raw = t.raw.tobytes()
        made = dict(zip(others.tolist(), alone([raw[start[i] : end[i]].decode() for i in others]), strict=True))
        count[others] = [len(x) // table.width.itemsize for x in made.values()]
    stop = np.cumsum(count)
    source = np.where(own, 0, table.at[entry]) - stop + count
    place = np.arange(int(stop[-1]) if len(stop) else 0)
    if not made:
        return table.ids[np.repeat(source, count) + place], count
    items = np.empty(len(place), table.width)
    rest = ~np.repeat(own, count)
    items[rest] = table.ids[(np.repeat(source, count) + place)[rest]]
    for i, x in made.items():
        items[stop[i] - count[i] : stop[i]] = np.frombuffer(x, table.width)
    return items, count


class RunEncoder:
    """Ids of whole texts, equal to encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"] or {}
        kinds = [s["type"] for s in steps.get("pretokenizers", [steps])]
        self.cuts = kinds == ["ByteLevel"] and steps["use_regex"] and not steps["add_prefix_space"] and not spec["normalizer"] or kinds == ["Split", "ByteLevel"]
        self.drops_space = kinds == ["Split", "ByteLevel"]
        self.special = any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        vocab = self.tokenizer.get_vocab()
        end = (spec["model"].get("end_of_word_suffix") or "") if self.drops_space else ""
        self.length = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.length[i] = len(token.removesuffix(end) if end else token)
        self.table = RunTable(self.width)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, runs: list[str], plain: bool) -> list[bytes]:
        """Ids of runs that are encoded as one text, which the library does faster than each alone.
        Where one run's ids end shows by the tokens' lengths if the runs are ASCII, else by offsets."""
        out: list[bytes] = []
        gap = " " if self.drops_space else ""
        for lo in range(0, len(runs), _AT_ONCE):
            part = runs[lo : lo + _AT_ONCE]
            text = gap.join(part)
            if plain:
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.width)
                first = np.concatenate([[0], np.cumsum(self.length[ids])])[:-1]
                starts = np.cumsum([0, *map(len, part)])
            else:
                got = self.tokenizer.encode(text, add_special_tokens=False)
                ids = np.array(got.ids, self.width)
                first = np.fromiter((o[0] for o in got.offsets), np.int64, len(ids))
                starts = np.cumsum([0, *(len(r) + len(gap) for r in part)])
            cut = np.searchsorted(first, starts)
            data, size = ids.tobytes(), self.width.itemsize
            out += [data[a * size : b * size] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return out

    def _runs(self, runs: list[str]) -> list[bytes]:
        """Ids of distinct runs. A run may follow another directly if that leaves both as they are:
        it begins with white space (or gets it as a gap) and ends visibly. The rest goes alone."""
        out: list[bytes] = [b""] * len(runs)
        alone, plain, wide = [], [], []
        for i, r in enumerate(runs):
            fits = "<" not in r and (self.drops_space or r[0] in " \n\t" and r[-1] > " ")
            (alone if not fits else plain if r.isascii() else wide).append(i)
        for some, ids in ((alone, self._encode([runs[i] for i in alone])), (plain, self._joined([runs[i] for i in plain], True)), (wide, self._joined([runs[i] for i in wide], False))):
            for i, x in zip(some, ids, strict=True):
                out[i] = x
        return out

    def _looked_up(self, t: Texts, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs one after the other, and how many each has."""
        return look_up(self.table, t, start, end, self.drops_space, self._runs, self._encode)

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a pass's texts one after the other, and how many each text has."""
        texts = None
        odd = range(t.n)
        if self.cuts and not self.special:
            # Texts with white space outside ASCII are given to the library whole.
            odd = []
            if (t.raw >= 0xC2).any() and (hits := np.flatnonzero(_LEADS[t.raw])).size:
                odd = [int(i) for i in np.unique(np.searchsorted(t.at, hits, "right") - 1) if _WIDE.search(t.text(int(i)))]
        if len(odd) == t.n:
            texts = self._encode([t.text(i) for i in range(t.n)])
            return np.frombuffer(b"".join(texts), self.width), np.array([len(x) for x in texts]) // self.width.itemsize
        start, end, doc = t.start, t.end, t.doc
        if not self.drops_space:
            before = np.concatenate([[0], end])[:-1]
            first = np.zeros(len(start), bool)
            some = t.word_at[:-1][np.diff(t.word_at) > 0]
            first[some] = True
            start = np.where(first, t.at[doc], before)
            # What is left at a text's end is white space, a run of its own.
            last = np.where(np.diff(t.word_at) > 0, end[np.maximum(t.word_at[1:] - 1, 0)] if len(end) else 0, t.at[:-1])
            tail = np.flatnonzero(last < t.at[1:])
            if len(tail):
                order = np.argsort(np.concatenate([end, t.at[1:][tail]]), kind="stable")
                start, end, doc = (np.concatenate(x)[order] for x in ((start, last[tail]), (end, t.at[1:][tail]), (doc, tail)))
        ids, count = self._looked_up(t, start, end)
        sizes = np.bincount(doc, count, minlength=t.n).astype(np.int64)
        if len(odd):
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i, x in zip(odd, self._encode([t.text(i) for i in odd]), strict=True):
                parts[i] = np.frombuffer(x, self.width)
                sizes[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, sizes


_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
#: First bytes of the white space outside ASCII.
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


@lru_cache(maxsize=4)
def run_encoder(path: str) -> RunEncoder:
    return RunEncoder(path)
