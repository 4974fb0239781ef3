"""Collocations: phrases of two to four words that occur together more often than their parts.

Words are counted and the frequent ones numbered, and texts become runs of numbers, which are read once for each
length. Tasks sort what they have gathered, so that equal phrases leave them as one row, and Spark adds up the rows
of a phrase by its numbers. A phrase is a candidate only if it is frequent without its first and without its last word;
a filter of bits tells most that aren't, and those that it lets through are counted and found to be rare.

All that is sent to tasks or held by one has a fixed bound: words are numbered in shards of SLOTS, a filter has RANGE
bits at most. Work and rows moved are at most in proportion to the positions of the corpus for each length.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORKERS, column, discard, stored, text_column
from .words import Texts, splitmix

# The least count of a candidate, the longest phrase, the share (in percent) of a phrase's
# occurrences in a longer one from which it is dropped, and the factor of scores.
LEAST, LONGEST, WITHIN, SCALE = 30, 4, 80, 2_000_000
TOP = 2000
NO_LANG = "und"

#: Words of a shard, on average: about 15 bytes each, and their letters.
SLOTS = 1 << 20
#: Bits that a filter's hashes range over at most, and bits for each of its phrases.
RANGE, FAN = 1 << 28, 16
#: Parts of a language's phrases that are ranked by themselves first.
PARTS = 256
#: Bytes of a piece of a filter.
PIECE = 1 << 16
#: Phrases and distinct words that a task gathers before it counts them; numbers of runs that it looks at together, and
#: rows that it hands on together.
GATHERED = 1 << 20
PART, HANDED = 1 << 18, 1 << 16
#: Bytes of text handled in one pass, and numbers in a row of runs, about.
PASS_BYTES, ROW = 1 << 20, 2048

U64 = np.uint64
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(b".,;:!?\n\v\f\r")] = True
_IS_GAP = _IS_BREAK.copy()
_IS_GAP[list(b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _passes(texts: pa.Array) -> Iterator[tuple[Texts, np.ndarray]]:
    """A batch's words in passes, cut between pieces, with a flag for each word that another of its piece follows."""
    n = len(texts)
    _, offsets, data = texts.buffers()
    if not n or data is None:
        return
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)
    cuts = np.union1d(at, at[0] + np.flatnonzero(_IS_BREAK[raw[at[0] : at[-1]]]) + 1)
    lo = int(at[0])
    while lo < at[-1]:
        to = max(np.searchsorted(cuts, lo + PASS_BYTES, "right") - 1, np.searchsorted(cuts, lo, "right"))
        hi = int(cuts[to])
        first = int(np.searchsorted(at, lo, "right")) - 1
        inner = at[first + 1 : np.searchsorted(at, hi, "left")]
        part, edges = raw[lo:hi], np.concatenate([[0], inner - lo, [hi - lo]])
        inside = ~_IS_GAP[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[edges] = True
        before, after = np.concatenate([[False], inside]), np.concatenate([inside, [False]])
        start, end = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
        word_at = np.searchsorted(start, edges)
        doc = np.repeat(np.arange(len(edges) - 1), np.diff(word_at))
        piece = np.cumsum(_IS_BREAK[part])[start] if len(start) else start
        followed = np.zeros(len(start), bool)
        followed[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
        yield Texts(first, part, edges, start, end, doc, word_at), followed
        lo = hi


def _bytes_of(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans one after the other, and where each begins, with the end."""
    stop = np.concatenate([[0], np.cumsum(size)])
    return raw[np.arange(stop[-1]) + np.repeat(start - stop[:-1], size)], stop


def _salts(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], U64)


def _keyed(t: Texts, langs: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a pass's words with their languages, and the languages. langs: of each text of the batch."""
    lang = langs[t.first + t.doc]
    return splitmix(t.hashes(lower=True) ^ salts[lang]), lang


def _languages(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    coded = text_column(batch, "lang").dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _differ(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which spans of equal sizes have different bytes."""
    x, stop = _bytes_of(a, a_at, size)
    y, _ = _bytes_of(b, b_at, size)
    wrong = np.concatenate([[0], np.cumsum(x != y)])
    return wrong[stop[1:]] != wrong[stop[:-1]]


def _distinct_words(t: Texts, langs: np.ndarray, names: list[str], salts: np.ndarray) -> pa.Table:
    """(lang, word, n) of a pass's words, lower-cased; words are told apart by their bytes, hashes only sort them."""
    h, lang = _keyed(t, langs, salts)
    low, size = _LOWER[t.raw], t.end - t.start
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    same = (size == size[first][which]) & (lang == lang[first][which])
    same[same] &= ~_differ(low, t.start[same], low, t.start[first][which][same], size[same])
    odd = np.flatnonzero(~same)  # words that share a hash with another one
    rows = np.concatenate([first, odd])
    n = np.concatenate([np.bincount(which[same], minlength=len(first)), np.ones(len(odd), np.int64)])
    text, at = _bytes_of(low, t.start[rows], size[rows])
    word = pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(text.tobytes())])
    return pa.table({"lang": pa.array(names, pa.large_string()).take(pa.array(lang[rows])), "word": word, "n": pa.array(n)})


_WORD = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words of (lang, text), and with a null word the number of all words of a language."""

    def summed(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        if held:
            each = pa.concat_tables(held).group_by(["lang", "word"]).aggregate([("n", "sum")]).rename_columns(["lang", "word", "n"])
            whole = each.group_by("lang").aggregate([("n", "sum")])
            yield from each.cast(_WORD).to_batches(max_chunksize=100_000)
            whole = pa.table({"lang": whole.column("lang"), "word": pa.nulls(len(whole), pa.string()), "n": whole.column("n_sum")})
            yield from whole.cast(_WORD).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            names, langs = _languages(batch)
            salts = _salts(names)
            for t, _ in _passes(text_column(batch, "text")):
                if len(t.start):
                    held.append(_distinct_words(t, langs, names, salts))
                if sum(map(len, held)) > GATHERED:
                    yield from summed(held)
                    held = []
        yield from summed(held)

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Slots:
    """A minimal perfect hash of distinct 64-bit keys, in levels of bits: a key has the first bit that is its alone,
    and the number of bits before it is its slot. keys: by slot."""

    def __init__(self, keys: np.ndarray) -> None:
        bits, self.levels, base, rest = [], [], 0, keys
        while len(rest):
            size = max(64, 2 * len(rest) + 63 & ~63)
            at = self._place(rest, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(np.packbits(alone, bitorder="little").view(U64))
            self.levels.append((base, size))
            base += size
            rest = rest[~alone[at]]
        self.bits = np.concatenate([*bits, np.zeros(1, U64)])
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])
        slot = self._slot(keys)
        self.keys = np.empty(len(keys), U64)
        self.keys[slot] = keys

    def __len__(self) -> int:
        return len(self.keys)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (splitmix(keys ^ splitmix(level + 1)) % U64(size)).astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        on = np.arange(len(keys))
        for level, (base, size) in enumerate(self.levels):
            if not len(on):
                break
            at = base + self._place(keys[on], level, size)
            word, bit = self.bits[at >> 6], (at & 63).astype(U64)
            hit = (word >> bit) & U64(1) == 1
            below = np.bitwise_count(word & ((U64(1) << bit) - U64(1)))
            out[on[hit]] = (self.rank[at >> 6] + below)[hit]
            on = on[~hit]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 for those that aren't among them."""
        slot = self._slot(keys)
        known = np.flatnonzero(slot >= 0)
        slot[known[self.keys[slot[known]] != keys[known]]] = -1
        return slot


class Dictionary:
    """Slots of words of languages, found by hashes and told apart by their bytes."""

    def __init__(self, lang: pa.Array, word: pa.Array, n: np.ndarray) -> None:
        coded = lang.cast(pa.large_string()).dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        parts = [w.encode() for w in word.to_pylist()]
        size = np.array([len(p) for p in parts], np.int64)
        at = np.cumsum(size) - size
        raw = np.frombuffer(b"".join([*parts, b"\0"]), np.uint8)
        t = Texts(0, raw, np.array([0, len(raw)]), at, at + size, np.zeros(len(at), np.int64), np.array([0, len(at)]))
        key = splitmix(t.hashes(lower=True) ^ _salts(names)[code])
        _, first = np.unique(key, return_index=True)
        self.slots = Slots(key[first])
        place = np.full(len(key), -1, np.int64)
        place[first] = self.slots.find(key[first])
        more = np.flatnonzero(place < 0)  # words that share a hash with another one
        place[more] = len(first) + np.arange(len(more))
        self.extra = {(names[code[i]], parts[i]): int(place[i]) for i in more.tolist()}
        self.twice = np.unique(key[more])
        order = np.argsort(place)
        self.names, self.lang, self.size, self.at, self.raw = names, code[order], size[order], at[order], raw
        self.words, self.n = word.take(pa.array(order)), n[order]

    def __len__(self) -> int:
        return len(self.size)

    def find(self, t: Texts, langs: np.ndarray, names: list[str]) -> np.ndarray:
        """Slots of a pass's words, -1 for those that aren't here."""
        h, lang = _keyed(t, langs, _salts(names))
        slot = self.slots.find(h)
        own = {x: i for i, x in enumerate(self.names)}
        code = np.array([own.get(x, -1) for x in names], np.int64)
        size, low = t.end - t.start, _LOWER[t.raw]
        at = np.flatnonzero(slot >= 0)
        good = (self.size[slot[at]] == size[at]) & (self.lang[slot[at]] == code[lang[at]])
        slot[at[~good]] = -1
        at = at[good]
        slot[at[_differ(low, t.start[at], self.raw, self.at[slot[at]], size[at])]] = -1
        for i in np.flatnonzero((slot < 0) & np.isin(h, self.twice)).tolist() if self.extra else ():
            slot[i] = self.extra.get((names[lang[i]], low[t.start[i] : t.end[i]].tobytes()), -1)
        return slot


def _rows(ids: np.ndarray) -> pa.Array:
    """Runs of numbers with -1 between them, in rows of about ROW numbers."""
    gaps = np.flatnonzero(ids < 0)
    cuts = gaps[np.minimum(np.searchsorted(gaps, np.arange(ROW, len(ids), ROW)), len(gaps) - 1)] if len(gaps) else gaps
    at = np.unique(np.concatenate([[0], cuts, [len(ids)]]))
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((4 * at).astype(np.int64).tobytes()), pa.py_buffer(ids.astype("<i4").tobytes())])


def _in_runs(ids: np.ndarray, followed: np.ndarray) -> np.ndarray:
    """Only runs of two and more known numbers that follow one another, with a -1 after each."""
    known = ids >= 0
    on = np.zeros(len(ids), bool)
    on[:-1] = followed[:-1] & known[:-1] & known[1:]  # goes on
    keep = on.copy()
    keep[1:] |= on[:-1]
    ends = keep & ~on
    out = np.full(int(keep.sum() + ends.sum()), -1, np.int64)
    out[np.arange(int(keep.sum())) + (np.cumsum(ends[keep]) - ends[keep])] = ids[keep]
    return out


def _coded_texts(texts: DataFrame, words: Broadcast, base: int, last: bool) -> DataFrame:
    """Texts (lang, text, ids) with the numbers of a shard's words filled in; the last shard's job makes runs (ids) of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, langs = _languages(batch)
            text, known = text_column(batch, "text"), column(batch, "ids")
            each: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
            done = np.zeros(batch.num_rows, np.int64)
            for t, followed in _passes(text):
                slot = words.value.find(t, langs, names)
                ids = np.where(slot >= 0, slot + base, -1)
                if base:
                    for k in range(t.n):
                        a, b = t.word_at[k], t.word_at[k + 1]
                        before = np.frombuffer(known[t.first + k].as_py() or b"", "<i4")[done[t.first + k] :][: b - a]
                        ids[a:b] = np.where(before >= 0, before, ids[a:b])
                        done[t.first + k] += b - a
                if last:
                    yield pa.RecordBatch.from_arrays([_rows(_in_runs(ids, followed)).cast(pa.binary())], names=["ids"])
                else:
                    for k in range(t.n):
                        each[t.first + k].append(ids[t.word_at[k] : t.word_at[k + 1]].astype("<i4").tobytes())
            if not last:
                yield pa.RecordBatch.from_arrays([column(batch, "lang"), column(batch, "text"), pa.array([b"".join(x) for x in each], pa.binary())], names=["lang", "text", "ids"])

    return texts.mapInArrow(run, "ids binary" if last else "lang string, text string, ids binary")


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The numbers of many rows of runs at once, with a -1 after each row."""
    held, n, gap = [], 0, np.full(1, -1, "<i4")
    for batch in batches:
        for data in column(batch, "ids"):
            held += [np.frombuffer(data.as_buffer(), "<i4"), gap]
            n += len(held[-2]) + 1
            if n > PART:
                yield np.concatenate(held).astype(np.int64)
                held, n = [], 0
    if n:
        yield np.concatenate(held).astype(np.int64)


def _phrase_keys(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where phrases of a size begin, and their numbers as two of 64 bits: of the last two words, and of those before."""
    n = len(ids) - size + 1
    known = ids >= 0
    at = np.flatnonzero(np.logical_and.reduce([known[k : k + n] for k in range(size)])) if n > 0 else np.zeros(0, np.int64)
    pair = lambda k: ids[at + k] << 32 | ids[at + k + 1]
    return at, (np.zeros(len(at), np.int64) if size == 2 else ids[at] if size == 3 else pair(0)), pair(size - 2)


def _mixed(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return splitmix(lo.astype(U64) ^ splitmix(hi))


class Filter:
    """Bits that tell most phrases that aren't among some (as a Bloom filter of two hashes). size: of the phrases."""

    def __init__(self, size: int, bits: np.ndarray, n: int) -> None:
        self.size, self.bits, self.n = size, bits, n

    @staticmethod
    def places(hi: np.ndarray, lo: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mixed(hi, lo)
        return (h % U64(n)).astype(np.int64), (splitmix(h) % U64(n)).astype(np.int64)

    def longer(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """_phrase_keys of a word more, of those whose first words and whose last words are let through."""
        at, hi, lo = _phrase_keys(ids, self.size)
        first, second = self.places(hi, lo, self.n)
        passed = np.flatnonzero(_bit(self.bits, first))
        passed = passed[_bit(self.bits, second[passed])]
        through = np.zeros(len(ids), bool)
        through[at[passed]] = True
        at, hi, lo = _phrase_keys(np.where(_spread(through, self.size), ids, -1), self.size + 1)
        some = through[at] & through[at + 1]
        return at[some], hi[some], lo[some]


def _spread(on: np.ndarray, size: int) -> np.ndarray:
    """Which places lie within `size` from one that is on, itself included."""
    out = on.copy()
    for k in range(1, size):
        out[k:] |= on[:-k]
    return out


def _bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _added(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct phrases with their numbers; two that share a hash may come in several rows."""
    h = _mixed(hi, lo)
    order = np.argsort(h)
    hi, lo = hi[order], lo[order]
    at = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])) if len(hi) else np.zeros(0, np.int64)
    return hi[at], lo[at], np.diff(np.append(at, len(hi)))


def _gathered(phrases: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(hi, lo, n) of phrases (hi, lo), added up by about GATHERED; a batch is HANDED rows at most."""
    held, n = [], 0
    for part in itertools.chain(phrases, [None]):
        if part is not None:
            held.append(part)
            n += len(part[0])
        if n > GATHERED or part is None and n:
            hi, lo = (np.concatenate(x) for x in zip(*held, strict=True))
            held, n, part = [], 0, None
            cols = _added(hi, lo)
            del hi, lo
            for at in range(0, len(cols[0]), HANDED):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + HANDED]) for c in cols], names=["hi", "lo", "n"])
            del cols


def _counted(runs: DataFrame, size: int, known: Broadcast | None) -> DataFrame:
    """(hi, lo, a) of the frequent phrases of a size. known: a filter of those of a word less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered((_phrase_keys(ids, size) if known is None else known.value.longer(ids))[1:] for ids in _flat(batches))

    each = runs.mapInArrow(run, "hi long, lo long, n long")
    return each.groupBy("hi", "lo").agg(F.sum("n").alias("a")).where(F.col("a") >= LEAST)


def _filter(phrases: DataFrame, size: int) -> Filter:
    """A filter of phrases (hi, lo), made in pieces; its bits come to the driver."""
    n = int(min(RANGE, max(64, FAN * phrases.count())))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(Filter.places(*(column(batch, c).to_numpy() for c in ("hi", "lo")), n)))
            piece = at // (8 * PIECE)
            cuts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])) if len(at) else np.zeros(0, np.int64)
            data = [x.astype("<i4").tobytes() for x in np.split(at % (8 * PIECE), cuts[1:])] if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array(piece[cuts], pa.int32()), pa.array(data, pa.binary())], names=["piece", "data"])

    def packed(table: pa.Table) -> pa.Table:
        bits = np.zeros(8 * PIECE, bool)
        for data in table.column("data"):
            bits[np.frombuffer(data.as_buffer(), "<i4")] = True
        return pa.table({"piece": table.column("piece").slice(0, 1), "data": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    kind = "piece int, data binary"
    out = np.zeros((n + 7) // 8, np.uint8)
    for r in phrases.select("hi", "lo").mapInArrow(places, kind).groupBy("piece").applyInArrow(packed, kind).collect():
        out[r.piece * PIECE : (r.piece + 1) * PIECE] = np.frombuffer(r.data, np.uint8)[: len(out) - r.piece * PIECE]
    return Filter(size, out, n)


def _sharded(df: DataFrame, n: int, *key: str) -> list[DataFrame]:
    """Parts of df by hashes of distinct keys, of SLOTS rows on average."""
    k = max(1, math.ceil(n / SLOTS))
    return [df] if k == 1 else [df.where(F.pmod(F.xxhash64(*key), F.lit(k)) == i) for i in range(k)]


def _number_words(docs: DataFrame, frequent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered words (slot, lang, word, a), and runs (ids) of the numbers of neighbouring ones in texts."""
    sc = docs.sparkSession.sparkContext
    texts, words, base = docs.withColumn("ids", F.lit(None).cast("binary")), None, 0
    shards = _sharded(frequent, frequent.count(), "lang", "word")
    for i, shard in enumerate(shards):
        t = shard.toArrow().combine_chunks()
        cols = [t.column(c).combine_chunks() if t.num_rows else pa.array([], t.schema.field(c).type) for c in ("lang", "word")]
        held = Dictionary(*cols, t.column("n").to_numpy())
        sent = sc.broadcast(held)
        before = texts
        texts = stored(_coded_texts(texts, sent, base, i == len(shards) - 1), "collocations-runs")
        if i:
            discard(before)
        numbered = stored(_numbered(shard, sent, base), "collocations-words")
        words = numbered if words is None else words.unionByName(numbered)
        base += len(held)
        sent.destroy()
    if base >= 1 << 31:
        raise ValueError("more than 2^31 frequent words")
    return words, texts


def _numbered(shard: DataFrame, words: Broadcast, base: int) -> DataFrame:
    """A shard's words (lang, word, n) with their numbers, looked up as those of texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, langs = _languages(batch)
            word = text_column(batch, "word")
            n = len(word)
            _, offsets, data = word.buffers()
            at = np.frombuffer(offsets, np.int64)[word.offset : word.offset + n + 1]
            raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
            at = at - at[0]
            t = Texts(0, raw, at, at[:-1], at[1:], np.arange(n), np.arange(n + 1))
            slot = words.value.find(t, langs, names)
            yield pa.RecordBatch.from_arrays([pa.array(slot + base), column(batch, "lang"), column(batch, "word"), column(batch, "n")], names=["slot", "lang", "word", "a"])

    return shard.mapInArrow(run, "slot long, lang string, word string, a long")


def _slot(hi: Column, lo: Column) -> Column:
    return F.struct(hi.cast("long").alias("hi"), lo.cast("long").alias("lo"))


def _halves(size: int) -> tuple[Column, Column]:
    """Slots of a phrase (hi, lo) without its last and without its first word."""
    hi, lo, none = F.col("hi"), F.col("lo"), F.lit(0)
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda c: F.shiftrightunsigned(c, 32)
    if size == 2:
        return _slot(none, high(lo)), _slot(none, low(lo))
    before = F.shiftleft(low(hi), 32).bitwiseOR(high(lo))
    return _slot(none if size == 3 else high(hi), before), _slot(none if size == 3 else low(hi), lo)


def _levels(runs: DataFrame) -> Iterator[DataFrame]:
    """Frequent phrases (slot, x, y, a) of each size; x and y: slots of the phrases that they are without their last
    and without their first word."""
    sc, known = runs.sparkSession.sparkContext, None
    for size in range(2, LONGEST + 1):
        found = stored(_counted(runs, size, known), "collocations-counts")
        if known is not None:
            known.destroy()
        known = sc.broadcast(_filter(found, size)) if size < LONGEST else None
        x, y = _halves(size)
        yield found.select(_slot(F.col("hi"), F.col("lo")).alias("slot"), x.alias("x"), y.alias("y"), "a")


def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def _cut(k: int, left: Column, right: Column) -> Column:
    """(score, k, l, r) of a cut after k words."""
    score = F.call_function("div", _exact("a") * F.lit(SCALE).cast("decimal(10,0)"), _exact(left) + _exact(right))
    return F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))


def _phrases(levels: list[DataFrame]) -> list[DataFrame]:
    """(slot, lang, words, a, first, head, tail, last, x, y, cut) of the phrases of each length, from words
    (slot, lang, word, a) and pairs of the level before. first and last: the outer words' counts;
    head and tail: those of the first two words and the last two; x and y: what a pair is made of."""
    words = levels[0].select(_slot(F.lit(0), F.col("slot")).alias("slot"), "lang", F.array("word").alias("words"), "a", F.col("a").alias("first"), F.col("a").alias("last"))
    out, below = [], words
    for size, pairs in enumerate(levels[1:], 2):
        left = below.select(*(F.col(c).alias(f"x_{c}") for c in below.columns))
        right = below.drop("lang").select(*(F.col(c).alias(f"y_{c}") for c in below.columns if c != "lang"))
        both = pairs.join(left, F.col("x") == F.col("x_slot")).join(right, F.col("y") == F.col("y_slot"))
        first, last = F.col("x_first"), F.col("y_last")
        cuts = [_cut(1, first, F.col("y_a")), *([_cut(2, F.col("x_head"), F.col("y_tail"))] if size == 4 else []), *([_cut(size - 1, F.col("x_a"), last)] if size > 2 else [])]
        cut = F.array_min(F.array(*cuts)) if len(cuts) > 1 else cuts[0]
        head = F.col("x_head") if size > 2 else F.col("a")
        tail = F.col("y_tail") if size > 2 else F.col("a")
        below = both.select("slot", F.col("x_lang").alias("lang"), F.concat("x_words", F.slice("y_words", -1, 1)).alias("words"), "a", first.alias("first"), last.alias("last"), head.alias("head"), tail.alias("tail"), "x", "y", cut.alias("cut"))
        below = stored(below, "collocations-phrases")
        out.append(below)
    return out


def _dropped(phrases: list[DataFrame]) -> list[DataFrame]:
    """Of each length the phrases that aren't mostly part of a longer one."""
    out = []
    for i, p in enumerate(phrases):
        within, up = [], None
        for longer in phrases[i + 1 :]:
            # slots of this length inside of a longer phrase: its two halves', and theirs
            halves = longer.select("slot", "a", F.explode(F.array("x", "y")).alias("part")) if up is None else longer.select("slot", "a", F.explode(F.array("x", "y")).alias("half")).join(up.select(F.col("slot").alias("half"), "part"), "half").select("slot", "a", "part")
            within.append(halves.select("part", "a"))
            up = halves.select("slot", "part").distinct()
        if within:
            most = functools.reduce(DataFrame.unionByName, within).groupBy("part").agg(F.max("a").alias("most"))
            p = p.join(most, F.col("slot") == F.col("part"), "left")
            p = p.where(F.col("most").isNull() | (_exact("most") * 100 < _exact("a") * WITHIN))
        out.append(p)
    return out


def collocations(docs: DataFrame, top: int | None = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases, all of them without `top`.

    a: occurrences of the phrase, n: of all words of the language; l, r: of the parts at the cut with the lowest
    score, of equals the first. A null language counts as "und", null texts have no words. Rows count each,
    whatever their ids; without a frequent pair there is no row.
    """
    docs.sparkSession.sparkContext.environment.update(WORKERS)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    counted = stored(count_words(texts).where(F.col("word").isNull() | (F.col("n") >= LEAST)), "collocations-counted")
    totals = counted.where("word is null").select(F.col("lang").alias("of"), F.col("n").alias("total"))
    words, runs = _number_words(texts, counted.where("word is not null"))
    levels = [words, *_levels(runs)]
    discard(runs)
    kept = [p.select("lang", F.concat_ws(" ", "words").alias("phrase"), "a", "cut.l", "cut.r", "cut.score") for p in _dropped(_phrases(levels))]
    every = functools.reduce(DataFrame.unionByName, kept)
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    if top is not None:  # the best of parts of a language first, so that its best are found among few
        parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
        every = every.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(totals, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
