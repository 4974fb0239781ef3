"""Collocations against plain loops, with one shard and one range and with many."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quireworks.llm import collocations as C

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "n long, lang string, phrase string, text string, doc_id long"


def expected(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    c = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in c.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                part = (lang, w[i : i + size])
                if 100 * a >= 80 * c[part]:
                    gone.add(part)
    out = {}
    for (lang, w), a in c.items():
        if (lang, w) not in gone:
            cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {
        (lang, rank, p.decode(), -a, l, r, n[lang], -score)
        for lang, each in out.items() for rank, (score, a, p, l, r) in enumerate(sorted(each)[:top], 1)
    }


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocab = ["the", "of", "New", "York", "city", "État", "日本", "a b", "x" * 300, "to", "be", "or", "not", "end\x0bof", "tab"]
    phrases = [["new", "york", "city"], ["to", "be", "or", "not"], ["a", "a", "a", "a", "a", "a"], ["one", "two"], ["État", "日本", "of", "the"]]
    out = []
    for lang in ("en", None, "und", "日", ""):
        for _ in range(25):
            words = []
            for _ in range(rng.randint(1, 60)):
                words += rng.choice(phrases) if rng.random() < 0.4 else [rng.choice(vocab)]
            text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " \r\n"]) for w in words)
            out.append((lang, text.upper() if rng.random() < 0.1 else text))
    return [*out, ("en", None), (None, ""), (None, None), ("en", " ., \n"), ("rare", "once upon a time"), *[("en", "same row again " * 3)] * 40]


def frame(spark, rows):
    return spark.createDataFrame([(1, lang, "p", text, i // 2) for i, (lang, text) in enumerate(rows)], SCHEMA).repartition(5)


def test_collocations(spark, rows):
    got = C.collocations(frame(spark, rows))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got, want = [tuple(r) for r in got.collect()], expected(rows)
    assert len(got) == len(want) > 40 and set(got) == want
    assert {len(p.split(" ")) for _, _, p, *_ in got} == {2, 3, 4}


def test_shards_ranges_and_trees(spark, rows, monkeypatch):
    for name, value in {"SLOTS": 12, "RANGE": 4000, "FAN": 2, "ROW": 16, "PASS_BYTES": 500, "GATHERED": 300}.items():
        monkeypatch.setattr(C, name, value)
    assert {tuple(r) for r in C.collocations(frame(spark, rows), top=7).collect()} == expected(rows, top=7)


def test_runs_are_read_as_often_whatever_their_length(spark, rows, monkeypatch):
    """Once for each size of phrase, and not once more for so many positions of the corpus."""
    made = []
    keep = C.stored
    monkeypatch.setattr(C, "stored", lambda df, name: made.append(name) or keep(df, name))
    results = []
    for most in (1 << 28, 64):
        made.clear()
        monkeypatch.setattr(C, "RANGE", most)
        results.append(({tuple(r) for r in C.collocations(frame(spark, rows)).collect()}, list(made)))
    assert results[0] == results[1]
    assert sum("counts" in name for name in results[1][1]) == 3


def test_empty(spark):
    assert C.collocations(frame(spark, [])).collect() == []
    assert C.collocations(frame(spark, [(None, None), ("en", "a b c d e f g"), ("en", "a a a a a")])).collect() == []


def test_slots():
    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 63, 64, 65, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        s = C.Slots(keys)
        assert sorted(s.find(keys).tolist()) == list(range(len(keys)))
        others = np.setdiff1d(rng.integers(0, 1 << 63, 1000, dtype=np.uint64), keys)
        assert (s.find(others) == -1).all()


def test_words_with_one_hash(monkeypatch):
    """Words are told apart even if all hashes were equal."""
    monkeypatch.setattr(C.Texts, "hashes", lambda self, lower: np.zeros(len(self.start), np.uint64))
    words = ["one", "two", "tw", "six"]
    d = C.Dictionary(pa.array(["en", "en", "en", "fr"]), pa.array(words), np.arange(4))
    (t, _), = C._passes(pa.array(["one two tw six ONE none"], pa.large_string()))
    found = d.find(t, np.zeros(1, np.int64), ["en"])
    assert found[0] == found[4] >= 0 and len(set(found[:3].tolist())) == 3 and min(found[:3]) >= 0 and found[3] == found[5] == -1
    table = C._distinct_words(t, np.zeros(1, np.int64), ["en"], C._salts(["en"])).group_by("word").aggregate([("n", "sum")]).to_pydict()
    assert dict(zip(table["word"], table["n_sum"], strict=True)) == {"one": 2, "two": 1, "tw": 1, "six": 1, "none": 1}


def test_large_numbers_are_exact(spark):
    big = 6_000_000_000_000_000_000
    row = spark.range(1).selectExpr(f"{big}L AS a", f"{big}L AS l", f"{big + 1}L AS r").select(C._cut(1, C.F.col("l"), C.F.col("r")).alias("c")).first()
    assert row.c.score == 2_000_000 * big // (2 * big + 1)


def test_tasks_hold_bounded_arrays():
    """Numbers of many rows of runs are looked at by a quarter of a million, and phrases handed on in small batches."""
    row = np.arange(2048, dtype="<i4").tobytes()
    batches = [pa.RecordBatch.from_arrays([pa.array([row] * 300, pa.binary())], names=["ids"]) for _ in range(3)]
    parts = list(C._flat(iter(batches)))
    assert max(map(len, parts)) < 300_000 and sum(map(len, parts)) == 900 * 2049
    some = np.arange(150_000)
    out = list(C._gathered((some * 0, some % 100_000) for _ in range(9)))
    assert max(b.num_rows for b in out) <= 1 << 16
    n = Counter()
    for b in out:
        for lo, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            n[lo] += k
    assert n[0] == 18 and n[99_999] == 9 and sum(n.values()) == 9 * 150_000
