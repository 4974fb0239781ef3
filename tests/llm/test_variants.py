"""Spelling variants against plain loops over small vocabularies."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quireworks.llm import variants

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "n long, doc_id long, text string, word int"


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def expected(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    out = {}
    for w in n:
        near = sorted((-n[v], v) for v in n if one_apart(w, v))
        form = near[0][1] if near and n[near[0][1]] >= 2 * n[w] else None
        out[w] = [w, form, None, n[w], len(near), n[form] if form else None]
    for w in out:
        at = w
        while out[at][1]:
            at = out[at][1]
        out[w][2] = at
    return {tuple(x) for x in out.values()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    stems = ["abcab", "abcde", "bcdea", "éabcd", "ÿéÀab", "aaaaa", "aaaaaa", "aaaaaaa", "bbbbbbbb", "abcdefghij"]
    words = list(stems)
    for w in stems * 12:
        i = rng.randrange(len(w) + 1)
        words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1 :]]))
    weights = [rng.choice([1, 2, 4, 9, 30]) for _ in words]
    out = [(i, " ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(words, weights, k=rng.randint(1, 300)))) for i in range(60)]
    long = "x" * 3000
    out += [(None, None), (7, ""), (7, "—, 12 \n"), (None, "abcde abcde"), (7, "abcde abcde"), (90, f"{long} {long}y, {long} {long}y {long} {long}y"), (91, "abc1abcde_abcde×abcdef日abcde")]
    return out


def test_variants(spark, rows):
    docs = spark.createDataFrame([(i, d, t, 0) for i, (d, t) in enumerate(rows)], SCHEMA).repartition(3)
    want = expected(rows)
    got = variants.group_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(want) > 60 and set(got) == want
    assert any(r[2] not in (r[0], r[1]) for r in got)  # a root further than the form


def test_shards(spark, rows, monkeypatch):
    monkeypatch.setattr(variants, "SHARD_WORDS", 40)
    monkeypatch.setattr(variants, "AT_ONCE", 2)
    monkeypatch.setattr(variants, "TASK_WORDS", 30)
    docs = spark.createDataFrame([(i, d, t, 0) for i, (d, t) in enumerate(rows)], SCHEMA)
    assert {tuple(r) for r in variants.group_variants(docs).collect()} == expected(rows)


def test_empty(spark):
    assert variants.group_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert variants.group_variants(spark.createDataFrame([(1, 1, None, 1), (1, 2, "a b", 1)], SCHEMA)).collect() == []


def test_tries():
    rng = random.Random(2)
    for _ in range(150):
        letters = rng.choice(["ab", "abc", "aéÿ", "abcdef"])
        words = sorted({"".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(rng.randint(0, 50))})
        asked = sorted({"".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(25)} | set(words[:20]))
        shuffled = rng.sample(words, len(words))
        trie = variants.Trie(pa.array(shuffled, pa.string()), np.arange(len(words)))
        i, j = trie.near(variants.Strings(pa.array(asked, pa.string())))
        got = sorted((asked[a], trie.words[b].as_py()) for a, b in zip(i.tolist(), j.tolist(), strict=True))
        assert got == sorted((a, b) for a in asked for b in words if one_apart(a, b))
        assert len(trie.end) <= 1 + sum(map(len, words))


def test_roots(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(40)] + [(f"x{i}", "w7") for i in range(30)]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {a: "w40" for a, _ in chain}
