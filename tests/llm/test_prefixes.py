"""Counts at prefixes of texts whose code points merge when they are normalised."""

import random
import time

import public_tokenizers
import pytest
import tokenizers

from quireworks.llm.prefixes import PrefixCounter

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["é", "日", "本", "語", "́", "İ", "a", "'s", "'", "ś", "ś", "!", "2", "ᄀ", "ᅡ", "ᆨ", "각", "̈̈́", "Å", "ſ", "Σ", "q̣̇", "ো", "ab", "ཱི", "ཱི", "ﬁ"]


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(PATH)


@pytest.fixture(scope="module")
def size():
    t = tokenizers.Tokenizer.from_file(str(PATH))
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_short_runs(counter, size):
    rng = random.Random(2)
    for _ in range(150):
        text = "".join(rng.choices(PARTS, k=rng.randint(1, 14)))
        assert counter.run_counts(text) == [size(text[:i]) for i in range(1, len(text) + 1)], text


def test_long_words(counter, size):
    rng = random.Random(3)
    for _ in range(15):
        text = "".join(x + rng.choice(["", "", "", "é", "'", "ś", "각", "!"]) for x in "日本語文字" * rng.randint(15, 40))
        assert counter.run_counts(text) == [size(text[:i]) for i in range(1, len(text) + 1)], text


def test_a_very_long_run_with_combining_marks(counter, size):
    text = "".join("日本語文字全部言葉は"[i % 10] + ("é" if i % 10 == 0 else "") for i in range(100_000))
    began = time.time()
    got = counter.run_counts(text)
    assert time.time() - began < 10
    for i in [*random.Random(4).sample(range(1, len(text)), 10), len(text)]:
        assert got[i - 1] == size(text[:i])
