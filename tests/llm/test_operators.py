"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quireworks.llm import ctw, jaccard, neighbours, packing, passages, pieces, prefixes, quality, rans, tokens, warc, words as texts_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, bin int, key string, n long, counts string"


def words(t):
    return WORDS.findall((t or "").translate(LOWER))


def text(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = [text(rng, 120, 100_000) for _ in range(6)]
    passage = text(rng, 70, 100_000)
    out = [None, "", "  \n ", "One two", "one TWO", "Ünï 日本 🦄\x00 <|endoftext|> <s>", "x" * 5000, text(rng, 6000)]
    for b in base:
        near = b.split()
        near[30] = "changed"
        out += [b, b, " ".join(near), b.upper()]
    out += [text(rng, 80, 100_000) + " " + passage + " " + text(rng, 80, 100_000) for _ in range(3)]
    out += [text(rng, 60, 100_000) for _ in range(10)]
    return [(3 * i + 1, t, 0, "k", 5, "c") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_sentencepiece(docs, none, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(pieces.digests(pieces.encode_pieces(docs, path)))
    for i, t, *_ in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert pieces.encode_pieces(none, path).count() == 0
    m = pieces.model(path)
    for t in ("", " ", "   a", "a   b", "\n\t", "▁x▁▁", "日本\x00", "<0x41>"):
        assert np.frombuffer(m.encode(t), "<u4").tolist() == sp.encode(t, add_bos=True, add_eos=True)


def test_jaccard_join(docs, none, rows):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                lo, hi = sorted((group[a], group[b]))
                group = {k: lo if v == hi else v for k, v in group.items()}
    got = by_id(jaccard.classes(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), group[i]) for i, s in sets.items()}
    assert jaccard.classes(none).count() == 0


def shingle_set(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked_classes(sets):
    """Least index reachable by links, by comparing all pairs."""
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                lo, hi = sorted((group[a], group[b]))
                group = [lo if g == hi else g for g in group]
    return group


def test_jaccard_join_of_families(spark, monkeypatch):
    """Large families of near copies, long lists in several blocks, sets of very unlike sizes, texts of
    several thousand words that share half of their shingles, and columns named like the join's own."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "FREQUENT", 8)
    rng = random.Random(12)
    out = []
    for size, copies in ((60, 90), (200, 40), (12, 30)):
        base = text(rng, size, 100_000).split()
        for _ in range(copies):
            near = list(base)
            for _ in range(rng.randrange(0, 4)):
                near[rng.randrange(size)] = f"n{rng.randrange(10**9)}"
            out.append(" ".join(near))
    shared = text(rng, 1500, 10**6)
    out += [shared + " " + text(rng, 1500, 10**6) for _ in range(6)] + [shared + " " + text(rng, k, 10**6) for k in (100, 200, 380, 420)]
    out += ["a b c", "A  b C", "a b c d", text(rng, 6, 9)]
    rng.shuffle(out)
    docs = spark.createDataFrame([(i, t, 0, "k", 5, "c") for i, t in enumerate(out)], SCHEMA).repartition(5)
    got = by_id(jaccard.classes(docs))
    sets = [shingle_set(t) for t in out]
    assert [got[i].component_id for i in range(len(out))] == linked_classes(sets)
    assert [got[i].n_shingles for i in range(len(out))] == list(map(len, sets))


def test_jaccard_join_of_odd_ids(spark):
    """Rows without an id have no class; rows that share one are of one class, whatever their texts."""
    rng = random.Random(13)
    a, b, c = (text(rng, 40, 10**6) for _ in range(3))
    rows = [(None, a), (None, None), (7, a), (3, a), (7, b), (9, b), (5, c), (5, c), (8, c + " more"), (2, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 36, None), (None, 0, None), (7, 36, 3), (3, 36, 3), (7, 36, 3), (9, 36, 3), (5, 36, 5), (5, 36, 5), (8, 37, 5), (2, 0, 2)], key=str)


def test_tree_loses_no_pair():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 6, (500, jaccard.GROUPS))
    points[250:] = points[:250] + rng.integers(0, 2, (250, jaccard.GROUPS)) * (rng.random((250, 1)) < 0.5)
    sizes = points.sum(axis=1)
    found = {tuple(sorted(p)) for a, b, _ in jaccard.Tree(points, sizes).pairs() for p in zip(a.tolist(), b.tolist(), strict=True)}
    for i in range(500):
        bound = np.minimum(points[i], points[i + 1 :]).sum(axis=1)
        wanted = np.flatnonzero(bound >= jaccard._needed(sizes[i], sizes[i + 1 :])) + i + 1
        assert all((i, j) in found for j in wanted.tolist())


def test_warc(spark):
    big = "<p>" + "ä" * 800
    pages = spark.createDataFrame([(1, "http://a", big, 0), (2, None, big, 0), (3, "u", "small", 0), (4, "u", "small", 0), (5, "u", None, 0), (6, "u\r\nx: y", "\r\n\r\nWARC/1.1\r\n\r\n", 0), (9, "u", big, 0)], "page_id long, url string, html string, size int").repartition(3)
    got = by_id(warc.archive_pages(pages.drop("size")), "page_id")
    assert len(got) == 7
    sha = hashlib.sha1(big.encode()).hexdigest()
    assert [(got[i].record_type, got[i].refers_to, got[i].payload_digest, got[i].payload_bytes) for i in (1, 2, 9)] == [("revisit", 9, sha, 1603), ("revisit", 9, sha, 1603), ("response", None, sha, 1603)]
    assert got[3].record_type == got[4].record_type == "response" and got[5].payload_bytes == 0
    rows = [(None, "u", big), (None, None, "s"), (8, "u", big), (8, "u", big), (3, "u", big)]
    odd = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in odd), key=str) == sorted([(None, "response", None), (None, "response", None), (8, "response", None), (8, "response", None), (3, "revisit", 8)], key=str)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_archives_are_limited_and_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    monkeypatch.setattr(warc, "READ_BYTES", 1000)
    pages = spark.range(60).selectExpr("id page_id", "'u' url", "repeat(sha1(string(id)), 30) html").coalesce(1)
    folder = warc.new_folder(spark, "test-warc")
    written = warc.write_archives(pages, folder)
    assert written.count() > 10 and written.agg(F.max("records")).first()[0] < 10
    index = warc.normalise_archives(written, folder)
    read = warc.read_archives(index, folder)
    assert read.rdd.getNumPartitions() > 10 and read.count() == 60


def test_normaliser_streams():
    records = [warc.record(i, "u", hashlib.sha1(b"x" * i).hexdigest(), i, b"x" * i, None) for i in range(0, 3000, 97)]
    data = b"".join(warc.one_stream(iter(records)))
    made = [*warc.normalise(data[i : i + 100] for i in range(0, len(data), 100))]
    assert [zlib.decompress(m, 31) for m, _ in made] == records
    whole = b"".join(m for m, _ in made)
    assert all(zlib.decompress(whole[e["offset"] : e["offset"] + e["length"]], 31) == r for (_, e), r in zip(made, records, strict=True))
    with pytest.raises(ValueError):
        [*warc.split_records(iter([records[0][:-1]]))]


def ids_of(name, rows, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, end] for i, x, *_ in rows}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_run_ids_do_not_rest_on_hashes(monkeypatch, name):
    """Ids are right for texts that a polynomial hash confuses, and with hashes that are all alike."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    swap = str.maketrans("ab", "ba")
    word = "a"
    for _ in range(11):
        word += word.translate(swap)
    texts = [word, word.translate(swap), "The cat  the dog", "<|endoftext|> x\u00a0y", "", " \n"]
    path = public_tokenizers.path(name)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for alike in (False, True):
        if alike:
            monkeypatch.setattr(texts_of.Texts, "span_hashes", lambda self, start, end, lower: np.full(len(start), 5, np.uint64))
        for t in texts_of.passes(pa.array(texts, pa.large_string())):
            ids, n = tokens.RunEncoder(path).encode(t)
            assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_packing(docs, none, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    want = ids_of("word_bpe_49k.json", rows, 1)
    got = packing.pack(docs, path, 1, size=256, keep_ids=True).collect()
    at = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.start == at[r.doc_id] and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and bytes(r.ids) == np.array(ids, "<u4").tobytes()
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in want.items()}
    full = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full[r.sequence_id]
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 256
    assert packing.pack(none, path, 1).count() == 0


def test_patterns_hold_every_piece_with_little_padding():
    rng = np.random.default_rng(3)
    for n in (1, 7, 5000):
        h = collections.Counter(rng.integers(1, 257, n).tolist())
        chosen = packing.plan(dict(h), 256)
        held = sum(p * k for p, k in chosen)
        assert all(held[c] == k for c, k in h.items()) and all((p * np.arange(257)).sum() <= 256 for p, _ in chosen)
    assert sum(k for _, k in chosen) <= 1.01 * sum(c * k for c, k in h.items()) / 256 + 1


def test_passages(docs, none, rows):
    got = passages.repeated_passages(docs).collect()
    seen, want = {}, set()
    for i, t, *_ in rows:
        w = words(t)
        grams = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        for k, g in enumerate(grams):
            if seen.get(g, i) != i:
                want.add((i, k))
        for g in grams:
            seen.setdefault(g, i)
    spans = collections.defaultdict(list)
    for r in got:
        assert r.source_id < r.doc_id and r.similarity >= 0.75
        spans[r.doc_id].append((r.start_word, r.end_word))
    assert all(any(a <= k and k + 50 <= b for a, b in spans[i]) for i, k in want)
    clean = [i for i, t, *_ in rows[-10:]]
    assert not any(spans[i] for i in clean)
    left = by_id(passages.without_passages(docs, passages.repeated_passages(docs)))
    assert set(left[rows[0][0]].asDict()) == {"doc_id", "text", "bin", "key", "n", "counts"}
    assert all(left[i].text == t for i, t, *_ in rows[:8])
    assert passages.repeated_passages(none).count() == 0


def test_passages_among_stock_phrases(spark):
    """Passages of two texts each, with the least shingles of stock phrases that many texts have."""
    rng = random.Random(11)
    stock = [text(rng, 8, 100_000) for _ in range(5)]
    out = []
    for _ in range(60):
        w = text(rng, 50, 100_000).split()
        for k, p in zip((1, 11, 21, 31, 41), rng.sample(stock, 5), strict=True):
            w[k : k + 8] = p.split()
        out += [text(rng, 70, 100_000) + " " + " ".join(w) + " " + text(rng, 70, 100_000) for _ in range(2)]
    order = [*range(0, 120, 2), *range(1, 120, 2)]
    df = spark.createDataFrame([(i, out[k]) for i, k in enumerate(order)], "doc_id long, text string")
    spans = collections.defaultdict(list)
    for r in passages.repeated_passages(df).collect():
        spans[r.doc_id, r.source_id].append((r.start_word, r.end_word, r.source_start))
    for i in range(60):
        assert any(a <= 70 and 120 <= b for a, b, _ in spans[60 + i, i])


def test_near_copies_of_passages_are_found(spark, monkeypatch):
    """Passages of 60 words with words changed, in pairs and among many copies: found and bounded."""
    monkeypatch.setattr(passages, "LOCAL", 3)
    rng = random.Random(21)
    rows, planted = [], []
    for k in range(60):
        passage = text(rng, 60, 10**6).split()
        copies = 2 if k % 4 else 12
        for j in range(copies):
            own = list(passage)
            for at in rng.sample(range(60), k % 3 if j else 0):
                own[at] = f"n{rng.randrange(10**9)}"
            before = text(rng, rng.randrange(0, 80), 10**6)
            rows.append((len(rows), f"{before} {' '.join(own)} {text(rng, 50, 10**6)}"))
            if j:
                planted.append((len(rows) - 1, len(before.split()), k % 3))
    rows += [(len(rows) + i, text(rng, 150, 10**6)) for i in range(40)]
    spans = collections.defaultdict(list)
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        spans[r.doc_id].append((r.start_word, r.end_word))
        assert r.source_id < r.doc_id and r.similarity >= 0.75 and r.end_word - r.start_word >= 50
    found = [any(min(e, at + 60) - max(s, at) >= 45 for s, e in spans[i]) for i, at, _ in planted]
    of = [[f for f, (_, _, changed) in zip(found, planted, strict=True) if changed == k] for k in range(2)]
    assert all(of[0]) and sum(of[1]) >= 0.95 * len(of[1])  # two changed words leave a similarity of 0.7 only
    assert set(spans) <= {i for i, *_ in planted}


@pytest.mark.parametrize("block", [4, 256])
def test_near_copies_that_share_a_phrase_are_found(spark, monkeypatch, block):
    """Pairs of near copies whose least shingles lie in a phrase that all have: lists are long, and all of them count."""
    monkeypatch.setattr(passages, "BLOCK", block)
    rng = random.Random(5)
    phrase = text(rng, 32, 10**6).split()
    first, second = [], []
    for _ in range(40):
        own = text(rng, 14, 10**6).split() + phrase + text(rng, 14, 10**6).split()
        other = list(own)
        other[rng.choice([5, 55])] = f"n{rng.randrange(10**9)}"
        first.append(f"{text(rng, 60, 10**6)} {' '.join(own)} {text(rng, 60, 10**6)}")
        second.append(f"{text(rng, 60, 10**6)} {' '.join(other)} {text(rng, 60, 10**6)}")
    rows = list(enumerate([*first, *reversed(second)]))
    spans = collections.defaultdict(list)
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        spans[r.doc_id, r.source_id].append((r.start_word, r.end_word))
    assert {(b, a) for a, b in ((k, 79 - k) for k in range(40)) if any(min(e, 120) - max(s, 60) >= 48 for s, e in spans[b, a])} == {(79 - k, k) for k in range(40)}
    assert len([k for k, v in spans.items() if v]) == 40


@pytest.mark.parametrize("block", [8, 256])
def test_links_of_a_common_passage_grow_with_its_texts(spark, monkeypatch, block):
    """A passage that all texts have, half of them with a word changed: each is linked, but not with all others."""
    monkeypatch.setattr(passages, "BLOCK", block)
    rng = random.Random(9)
    passage, rows = text(rng, 70, 10**6).split(), []
    for k in range(60):
        own = list(passage)
        if k % 2:
            own[rng.randrange(70)] = f"n{rng.randrange(10**9)}"
        rows.append((k, f"{text(rng, 60, 10**6)} {' '.join(own)} {text(rng, 60, 10**6)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).localCheckpoint()
    couples = passages._couples(docs, passages._told(passages._long_lists(docs, "doc_id", "text")), "doc_id", "text").localCheckpoint()
    met = passages._met_couples(couples, docs, "doc_id", "text").collect()
    assert couples.count() > 100 and len(met) < 8 * couples.count() and all(r.a < r.b for r in met)
    words_of = collections.defaultdict(set)
    for r in passages.repeated_passages(docs).collect():
        words_of[r.doc_id].update(range(r.start_word, r.end_word))
    assert min(len(words_of[k] & set(range(60, 130))) for k in range(1, 60)) >= 60  # words at its ends, beside a changed one, may stay


@pytest.mark.parametrize("most", [3, 1 << 15])
def test_texts_of_several_lists_are_compared_once(spark, monkeypatch, most):
    """Near copies of a passage of 300 words meet in many lists; those that a task holds link a text with each other one once."""
    monkeypatch.setattr(passages, "LIST", most)
    rng = random.Random(13)
    passage, rows = text(rng, 300, 10**6).split(), []
    for k in range(12):
        own = list(passage)
        own[rng.randrange(300)] = f"n{rng.randrange(10**9)}"
        rows.append((k, f"{text(rng, 60, 10**6)} {' '.join(own)} {text(rng, 60, 10**6)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).localCheckpoint()
    couples = passages._couples(docs, passages._told(passages._long_lists(docs, "doc_id", "text")), "doc_id", "text").localCheckpoint()
    links = passages._met_couples(couples, docs, "doc_id", "text").where("f = 0").collect()
    if most > 3:
        assert links and max(collections.Counter((r.a, r.b) for r in links).values()) <= 3
    words_of = collections.defaultdict(set)
    for r in passages.repeated_passages(docs).collect():
        words_of[r.doc_id].update(range(r.start_word, r.end_word))
    assert min(len(words_of[k] & set(range(60, 360))) for k in range(1, 12)) >= 290


def test_a_dense_part_of_a_longer_stretch_is_a_passage():
    """45 shared shingles in a row, beside parts where fewer are shared: the stretch as a whole isn't similar enough."""
    shared = [*[1] * 8, *[0] * 5, *[1] * 45, *[0] * 5, *[1] * 3, *[0] * 20]
    x = np.arange(1, len(shared) + 1, dtype=np.uint64)
    y = np.where(np.array(shared) > 0, x, x + np.uint64(1000))
    assert any(p <= 14 and q >= 56 and s >= 0.75 for p, q, _, _, s in passages.verify(x, y))


def test_a_class_is_linked_with_what_comes_between_its_members():
    """A content that others share nothing but a part of; 0 stands for shingles of one content."""
    x = np.arange(1, 61, dtype=np.uint32)
    y = x.copy()
    y[50] = 0
    apart = np.arange(100, 160, dtype=np.uint32)
    ids, last = np.array([1, 2, 3]), np.array([9, 9, 3])
    a, b = passages._needed([x, y, apart], ids, last, ids < last, 0)
    assert set(zip(a, b, strict=True)) == {(0, 0), (0, 1)} and passages._needed([x, y, apart], ids, ids, ids < 0, 0) == ([0], [1])


def test_pairs_of_windows_of_repeated_words_are_looked_at_in_parts(monkeypatch):
    t = next(texts_of.passes(pa.array(["a b c d e f " * 100, "x " * 300, "y"], pa.large_string())))
    want = passages._couples_of(t, None)
    monkeypatch.setattr(passages, "_TOGETHER", 50)
    assert all(np.array_equal(x, y) for x, y in zip(want, passages._couples_of(t, None), strict=True)) and len(want[0])


def test_long_equal_texts_are_one_span(spark):
    rng = random.Random(22)
    long_ = text(rng, 30_000, 10**6)
    got = passages.repeated_passages(spark.createDataFrame([(1, long_), (2, long_), (2, None), (None, long_)], "doc_id long, text string")).collect()
    assert max(r.end_word - r.start_word for r in got) == 30_000 and {r.doc_id for r in got} == {2}


def test_cutting_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b  c d", 7, "x"), (2, None, 8, "y"), (None, "t", 9, "z")], "doc_id long, text string, _id long, _cuts string")
    spans = spark.createDataFrame([(1, 1, 3, 0, 0, 2, 1.0), (1, 2, 3, 0, 0, 2, 1.0)], passages.SPANS)
    got = sorted(map(tuple, passages.without_passages(docs, spans).collect()), key=str)
    assert got == sorted([(1, "a d", 7, "x"), (2, None, 8, "y"), (None, "t", 9, "z")], key=str)


def test_run_hashes():
    x = np.random.default_rng(3).integers(1, 2**60, 200).astype(np.uint64)
    y = np.concatenate([x[100:160], x[:100]])
    h, g = passages.run_hashes(x), passages.run_hashes(y)
    assert len(h) == 200 - passages.RUN + 1 and h[100] == g[0] and h[114] == g[14] and h[0] == g[60]
    y[5] += np.uint64(1)
    assert not np.isin(passages.run_hashes(y)[:6], h).any() and not len(passages.run_hashes(x[: passages.RUN - 1]))


def test_compact_windows_cover_all_runs():
    rng = np.random.default_rng(5)
    x = rng.integers(1, 40, 120).astype(np.uint64)
    doc = np.repeat([0, 1, 3], [50, 5, 65])
    c, lo, hi = passages.compact_windows(x, doc, 8)
    for i in range(120):
        for j in range(i + 7, 120):
            if doc[i] == doc[j]:
                at = i + int(x[i : j + 1].argmin())
                assert [int(k) for k, a, b in zip(c, lo, hi, strict=True) if a <= i <= k <= j <= b] == [at]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((600, 16))
    v[100:120] = v[50]
    items = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [None] * 16)]
    df = spark.createDataFrame(items, "vec_id long, embedding array<double>").repartition(4)
    got = collections.defaultdict(list)
    for r in neighbours.search(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r.rank))
    hits = 0
    for q in range(0, 600, 50):
        s = v @ v[q] / np.linalg.norm(v, axis=1) / np.linalg.norm(v[q])
        order = [int(i) for i in np.lexsort((np.arange(600), -np.round(s, 12))) if i != q][:5]
        assert [x[2] for x in got[q]] == [1, 2, 3, 4, 5] and all(abs(s[i] - x) < 1e-12 for i, x, _ in got[q])
        hits += len({i for i, *_ in got[q]} & set(order))
    assert hits >= 0.9 * 60 and set(got) == set(range(0, 600, 50))
    assert [x[0] for x in got[50]] == [100, 101, 102, 103, 104]
    assert neighbours.search(df.limit(0)).count() == 0
    assert [(r.query_id, r.vec_id) for r in neighbours.search(df.where("vec_id in (0, 7)")).collect()] == [(0, 7)]


def test_neighbours_of_odd_rows(spark):
    """Lengths that few rows have, huge components, one id for several rows, a bucket full of copies."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((300, 8))
    v[150:] = v[0]
    items = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    items += [(400, [float(x) for x in 1e200 * v[1]]), (401, [1e-200 * float(x) for x in v[1]]), (402, [1.0, 2.0]), (403, []), (None, [1.0] * 8), (1, [float(x) for x in -v[1]]), (1, [float(x) for x in v[1]])]
    got = collections.defaultdict(list)
    before, neighbours.HOT = neighbours.HOT, 40  # the copies' buckets are dealt out
    try:
        for r in neighbours.search(spark.createDataFrame(items, "vec_id long, embedding array<double>").repartition(3)).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
    finally:
        neighbours.HOT = before
    assert set(got) == {0, 50, 100, 150, 200, 250, 400} and all(len(x) == 5 for x in got.values())
    assert [i for i, _ in got[0]] == [150, 151, 152, 153, 154] and [i for i, _ in got[200]] == [0, 150, 151, 152, 153]
    assert {i for i, _ in got[400][:2]} == {1, 401} and got[400][1][1] == pytest.approx(1, abs=1e-15)


def test_neighbours_of_isolated_rows(spark):
    """Tight clusters fix a small width; rows far from all others still get their k nearest."""
    rng = np.random.default_rng(4)
    v = np.repeat(rng.standard_normal((20, 16)), 30, axis=0) + 1e-4 * rng.standard_normal((600, 16))
    v[::50] = rng.standard_normal((12, 16))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    got = collections.Counter(r.query_id for r in neighbours.search(df).collect())
    assert got == dict.fromkeys(range(0, 600, 50), 5)


def test_token_counts(docs, none, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    want = {i: len(x) - 1 for i, x in ids_of("word_bpe_49k.json", rows, 1).items()}
    got = by_id(prefixes.count_tokens(docs, path, limit=60))
    for i, t, *_ in rows:
        r, t = got[i], t or ""
        counts = prefixes.counts_of(r.step_bytes, r.steps)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want[i], len(t.encode()), want[i] > 60)
        assert len(counts) == len(t) + 1 and counts[-1] == want[i]
        assert r.fits == max(k for k in range(len(t) + 1) if counts[k] <= 60) == prefixes.longest(counts, 60)
    assert prefixes.count_tokens(none, path).count() == 0


def test_counts_at_all_prefixes():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, c = Tokenizer.from_file(path), prefixes.counter(path)
    texts = [
        "Don't stop<|endoftext|> thntblere É 123", "it's we'll!'s ''s 'rex x'y", "a<|endoftext|><|endof!<|endoftext|>b <", "e\u0301tude caf\u0065\u0301 \u1100\u1161\u11a8",
        "ΣΑΣ ΌΣΟΣ İstanbul ﬁ", "日本語テキスト 한국어 ไทยกำ", "a\u00a0b\u3000c\x1cd\u2028 e", "🦄👩‍👩‍👧 <s> </s>", "x" * 300 + "1234!!??...", "", " \n\t ",
    ]
    rng = random.Random(1)
    texts += ["".join(rng.choice(["a", "B", "'", "s", "re", "é", "e\u0301", "\u0301", " ", "7", "!", "<|endoftext|>", "<|end", "Σ", "ß", "\u00a0", "中"]) for _ in range(30)) for _ in range(60)]
    for text in texts:
        counts = c.prefix_counts(text)
        assert counts.tolist() == [len(t.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert prefixes.count_at(counts, 5) == counts[min(5, len(text))]
    assert prefixes.counts_of(*prefixes.packed(np.array([300, -200, 1]))).tolist() == [0, 300, 100, 101]


def test_quality(spark, docs, none, rows):
    labels = spark.createDataFrame([(i, 0 if len(t or "") == 5000 else 1, None) for i, t, *_ in rows] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality.quality_rules(docs, labels))
    for i, t, *_ in rows:
        w = WORDS.findall(t or "")
        runs = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if runs[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines, dup = set(), 0
        for line in (t or "").split("\n"):
            if WORDS.search(line):
                dup += line in lines
                lines.add(line)
        base = (len(w), sum(map(len, w)), sum(ch in quality.SYMBOLS for ch in t or ""), dup, len(covered))
        r = got[i]
        assert base == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality.quality_rules(none, labels).count() == 0
    assert all(r.kept != r.base_failed for r in quality.quality_rules(docs, labels.limit(0)).collect())


def test_quality_learns_from_all_labels(spark):
    """However many documents are labelled, each trusted one counts, and each labelled score."""
    n = 20_050
    docs = spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 60), x -> concat('w', (id * x + x * x) % 97))) AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    sums = quality.corpus_counts(docs, quality._labelled(labels, "doc_id")).selectExpr("sum(raw) AS raw", "sum(target) AS target").first()
    assert sums.raw == sums.target == n * (60 + 59)
    scores = [r.score for r in quality.quality_rules(docs, labels).where("not base_failed").select("score").collect()]
    assert quality.fit(docs, labels).threshold == min(scores)


def test_quality_threshold_in_ranges(spark, monkeypatch):
    """Where scores part best, against all cuts, with equal scores and whatever the number of ranges."""
    rng = random.Random(2)
    for k, ranges in enumerate((1, 7, 4096)):
        monkeypatch.setattr(quality, "RANGES", ranges)
        rows = [(rng.random() < 0.6, round(rng.gauss(0, 1), 1 + k)) for _ in range(1500)]
        rows = [(good, s + (0.7 if good else 0)) for good, s in rows]
        yes, no = sorted(s for g, s in rows if g), sorted(s for g, s in rows if not g)
        most, both = yes[int((1 - quality.KEEP_TRUSTED) * len(yes))], sorted({*yes, *no})
        cuts = [c for c in [both[0] - 1, *((a + b) / 2 for a, b in zip(both, both[1:], strict=False))] if c <= most]
        want = max(cuts, key=lambda c: (sum(x < c for x in no) / len(no) - sum(x < c for x in yes) / len(yes), -c))
        assert quality._threshold(spark.createDataFrame(rows, "good boolean, score double")) == want
    only = lambda *rows: quality._threshold(spark.createDataFrame(list(rows), "good boolean, score double"))
    assert only((True, 2.0), (True, 1.0)) == 1.0 and only((False, 2.0)) == only() == float("-inf") and only((True, 3.0), (False, 3.0)) == 2.0


def test_quality_verdict_by_definition(spark, rows):
    """Score, threshold and verdict from counts of words and pairs in dictionaries."""
    import pyarrow as pa

    rng = random.Random(9)
    data = [(i, text(rng, 80, 60) if i % 3 else text(rng, 70, 30) + " bad worse worst" * 3) for i in range(60)]
    data += [(None, "a b"), (60, None), (61, ""), (5, text(rng, 90, 60)), (62, "one word " * 60)]
    marks = [(i, int(i % 3 != 0), 0) for i in range(0, 40)] + [(40, 1, 1), (41, 1, None), (None, 1, 0), (61, 1, 0), (999, 0, 0), (3, 0, 0)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, Score string").repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")

    def buckets(t):
        w = words(t)
        found = []
        for k, x in enumerate(w):
            for part in ([x], w[k : k + 2])[: 2 if k + 1 < len(w) else 1]:
                t_ = next(texts_of.passes(pa.array([" ".join(part)], pa.large_string())))
                found.append(int(quality._grams(t_)[0][-1]))
        return found

    grams = [buckets(t) for _, t in data]
    good = {i for i, q, x in marks if i is not None and q == 1 and not x}
    bad = {i for i, q, _ in marks if i is not None and q == 0}
    raw = collections.Counter(b for g in grams for b in g)
    target = collections.Counter(b for (i, _), g in zip(data, grams, strict=True) if i in good for b in g)
    n = quality.BUCKETS
    weight = lambda b: math.log((target[b] + 1) / (target.total() + n)) - math.log((raw[b] + 1) / (raw.total() + n))
    means = [sum(map(weight, g)) / max(len(g), 1) for g in grams]

    def failed(t):
        w = WORDS.findall(t or "")
        runs = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if runs[tuple(w[k : k + 3])] > 1 for j in range(3)}
        return len(w) < 50 or 100 * len(covered) > 50 * len(w)

    scored = [(i, m) for (i, t), m in zip(data, means, strict=True) if i is not None and not failed(t)]
    yes, no = sorted(m for i, m in scored if i in good), sorted(m for i, m in scored if i in bad and i not in good)
    most = yes[int((1 - quality.KEEP_TRUSTED) * len(yes))]
    both = sorted({*yes, *no})
    cuts = [c for c in [both[0] - 1, *((a + b) / 2 for a, b in zip(both, both[1:], strict=False))] if c <= most]
    threshold = max(cuts, key=lambda c: (sum(x < c for x in no) / len(no) - sum(x < c for x in yes) / len(yes), -c))
    verdict = quality.fit(docs, labels)
    assert math.isclose(verdict.threshold, threshold, rel_tol=1e-12)
    got = quality.score(docs, verdict, keep_columns=True)
    assert [c for c in got.columns if c.lower() == "score"] == ["score"]
    want = sorted(((i, round(m, 9), not failed(t) and m >= threshold) for (i, t), m in zip(data, means, strict=True)), key=str)
    assert sorted(((r.doc_id, round(r.score, 9), r.kept) for r in got.collect()), key=str) == want
    assert any(k for *_, k in want) and any(not k for *_, k in want)


def test_context_tree(docs, none, rows):
    counts = collections.Counter()
    for i, t, *_ in rows:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    frequent, ctw.FREQUENT = ctw.FREQUENT, 50  # most words take the way of rare ones
    try:
        got = by_id(ctw.score(docs))
    finally:
        ctw.FREQUENT = frequent
    for i, t, *_ in rows:
        w = [*words(t), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0
    assert ctw.score(none).count() == 0


def naive_tree_score(train, scored):
    """log10 probabilities by the definition: the root's weighted probability after a bit over before."""

    def steps(text):
        data = bytes([255] * 4) + (text or "").translate(LOWER).encode() + b"\xff"
        for i in range(4, len(data)):
            for k in range(8):
                yield data[i - 4 : i], f"{data[i]:08b}"[:k], data[i] >> (7 - k) & 1

    nodes = collections.defaultdict(lambda: [0, 0])  # (context, decision) -> zeros, ones
    below = collections.defaultdict(set)
    for t in train:
        for context, decision, bit in steps(t):
            for d in range(5):
                nodes[context[4 - d :], decision][bit] += 1
                if d:
                    below[context[5 - d :], decision].add(context[4 - d :])

    def estimate(a, b):
        return sum(math.lgamma(x + 0.5) - math.lgamma(0.5) for x in (a, b)) - math.lgamma(a + b + 1)

    known = {}

    def weighted(context, decision, path=None, bit=0):
        """Of a node, with one more bit seen in the context `path` if that is given."""
        on = path is not None and path.endswith(context)
        if not on and (context, decision) in known:
            return known[context, decision]
        a, b = nodes.get((context, decision), (0, 0))
        own = estimate(a + (on and not bit), b + (on and bit))
        if len(context) < 4:
            longer = below.get((context, decision), set()) | ({path[3 - len(context) :]} if on else set())
            own = math.log(0.5) + np.logaddexp(own, sum(weighted(c, decision, path, bit) for c in longer))
        if not on:
            known[context, decision] = own
        return own

    return [sum(weighted(b"", d, c, bit) - weighted(b"", d) for c, d, bit in steps(t)) / math.log(10) for t in scored]


@pytest.mark.parametrize("held", [0, 9, 10_000])
def test_context_tree_by_definition(spark, held):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Ab", "aba", "ca", "bé", "q"]) for _ in range(rng.randrange(1, 9))) for _ in range(24)] + [None, "", "zzz"]
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    assert 0 < len(train) < len(texts)
    before, ctw.HELD, once, ctw._AT_ONCE = ctw.HELD, held, ctw._AT_ONCE, 7
    try:
        got = by_id(ctw.score(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")))
    finally:
        ctw.HELD, ctw._AT_ONCE = before, once
    for i, want in enumerate(naive_tree_score(train, texts)):
        assert math.isclose(got[i].score, want, rel_tol=1e-9)


def test_token_files(docs, none, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = ids_of("byte_bpe_50k.json", rows, 2)
    got = by_id(rans.token_files(docs, path, 2))
    at = 0
    for i in sorted(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(want[i]), zlib.crc32(np.array(want[i], "<u4").tobytes()))
        at += len(want[i])
    assert rans.token_files(none, path, 2).count() == 0


def test_token_files_roll_and_keep_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(rans, "FILE_IDS", 20)
    monkeypatch.setattr(texts_of, "PASS_BYTES", 40)
    monkeypatch.setattr(rans, "passes", lambda x: texts_of.passes(x, 40))
    docs = spark.createDataFrame([(None, "one two"), (2**53 + 1, "three"), (2**53, None), (7, "a b c " * 30), (7, "x"), (None, "")], "doc_id long, text string")
    got = rans.token_files(docs.coalesce(1), public_tokenizers.path("byte_bpe_50k.json"), 2).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 7, 7, 2**53, 2**53 + 1]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()


def test_coder():
    rng = np.random.default_rng(4)
    for n in (1, 5, 1023, 1025, 600_000):
        ids = np.minimum(rng.geometric(0.01, n), 50_000)
        data = b"".join(rans.encode_file(np.array([4, 9]), np.array([1, n - 1]), ids))
        file = rans.TokenFile.read(data)
        assert (np.concatenate([*file.ids()]) == ids).all() and file.doc_ids.tolist() == [4, 9]
    for a, b in ((0, 1), (5, 5), (599_990, 600_000), (200_000, 400_001)):
        assert (file.some_ids(a, b) == ids[a:b]).all()
    info, slots = file.blocks[0], rans.slots_of(file.table)
    part = rans.decode_block(info, file.body[: info["bytes"]], file.table, slots, 1, 2)
    step = rans.LANES * rans.CHECKPOINT
    assert (file.table.symbols[part] == ids[step : 2 * step]).all()
    broken = bytearray(data)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        [*rans.TokenFile.read(bytes(broken)).ids()]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, near copies and shared passages, through all stages and rereads."""
    import corpus_pipeline as p

    rng = random.Random(31)
    base, passage = text(rng, 120, 10**6), text(rng, 70, 10**6)
    near = base.split()
    near[60] = "changed"
    items = [(1, base), (2, " ".join(near)), (3, base), (3, base), (4, text(rng, 90, 10**6) + "\n" + passage), (5, passage + "\n" + text(rng, 90, 10**6)), (6, None), (7, ""), (None, text(rng, 90, 10**6)), (8, text(rng, 20, 10**6)), (9, text(rng, 3000, 10**6))]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in items]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = p.keep_good(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in good.collect()) == [1, 2, 3, 3, 4, 5, 9]
    one = p.one_of_copies(spark, good, str(tmp_path))
    assert sorted(r.doc_id for r in one.collect()) == [1, 4, 5, 9]
    cut = by_id(p.cut_passages(spark, one, str(tmp_path)))
    assert words(cut[5].text) == words(items[5][1])[70:] and words(cut[4].text) == words(items[4][1])
    pieces_ = p.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces_} == {1, 4, 5, 9} and sum(r.length for r in pieces_) == sum({r.doc_id: r.doc_tokens for r in pieces_}.values())
    none_ = docs.limit(0)
    for _, stage in p.STAGES:
        none_ = stage(spark, none_, str(tmp_path))
        assert none_.count() == 0
        none_ = docs.limit(0)


def test_pipeline(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = p.keep_good(spark, docs, data)
    assert kept.columns == p.COLUMNS and 0 < kept.count() < docs.count()
    apart = p.one_of_copies(spark, kept, data)
    assert apart.count() == jaccard.classes(kept).select("component_id").distinct().count()
    cut = p.cut_passages(spark, apart, data)
    assert cut.columns == p.COLUMNS and cut.where(F.length("text") != F.col("n_chars")).count() == 0
    assert passages.repeated_passages(cut).count() <= passages.repeated_passages(apart).count()
    ids = p.pack(spark, cut, data)
    assert ids.select("doc_id").distinct().count() == cut.count()
    assert [n for n, _ in p.STAGES] == ["quality rules", "n-gram Jaccard join", "substring dedup", "packing"]




def test_pipeline_keeps_one_row_of_an_id(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(8)
    a, b = text(rng, 80, 100_000), text(rng, 80, 100_000)
    rows = [(1, a), (1, a), (2, a), (3, b), (3, b + " more"), (4, None), (4, None), (5, text(rng, 80, 100_000))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = p.one_of_copies(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.text) == sorted([(1, a), (3, b), (5, rows[-1][1])]) and [r.doc_id for r in got if r.text is None] == [4]
    assert p.one_row_each(docs.where("doc_id > 4")).count() == 1 and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
