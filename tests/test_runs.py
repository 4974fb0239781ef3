"""Repeated windows against plain loops, and documents out of shuffled streams."""

import random
import time

import numpy as np
import pytest

from quireworks.functions import runs


def plain(tokens, size):
    seen = {}
    for i in range(len(tokens) - size + 1):
        w = tuple(tokens[i : i + size])
        if w in seen:
            return i, seen[w]
        seen[w] = i
    return None


def test_windows():
    rng = random.Random(5)
    for _ in range(800):
        tokens = [rng.randrange(rng.choice([2, 3, 20])) for _ in range(rng.randint(0, 40))]
        size = rng.randint(1, 7)
        t = np.array(tokens, np.int64)
        assert runs.first_repeat(t, size) == plain(tokens, size)
        banned = {x for x in range(20) if size <= len(tokens) and plain([*tokens, x], size) is not None and tuple([*tokens, x][-size:]) in {tuple(tokens[i : i + size]) for i in range(len(tokens) - size + 1)}}
        assert runs.completing(t, size).tolist() == sorted(banned)


def test_a_hundred_tokens():
    rng = random.Random(6)
    base = [rng.randrange(1000) for _ in range(5000)]
    again = base[700:799]
    t = np.array([*base, *again], np.int64)
    assert runs.first_repeat(t, 100) is None and runs.completing(t, 100).tolist() == [base[799]]
    assert runs.first_repeat(np.append(t, base[799]), 100) == (5000, 700)
    began = time.time()
    assert runs.first_repeat(np.zeros(2_000_000, np.int64), 100) == (1, 0)
    assert runs.first_repeat(np.arange(2_000_000), 100) is None and time.time() - began < 20


def test_hashes_only_find(monkeypatch):
    monkeypatch.setattr(runs, "window_hashes", lambda tokens, size: np.zeros(len(tokens) - size + 1, np.uint64))
    t = np.array([1, 2, 3, 1, 2, 4, 1, 2], np.int64)
    assert runs.first_repeat(t, 2) == (3, 0) and runs.first_repeat(t[:3], 2) is None and runs.completing(t, 3).tolist() == [3, 4]


def test_rows(spark):
    rows = [(1, [1, 2, 1, 2, 1], "x"), (2, None, "x"), (3, [], "x"), (4, [5, None, 5], None), (5, [7], "y")]
    df = spark.createDataFrame(rows, "id int, t array<int>, start string")
    assert sorted(map(tuple, runs.first_repeats(df, "t", 2).collect())) == [(1, 2, 0), (2, None, None), (3, None, None), (4, None, None), (5, None, None)]
    assert {r.id: r.banned for r in runs.banned_tokens(df, "t", 2).collect()} == {1: [2], 2: [], 3: [], 4: [5], 5: []}
    with pytest.raises(ValueError):
        runs.first_repeats(spark.createDataFrame([(["a"],)], "t array<string>"), "t")


def test_documents_of_a_shuffled_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from quireworks.operators import assemble
    from quireworks.sources import derived
    from quireworks.streaming import assembly

    made = assemble.pages(derived.blocks(spark, "/root/testdata/sf0.001").where("page_id < 24"))
    n = {r.page_id: r for r in made.select("page_id").collect()}
    pages = made.withColumn("doc_id", F.floor(F.col("page_id") / 4)).withColumn("page_idx", (F.col("page_id") % 4).cast("int"))
    want = {r.doc_id: (r.document, r.markdown) for r in assemble.documents(pages).collect()}
    rows = pages.withColumn("pages", F.lit(4)).collect()
    assert len(rows) == len(n) == 24
    random.Random(1).shuffle(rows)
    start = datetime(2024, 1, 1)
    schema = pages.withColumn("pages", F.lit(4)).withColumn("ts", F.lit(start)).schema
    source = tmp_path / "in"

    def put(part, minute, name):
        stamped = [(*r, start + timedelta(minutes=minute)) for r in part]
        spark.createDataFrame(stamped, schema).coalesce(1).write.mode("append").parquet(str(source / name))

    lost = next(i for i, r in enumerate(rows) if r.doc_id == 2)
    gone = rows.pop(lost)
    for k in range(0, len(rows), 6):
        put([*rows[k : k + 6], rows[k]], k, f"b{k:02}")  # a page of each lot comes twice
    named = lambda r, d: tuple(d if f == "doc_id" else r[f] for f in r.__fields__)
    for k, d in enumerate((97, 98, 99)):  # time goes on
        put([named(gone, d)], 200 + k, f"c{k}")
    put([gone], 203, "d")  # its document has gone out without it
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    out = assembly.documents(stream, wait="30 minutes", late="5 minutes")
    q = out.writeStream.format("memory").queryName("shuffled").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    got = spark.table("shuffled").collect()
    whole = {r.doc_id: (r.document, r.markdown) for r in got if r.complete}
    assert whole == {d: x for d, x in want.items() if d != 2} and 2 in want
    parts = [r for r in got if not r.complete and r.doc_id == 2]
    assert len(parts) == 1 and parts[0].document.count('"page_idx"') == 3
