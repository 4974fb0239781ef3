"""Packing documents into sequences of fixed size by cutting-stock column generation.

A document longer than a sequence gives whole sequences first. What remains of each document is one
piece; its length falls into a bin of the length histogram. The histogram alone, of at most
SIZE / GRAIN bins whatever the number of documents, goes to the driver, where a linear programme
chooses patterns: how many pieces of each bin share a sequence. Its columns are generated by a
knapsack dynamic programme over the dual prices. Patterns are used as often as their rounded
solution says, the rest of the histogram is packed greedily, and pieces, ranked within their bin,
take the places of the patterns in order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import column, stored, text_column
from .words import passes

#: Lengths of one bin differ by less than this. A bin counts as its longest length.
GRAIN = 8
#: The linear programme ends when its value is within this share of its lower bound.
GAP = 2e-3


def _best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of most value; prices[c] is that of a piece of c units."""
    most, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        values = most[room - 1 :: -1] + prices[1 : room + 1] if room > 0 else None
        c = int(values.argmax())
        if values[c] > most[room - 1]:
            most[room], taken[room] = values[c], c + 1
        else:
            most[room] = most[room - 1]
    pattern = np.zeros(capacity + 1, np.int64)
    room = capacity
    while room > 0:
        if taken[room]:
            pattern[taken[room]] += 1
            room -= taken[room]
        else:
            room -= 1
    return float(most[capacity]), pattern


def solve_patterns(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """The linear programme: patterns and how often each is used. demand[c]: pieces of c units."""
    sizes = np.flatnonzero(demand)
    m = len(sizes)
    if not m:
        return []
    need = demand[sizes].astype(float)
    basis = np.zeros((m, m))
    basis[np.arange(m), np.arange(m)] = capacity // sizes
    inverse = np.diag(1.0 / (capacity // sizes))
    used = need / (capacity // sizes)
    # einsum instead of @: a driver that shares its cores with a JVM is no place for BLAS threads.
    # Rounding errors of the updates don't matter, as plan() counts whole places anew.
    for _ in range(60 * m):
        duals = np.maximum(inverse.sum(axis=0), 0)
        prices = np.zeros(capacity + 1)
        prices[sizes] = duals
        value, pattern = _best_pattern(prices, capacity)
        # The optimum is at least the present value / value, and at least what the pieces fill.
        if value <= 1 + GAP or used.sum() <= (1 + GAP) * float((need * sizes).sum()) / capacity:
            break
        entering = pattern[sizes].astype(float)
        step = np.einsum("ij,j->i", inverse, entering)
        can = step > 1e-9
        if not can.any():
            break
        ratio = np.full(m, np.inf)
        ratio[can] = used[can] / step[can]
        out = int(ratio.argmin())
        basis[:, out] = entering
        row = inverse[out] / step[out]
        used = used - ratio[out] * step
        used[out] = ratio[out]
        np.maximum(used, 0, out=used)
        inverse -= np.outer(step, row)
        inverse[out] = row
    out_patterns = []
    for j in range(m):
        full = np.zeros(capacity + 1, np.int64)
        full[sizes] = np.rint(basis[:, j]).astype(np.int64)
        out_patterns.append((full, float(used[j])))
    return out_patterns


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole multiplicities that have a place for each piece of the histogram."""
    demand = np.zeros(capacity + 1, np.int64)
    for c, n in histogram.items():
        demand[c] = n
    chosen: list[tuple[np.ndarray, int]] = []
    left = demand.copy()
    for pattern, often in sorted(solve_patterns(demand, capacity), key=lambda p: -p[1]):
        has = np.flatnonzero(pattern)
        k = min(int(often + 1e-6), int((left[has] // pattern[has]).min()))
        if k > 0:
            chosen.append((pattern, k))
            left -= k * pattern
    # The rest, a few pieces a pattern: fill a sequence with the longest pieces that fit, again and again.
    while left.any():
        pattern, room = np.zeros(capacity + 1, np.int64), capacity
        while room > 0:
            fits = np.flatnonzero(left[: room + 1] - pattern[: room + 1])
            if not len(fits):
                break
            c = int(fits[-1])
            k = min(room // c, int(left[c] - pattern[c]))
            pattern[c] += k
            room -= k * c
        has = np.flatnonzero(pattern)
        k = int((left[has] // pattern[has]).min())
        chosen.append((pattern, k))
        left -= k * pattern
    return chosen


def places(chosen: list[tuple[np.ndarray, int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(bin, first rank, end rank, copies in a sequence, first sequence), and the number of sequences."""
    rows, at, base = [], {}, 0
    for pattern, k in chosen:
        for c in np.flatnonzero(pattern).tolist():
            copies = int(pattern[c])
            lo = at.get(c, 0)
            at[c] = lo + copies * k
            rows.append((c, lo, at[c], copies, base))
        base += k
    return rows, base


def tokenized(docs: DataFrame, path: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Lengths of all documents' ids (end_id appended), checksums of their pieces of `size`, the bin
    of what remains, and ranks inside the task: of the remainder in its bin, of the whole pieces."""
    source = docs.select(id_col, text_col)
    fields = [source.schema[id_col], T.StructField("doc_tokens", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType())), T.StructField("bin", T.IntegerType()), T.StructField("task", T.IntegerType()), T.StructField("rank", T.LongType()), T.StructField("wholes_before", T.LongType())]
    out = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import run_encoder

        encoder = run_encoder(path)
        end = encoder.width.type(end_id)
        task = TaskContext.get().partitionId()
        ranks: dict[int, int] = {}
        wholes = 0
        for batch in batches:
            for t in passes(text_column(batch, text_col)):
                part = batch.slice(t.first, t.n)
                ids, sizes = encoder.encode(t)
                stop = np.cumsum(sizes)
                flat = memoryview(np.insert(ids, stop, end).astype("<u4").tobytes())
                stop = 4 * (stop + np.arange(1, t.n + 1))
                got = [flat[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]
                n = [len(g) // 4 for g in got]
                bins = [-(-(k % size) // GRAIN) for k in n]
                rank, before = [], []
                for k, b in zip(n, bins, strict=True):
                    rank.append(ranks.get(b, 0))
                    ranks[b] = rank[-1] + 1
                    before.append(wholes)
                    wholes += k // size
                crcs = [[zlib.crc32(g[p : p + 4 * size]) for p in range(0, len(g), 4 * size)] for g in got]
                cols = [column(part, id_col), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(bins, pa.int32()), pa.array([task] * len(n), pa.int32()), pa.array(rank, pa.int64()), pa.array(before, pa.int64())]
                if keep_ids:
                    cols.append(pa.array([bytes(g) for g in got], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return source.mapInArrow(run, out)


def pack(docs: DataFrame, path: str, end_id: int, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece.

    Pieces of a sequence lie gapless from offset 0 and sum up to at most `size`. Null and empty
    texts are one piece with the end id. Repeated ids are packed as documents of their own.
    Only narrow rows are shuffled, by sequence, which holds at most `size` pieces; ranks come from
    counts by task and bin, so that a bin with a third of all documents is no task's own.
    """
    spark = docs.sparkSession
    table = stored(tokenized(docs, path, end_id, size, id_col, text_col, keep_ids), "packing")
    counts = table.groupBy("task", "bin").agg(F.count("*").alias("n"), F.max(F.col("wholes_before") + F.floor(F.col("doc_tokens") / size)).alias("w"))
    bins = counts.select("task", "bin", "n").where("bin > 0")
    wholes = counts.groupBy("task").agg(F.max("w").alias("n")).select("task", F.lit(-1).alias("bin"), "n")
    counts = stored(bins.unionByName(wholes), "packing-counts")
    earlier = Window.partitionBy("bin").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "bin", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    histogram = {r["bin"]: r["n"] for r in counts.where("bin > 0").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    rows, sequences = places(plan(histogram, size // GRAIN))
    slots = spark.createDataFrame(rows or [(0, 0, 0, 1, 0)], "bin int, lo long, hi long, copies int, first long")  # bounded by the bins

    of_wholes = bases.where("bin = -1").select("task", F.col("base").alias("whole_base"))
    of_bins = bases.where("bin > 0").select("task", "bin", F.col("base").alias("bin_base"))
    full = F.floor(F.col("doc_tokens") / size)
    rest = F.col("doc_tokens") % size
    part = lambda start, length, at, order, seq: F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"), F.get("crcs", at.cast("int")).alias("ids_crc32"), order.cast("long").alias("order"), seq.cast("long").alias("sequence_id"))
    ids = ["ids"] * keep_ids

    whole = (
        table.where(full > 0).join(of_wholes, "task")
        .select(id_col, "doc_tokens", *ids, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), full - 1), lambda k: part(k * size, F.lit(size), k, F.lit(0), sequences + F.col("whole_base") + F.col("wholes_before") + k))).alias("p"))
        .select(id_col, "doc_tokens", *ids, "p.*").withColumn("offset", F.lit(0).cast("long"))
    )
    rank = F.col("bin_base") + F.col("rank")
    placed = (
        table.where(rest > 0).join(of_bins, ["task", "bin"])
        .withColumn("q", rank).alias("d").join(F.broadcast(slots).alias("s"), (F.col("d.bin") == F.col("s.bin")) & (F.col("q") >= F.col("lo")) & (F.col("q") < F.col("hi")))
        .select(id_col, "doc_tokens", *ids, part(full * size, rest, full, F.col("d.bin") * 65536 + (F.col("q") - F.col("lo")) % F.col("copies"), F.col("first") + F.floor((F.col("q") - F.col("lo")) / F.col("copies"))).alias("p"))
        .select(id_col, "doc_tokens", *ids, "p.*")
    )
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("order")).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
    out = whole.unionByName(placed)
    if keep_ids:
        out = out.withColumn("ids", F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))"))
    return out.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *ids)
