"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables hashes a unit vector v by WIDTHS functions floor((a.v + b) / w) with Gaussian
a (a 2-stable law, so projections shrink distances in proportion). A query visits in each table its
own bucket and perturbed ones, each function moved by -1, 0 or +1, in the order of their estimated
success: the sum of squared distances to the borders crossed. Candidates of all tables are merged
and ranked again by the exact cosine of the original vectors.

Every row is indexed. Only the functions' width and the number of probes are fitted, on the SAMPLE
rows with the smallest hashes of their ids, so that RECALL of their true neighbours are found; the
width is doubled until moves of one cell reach so many. Queries that are left with fewer than k
candidates are asked again with all of them probed and four times the width, round by round: vectors of
length 1 come to lie in neighbouring cells at last, so each query gets k rows if there are as many.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import column, stored
from .words import splitmix

TABLES = 8
WIDTHS = 6
SAMPLE = 4096
SAMPLE_QUERIES = 256
RECALL = 0.97
#: A bucket with more rows than this, and than a hundred-thousandth of all entries, is salted.
HOT = 4096
_MOVES = np.array([*itertools.product((0, -1, 1), repeat=WIDTHS)])


@dataclass
class Hashes:
    """The functions of all tables; probes: buckets that a query visits in each."""

    a: np.ndarray  # TABLES, dimensions, WIDTHS
    b: np.ndarray
    width: float
    probes: int

    def places(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket coordinates, and how far into each cell a vector lies, from 0 to 1."""
        f = np.einsum("nd,dk->nk", unit, self.a[table]) / self.width + self.b[table]
        h = np.floor(f)
        return h.astype(np.int64), f - h

    def order(self, inside: np.ndarray) -> np.ndarray:
        """For each vector the perturbations in the order of their scores."""
        up, down = (1 - inside) ** 2, inside**2
        score = np.einsum("nk,mk->nm", up, (_MOVES == 1).astype(float)) + np.einsum("nk,mk->nm", down, (_MOVES == -1).astype(float))
        return np.argsort(score, axis=1, kind="stable")


def keys(places: np.ndarray, table: int) -> np.ndarray:
    """One 64-bit key of a table's bucket."""
    key = np.full(places.shape[:-1], np.uint64(table + 1))
    for k in range(places.shape[-1]):
        key = splitmix(key ^ places[..., k].astype(np.uint64))
    return key.view(np.int64)


def valid(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>): without null ids, null, zero or empty vectors, null or non-finite components."""
    v = F.col(vec_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(id_col).alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & good)


def _vectors(array: pa.Array) -> np.ndarray:
    flat = array.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(array), -1)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Times a power of two for each vector, so that its largest component is about 1; nothing is
    rounded but what is too small to count."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _unit(v: np.ndarray) -> np.ndarray:
    v = _scaled(v)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def fit(rows: DataFrame, k: int) -> Hashes | None:
    """Width and probes for valid rows of one length; None if there are none. The driver gets SAMPLE
    vectors."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if not got:
        return None
    d = len(got[0]["vec"])
    u = _unit(np.array([r["vec"] for r in got]))
    rng = np.random.default_rng(20_240_601)
    a, b = rng.standard_normal((TABLES, d, WIDTHS)), rng.uniform(0, 1, (TABLES, WIDTHS))
    q = min(SAMPLE_QUERIES, len(u))
    near = np.einsum("qd,nd->qn", u[:q], u)
    near[np.arange(q), np.arange(q)] = -2
    top = np.argsort(-near, axis=1)[:, : min(k, len(u) - 1)]
    far = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(near, top, 1), 0))
    h = Hashes(a, b, max(1.4 * float(far.mean()) if far.size else 1.0, 1e-6), len(_MOVES))
    while far.size:
        first = _first_probes(h, u, q, top)
        most = int(np.quantile(first, RECALL, method="higher"))
        if most < len(_MOVES):
            h.probes = most + 1
            break
        h.width *= 2
    return h


def _first_probes(h: Hashes, u: np.ndarray, q: int, top: np.ndarray) -> np.ndarray:
    """For each of the first q vectors' true neighbours the least number of probes before the one
    that finds it in some table; the number of all moves if none does."""
    first = np.full(top.shape, len(_MOVES))
    for t in range(TABLES):
        place, inside = h.places(u, t)
        order = h.order(inside[:q])
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(len(_MOVES)), order.shape), 1)
        step = place[top] - place[:q, None]
        near_enough = (np.abs(step) <= 1).all(axis=2)
        index = (np.where(step == -1, 1, np.where(step == 1, 2, 0)) * 3 ** np.arange(WIDTHS - 1, -1, -1)).sum(axis=2)
        first = np.where(near_enough, np.minimum(first, np.take_along_axis(rank, index, 1)), first)
    return first


def _exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision, the same for equal vectors wherever they stand, however large."""
    query, rows = _scaled(query[None])[0], _scaled(rows)
    return (rows * query).sum(axis=1) / (np.sqrt((query * query).sum()) * np.sqrt((rows * rows).sum(axis=1)))


def search(rows: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by
    `every`, itself excluded; fewer if there are fewer candidates; ties to the smaller id.

    Index entries and probes meet in cells: hashes of buckets, so each query's vector goes to a cell
    once, with all its probes there. Buckets with very many rows are spread over several cells, to
    all of which their probes go. Each cell gives at most k rows a query.
    Vectors of another length than most (the shorter, if there are as many) take no part. Rows that
    share an id are one candidate with the best of their scores, and ask as one query.
    """
    spark = rows.sparkSession
    names = "query_id long, rank int, vec_id long, score double"
    good = stored(valid(rows, id_col, vec_col), "vectors")
    lengths = good.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], names)
    good = good.where(F.size("vec") == lengths["d"])
    h, n = fit(good, k), good.select("id").distinct().count()
    reach = 2 * float(np.sqrt((h.a * h.a).sum(axis=1)).max())  # no projections of unit vectors are further apart
    asking = good.withColumn("asks", F.col("id") % every == 0)
    left = asking.where("asks").select("id").distinct()
    done: DataFrame | None = None
    while True:
        whole = n <= k + 1 or h.width >= reach and h.probes == len(_MOVES)
        if n <= k + 1:
            h = Hashes(h.a, h.b, reach, len(_MOVES))
        got = stored(_round(asking, n, h, k), "neighbours")
        if not whole:
            answered = got.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
            left = stored(left.join(answered, "id", "left_anti"), "left")
            whole = left.isEmpty()
            if not whole:
                got = got.join(answered.withColumnRenamed("id", "query_id"), "query_id", "left_semi")
        done = got if done is None else done.unionByName(got)
        if whole:
            return done
        asking = good.join(left.withColumn("asks", F.lit(True)), "id", "left").select("id", "vec", F.coalesce("asks", F.lit(False)).alias("asks"))
        h = Hashes(h.a, h.b, min(4 * h.width, reach), len(_MOVES))


def _round(good: DataFrame, n: int, h: Hashes, k: int) -> DataFrame:
    """The k nearest that the probes of the rows that ask find among all n rows of (id, vec, asks)."""
    d = h.a.shape[1]
    cells = int(min(max(n * TABLES // 8192, 16), 1 << 20))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _unit(_vectors(column(batch, "vec")))
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(keys(h.places(u, t)[0], t))], names=["key"])

    most = max(HOT, n * TABLES // 100_000)
    sizes = good.select("vec").mapInArrow(entries, "key long").groupBy("key").count().where(F.col("count") > most)
    hot = {r["key"]: -(-r["count"] // most) for r in sizes.collect()}  # at most 100,000 buckets

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys = np.array(sorted(hot), np.int64)
        hot_salts = np.array([hot[x] for x in sorted(hot)], np.int64)

        def salts(key: np.ndarray) -> np.ndarray:
            if not len(hot_keys):
                return np.ones(key.shape, np.int64)
            at = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
            return np.where(hot_keys[at] == key, hot_salts[at], 1)

        def cell(key: np.ndarray, salt: np.ndarray) -> np.ndarray:
            return (splitmix(key.view(np.uint64) ^ splitmix(salt)) % np.uint64(cells)).astype(np.int64)

        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                ids, vec = column(batch, "id").to_numpy(), _vectors(column(batch, "vec"))
                u = _unit(vec)
                out: list[list] = [[], [], [], [], []]
                asked = np.flatnonzero(column(batch, "asks").to_numpy(zero_copy_only=False))
                wanted: list[dict[int, list]] = [{} for _ in asked]
                for t in range(TABLES):
                    place, inside = h.places(u, t)
                    key = keys(place, t)
                    salt = (splitmix(ids.astype(np.uint64)) % salts(key).astype(np.uint64)).astype(np.int64)
                    out[0] += cell(key, salt).tolist()
                    out[1] += [False] * len(ids)
                    out[2] += ids.tolist()
                    out[3].append(vec)
                    out[4] += [[x] for x in key.tolist()]
                    if len(asked):
                        moves = _MOVES[h.order(inside[asked])[:, : h.probes]]
                        probe = keys(place[asked][:, None] + moves, t)
                        many = salts(probe)
                        for i, (row, times) in enumerate(zip(probe, many, strict=True)):
                            spread = np.repeat(row, times)
                            first = np.repeat(np.cumsum(times) - times, times)
                            for c, x in zip(cell(spread, np.arange(len(spread)) - first).tolist(), spread.tolist(), strict=True):
                                wanted[i].setdefault(c, []).append(x)
                for i, w in zip(asked, wanted, strict=True):
                    for c, probes in w.items():
                        out[0].append(c)
                        out[1].append(True)
                        out[2].append(int(ids[i]))
                        out[3].append(vec[i : i + 1])
                        out[4].append(probes)
                flat = np.concatenate(out[3])
                vecs = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), d).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2], pa.int64()), vecs, pa.array(out[4], pa.list_(pa.int64()))], names=["cell", "asks", "id", "vec", "keys"])

    dealt = good.mapInArrow(deal, "cell long, asks boolean, id long, vec array<double>, keys array<long>")
    met = dealt.repartition(F.col("cell")).sortWithinPartitions("cell", "asks")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vecs, buckets = None, [], [], []
        index: tuple | None = None
        for batch in batches:
            cell_of, asks = column(batch, "cell").to_numpy(), column(batch, "asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(cell_of) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if now != cell_of[lo]:
                    now, ids, vecs, buckets, index = cell_of[lo], [], [], [], None
                if not asks[lo]:
                    ids.append(column(part, "id").to_numpy())
                    vecs.append(_vectors(column(part, "vec")))
                    buckets.append(column(part, "keys").flatten().to_numpy())
                    continue
                if not ids:
                    continue
                if index is None:
                    key = np.concatenate(buckets)
                    order = np.argsort(key, kind="stable")
                    index = key[order], np.concatenate(ids)[order], np.concatenate(vecs)[order]
                    index = (*index, _unit(index[2]))
                yield from _answer(part, index, k)

    found = met.mapInArrow(meet, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _answer(part: pa.RecordBatch, index: tuple, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of a cell's entries in the buckets that each query of `part` visits."""
    key, ids, vecs, units = index
    out: list[tuple[int, int, float]] = []
    for query, vec, probes in zip(column(part, "id").to_pylist(), _vectors(column(part, "vec")), column(part, "keys").to_pylist(), strict=True):
        probes = np.unique(probes)
        lo, hi = np.searchsorted(key, probes, "left"), np.searchsorted(key, probes, "right")
        size = hi - lo
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        at = at[ids[at] != query]
        if not len(at):
            continue
        near = np.einsum("nd,d->n", units[at], _unit(vec[None])[0])
        most = k * TABLES
        while len(at) > most:
            # Copies of a row in several tables count once, and so do rows of one id.
            some = at[near >= np.partition(near, len(near) - most)[len(near) - most] - 1e-9]
            if len(np.unique(ids[some])) >= k:
                at = some
                break
            most *= 4
        score = _exact(vec, vecs[at])
        order = np.lexsort((-score, ids[at]))
        first = order[np.unique(ids[at[order]], return_index=True)[1]]  # each id's best
        at, score = at[first], score[first]
        best = np.lexsort((ids[at], -score))[:k]
        out += [(query, int(ids[at[b]]), float(score[b])) for b in best]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])
