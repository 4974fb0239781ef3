"""Exact n-gram Jaccard join with count-vector R-trees.

A document's set holds its distinct shingles of five words; hashing them into groups gives its count
vector, a point. Two sets share at most the sum of their vectors' coordinate minima, so an R-tree
over points, whose boxes bound the same sum by their upper corners, finds the pairs that can reach
the similarity; those are verified on the sets themselves.

One tree over all documents can't be dealt to many tasks, so documents meet by prefixes first:
linked sets of at least 75 % similarity share a shingle among the first quarter of either, in any
order common to all. The order puts frequent shingles last and hashes first, and each list of
documents that share a prefix shingle gets a tree of its own; a long list is dealt to trees over
pairs of its blocks. Trees in lists work on GROUPS groups. Each set also has a finer vector of at
least one group a shingle (folding it gives the coarser ones, as groups nest), which bounds pairs
again before whole sets travel.

A pair is given in the first list that both share, as far as their first HEADS shingles show, and
only if enough of both sets comes after that list's shingle. Groups of near copies would still give
all their pairs, so a first round verifies each document with one leader only, a second one each
document of a long list with its best partner, and the last round's trees look for all pairs of
different components.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import among, column, discard, stored, text_column, without
from .words import U64, Texts, passes, short_sequences, splitmix, windows

WORDS = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Groups of the vectors in lists; a power of two.
GROUPS = 256
#: A shingle in at least so many documents is frequent. Only the order depends on it, and on how
#: many of them tasks are told of, never the result.
FREQUENT = 32
FREQUENT_MOST = 1 << 18
#: Points of an R-tree's node.
NODE = 32
#: Entries of a list's block; lists of more entries are dealt as pairs of blocks.
BLOCK = 512
#: First prefix shingles that travel with an entry, to tell that a pair has met in an earlier list.
HEADS = 8
#: Parts in which documents meet in the lists of shingles that aren't frequent.
DEALS = 2
#: Rows of sets or fine vectors looked at together.
_AT_ONCE = 512


def shingle_sets(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a pass's texts, and their text, sorted by text and shingle."""
    h = t.hashes(lower=True)
    full, first = windows(t, h, WORDS)
    short, docs = short_sequences(t, h, WORDS)
    key, doc = np.concatenate([full, short]), np.concatenate([t.doc[first], docs])
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], doc[new]


def frequent_shingles(docs: DataFrame, text_col: str) -> np.ndarray:
    """Shingles that come often, at most FREQUENT_MOST: counted by tasks, those that a task meets
    three times and more summed up over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def send() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key[n > 2].view(np.int64)), pa.array(n[n > 2])], names=["key", "n"])

        for batch in batches:
            for t in passes(text_column(batch, text_col)):
                held.append(shingle_sets(t)[0])
                size += len(held[-1])
                if size > 2_000_000:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    counts = docs.select(text_col).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    rows = counts.orderBy(F.desc("n"), "key").limit(FREQUENT_MOST).toPandas()
    return np.sort(rows["key"].to_numpy(np.int64).view(U64))


def _fold(points: np.ndarray, groups: int) -> np.ndarray:
    """Count vectors of fewer groups (both are powers of two)."""
    return points.reshape(len(points), -1, groups).sum(axis=1)


def _vectors(key: np.ndarray, doc: np.ndarray, n: int, groups: int) -> np.ndarray:
    """Count vectors: how many of a text's shingles fall into each group."""
    flat = np.bincount(doc * groups + (splitmix(key ^ U64(0xA5A5)) & U64(groups - 1)).astype(np.int64), minlength=n * groups)
    return flat.reshape(n, groups)


def groups_of(n: np.ndarray) -> np.ndarray:
    """Groups of the fine vectors of sets of n shingles: a power of two, one for each shingle or more."""
    return np.maximum(GROUPS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def _packed(points: np.ndarray) -> list[bytes]:
    """A byte a group where that is enough, else four."""
    small = (points < 256).all(axis=1)
    one, four = points.astype("u1"), points.astype("<u4")
    return [(one if s else four)[i].tobytes() for i, s in enumerate(small.tolist())]


def _unpacked(packed: list[bytes], groups: int) -> np.ndarray:
    if all(len(p) == groups for p in packed):
        return np.frombuffer(b"".join(packed), "u1").reshape(-1, groups)
    return np.stack([np.frombuffer(p, "u1" if len(p) == groups else "<u4").astype(np.uint32) for p in packed])


def _fine(key: np.ndarray, n: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Packed count vectors of texts with n shingles each: of GROUPS groups, and fine ones."""
    coarse: list[bytes] = [b""] * len(n)
    fine: list[bytes] = [b""] * len(n)
    groups, start = groups_of(n), np.cumsum(n) - n
    for g in np.unique(groups).tolist():
        some = np.flatnonzero(groups == g)
        step = max(1, (1 << 21) // g)  # texts whose vectors are made together
        for lo in range(0, len(some), step):
            part = some[lo : lo + step]
            size = n[part]
            own = np.repeat(start[part] - np.cumsum(size) + size, size) + np.arange(size.sum())
            points = _vectors(key[own], np.repeat(np.arange(len(part)), size), len(part), g)
            for i, a, b in zip(part.tolist(), _packed(_fold(points, GROUPS)), _packed(points), strict=True):
                coarse[i], fine[i] = a, b
    return coarse, fine


def _prefix_length(n: np.ndarray) -> np.ndarray:
    """So many of a set's first shingles meet every set of at least the similarity."""
    return n - (PERCENT * n + 99) // 100 + 1


def prefixes(docs: DataFrame, frequent: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n, s1, s2, counts, fine, rare, prefix) of each document: set size, two hashes of the whole
    set, its count vectors (packed) and its prefix, which has `rare` shingles that aren't frequent at
    first. Sets of no shingle have an empty prefix."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT_MOST numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = held.value
        for batch in batches:
            for t in passes(text_column(batch, text_col)):
                key, doc = shingle_sets(t)
                n = np.bincount(doc, minlength=t.n)
                with np.errstate(over="ignore"):
                    marks = [np.zeros(t.n, U64), np.zeros(t.n, U64)]
                    at = np.flatnonzero(n)
                    start = (np.cumsum(n) - n)[at]
                    if len(at):
                        marks[0][at] = np.add.reduceat(splitmix(key), start)
                        marks[1][at] = np.add.reduceat(splitmix(key ^ U64(0x5EED)), start)
                counts, fine = _fine(key, n)
                hit = np.minimum(np.searchsorted(often, key), max(len(often) - 1, 0))
                late = often[hit] == key if len(often) else np.zeros(len(key), bool)
                order = np.argsort(doc * 2 + late, kind="stable")  # by text, frequent ones last, then by shingle
                rank = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
                keep = rank < np.repeat(_prefix_length(n), n)
                size = np.minimum(_prefix_length(n), n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(key[order][keep].view(np.int64)))
                cols = [column(batch, id_col).slice(t.first, t.n), pa.array(n, pa.int64()), *(pa.array(m.view(np.int64)) for m in marks), pa.array(counts, pa.binary()), pa.array(fine, pa.binary()), pa.array(np.bincount(doc, ~late, minlength=t.n).astype(np.int32)), lists]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "s1", "s2", "counts", "fine", "rare", "prefix"])

    return docs.select(id_col, text_col).mapInArrow(run, "id long, n long, s1 long, s2 long, counts binary, fine binary, rare int, prefix array<long>")


def _needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least intersection that links sets of these sizes."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def _may_link(n: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can link if their first common shingle comes `at` their ranks."""
    return 1 + np.minimum(n[a] - at[a], n[b] - at[b]) - 1 >= _needed(n[a], n[b])


def _inside(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs inside runs of equal keys; for short runs."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    rank = np.arange(len(key)) - np.repeat(start, size)
    b = np.repeat(np.arange(len(key)), rank)
    a = np.arange(len(b)) - np.repeat(np.cumsum(rank) - rank, rank) + np.repeat(np.repeat(start, size), rank)
    return a, b


def _lists(postings: DataFrame) -> DataFrame:
    """Postings (key, id, n, at) of shingles that two and more documents have in their prefixes, with
    each list's least document. Of a list of up to NODE entries only those stay that can link with
    another one by sizes and ranks. Longer lists stream through; they are never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            """Whole lists, but for what comes of one that is already streaming."""
            key, ids, n, at = (rows[c].to_numpy() for c in ("key", "id", "n", "at"))
            new = np.concatenate([[True], key[1:] != key[:-1]])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(key)))
            keep = np.repeat(size > NODE, size)
            leader = ids[np.repeat(start, size)]
            some = np.flatnonzero(np.repeat((size > 1) & (size <= NODE), size))
            a, b = _inside(key[some])
            a, b = some[a], some[b]
            fits = _may_link(n, at, a, b)
            keep[a[fits]] = keep[b[fits]] = True
            if going is not None:
                keep[key == going[0]] = True
                leader = np.where(key == going[0], going[1], leader)
            yield from rows.filter(pa.array(keep)).append_column("leader", pa.array(leader[keep])).combine_chunks().to_batches()

        held: pa.Table | None = None
        going: tuple[int, int] | None = None  # a list that has begun to stream, and its leader
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            if not rows.num_rows:
                continue
            key = rows["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if len(key) - cut > NODE or (going is not None and going[0] == key[-1]):
                yield from answer(rows)
                if going is None or going[0] != key[-1]:
                    going = int(key[-1]), int(rows["id"][cut].as_py())
                held = None
                continue
            if cut:
                yield from answer(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None and held.num_rows:
            yield from answer(held)

    sorted_ = postings.repartition("key").sortWithinPartitions("key", "id")
    return sorted_.mapInArrow(run, "key long, id long, n long, at int, leader long")


class Tree:
    """An R-tree over count vectors, packed by sorting: only what the join below needs, upper corners,
    least and largest sizes and classes of boxes of NODE points, NODE * NODE points, and so on."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, classes: np.ndarray | None = None):
        classes = np.arange(len(sizes)) if classes is None else classes
        self.order = np.lexsort((*points.T[:3], sizes, classes))
        points, sizes, classes = points[self.order], sizes[self.order], classes[self.order]
        self.levels = [(points, sizes, sizes, classes, classes)]
        while len(self.levels[-1][0]) > NODE:
            corner, least, most, low, high = self.levels[-1]
            at = np.arange(0, len(corner), NODE)
            self.levels.append((np.maximum.reduceat(corner, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def pairs(self, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of points of different classes that are wanted, and their bound's share of what they
        need, where the bound reaches it, in bounded portions: from the root down, two boxes are
        opened only if their own bound does."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        a, b = np.triu_indices(n)
        yield from self._open(top, a, b, wanted)

    def _open(self, level: int, a: np.ndarray, b: np.ndarray, wanted) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        corner, least, most, low, high = self.levels[level]
        for lo in range(0, len(a), 4096):
            x, y = a[lo : lo + 4096], b[lo : lo + 4096]
            near = (100 * most[x] >= PERCENT * least[y]) & (100 * most[y] >= PERCENT * least[x])
            near &= np.minimum(low[x], low[y]) != np.maximum(high[x], high[y])
            x, y = x[near], y[near]
            if not level and wanted is not None:
                ok = wanted(self.order[x], self.order[y])
                x, y = x[ok], y[ok]
            bound = np.minimum(corner[x], corner[y]).sum(axis=1, dtype=np.int64)
            need = _needed(least[x], least[y])
            fits = bound >= need
            if not level:
                fits &= x != y
                yield self.order[x[fits]], self.order[y[fits]], bound[fits] / need[fits]
                continue
            x, y = x[fits], y[fits]
            below = len(self.levels[level - 1][0])
            step = np.arange(NODE)
            for k in range(0, len(x), 16):
                i = (x[k : k + 16, None, None] * NODE + step[:, None] + 0 * step).ravel()
                j = (y[k : k + 16, None, None] * NODE + step + 0 * step[:, None]).ravel()
                ok = (i < below) & (j < below) & ((i <= j) | np.repeat(x[k : k + 16] != y[k : k + 16], NODE * NODE))
                yield from self._open(level - 1, i[ok], j[ok], wanted)


def _tree_pairs(entries: DataFrame, best_only: bool) -> DataFrame:
    """(a, b), a < b, of different components whose bound reaches the similarity, from entries (key,
    cell, block, id, n, at, component, counts, heads); a cell of two blocks gives the pairs between
    them. best_only: for each document of a cell the pair with the best bound alone. Cells of up to
    NODE entries are handled together: a tree of so few points is its one node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held_pairs = 0

        def send() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])

        def answer(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            """Whole cells."""
            nonlocal found, held_pairs
            key, cell, block, ids, n, at, comp = (rows[c].to_numpy() for c in ("key", "cell", "block", "id", "n", "at", "component"))
            points = _unpacked(rows["counts"].to_pylist(), GROUPS)
            heads = np.zeros((len(ids), HEADS), np.int64)
            several = rows["heads"].combine_chunks()
            of, place = np.repeat(np.arange(len(ids)), (m := several.value_lengths().to_numpy())), np.arange(m.sum())
            heads[of, place - np.repeat(np.cumsum(m) - m, m)] = several.flatten().to_numpy()
            start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
            size = np.diff(np.append(start, len(key)))
            between = np.repeat(np.maximum.reduceat(block, start) != np.minimum.reduceat(block, start), size)
            best, partner = np.zeros(len(ids)), np.full(len(ids), -1)

            def wanted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return (comp[a] != comp[b]) & ~(between[a] & (block[a] == block[b])) & _may_link(n, at, a, b)

            def keep(a: np.ndarray, b: np.ndarray, share: np.ndarray) -> Iterator[pa.RecordBatch]:
                if best_only:
                    order = np.argsort(share, kind="stable")  # of entries met twice the best comes last
                    for x, y in ((a[order], b[order]), (b[order], a[order])):
                        better = share[order] > best[x]
                        best[x[better]], partner[x[better]] = share[order][better], y[better]
                else:
                    yield from add(a, b)

            def add(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
                nonlocal found, held_pairs
                if not best_only:
                    a, b = a[first := ~_met(heads, at, a, b)], b[first]
                a, b = ids[a], ids[b]
                found.append((np.minimum(a, b), np.maximum(a, b)))
                held_pairs += len(a)
                if held_pairs > 1 << 18:
                    yield send()
                    found, held_pairs = [], 0

            for s, k in zip(start[size > NODE].tolist(), size[size > NODE].tolist(), strict=True):
                own = slice(s, s + k)
                for a, b, share in Tree(points[own], n[own], comp[own]).pairs(lambda a, b, s=s: wanted(a + s, b + s)):
                    yield from keep(a + s, b + s, share)
            short = np.flatnonzero(np.repeat(size <= NODE, size))
            a, b = _inside(np.repeat(np.arange(len(size)), size)[short])
            a, b = short[a], short[b]
            ok = wanted(a, b)
            a, b = a[ok], b[ok]
            for lo in range(0, len(a), 4096):
                x, y = a[lo : lo + 4096], b[lo : lo + 4096]
                bound, need = np.minimum(points[x], points[y]).sum(axis=1, dtype=np.int64), _needed(n[x], n[y])
                fits = bound >= need
                yield from keep(x[fits], y[fits], bound[fits] / need[fits])
            if len(some := np.flatnonzero(partner >= 0)):
                yield from add(some, partner[some])

        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            if not rows.num_rows:
                continue
            key, cell = rows["key"].to_numpy(), rows["cell"].to_numpy()
            cut = int(((key == key[-1]) & (cell == cell[-1])).argmax())
            if cut:
                yield from answer(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None and held.num_rows:
            yield from answer(held)
        if held_pairs:
            yield send()

    ordered = entries.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _met(heads: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether both have the same one of their first HEADS shingles before the one they meet by now."""
    out = np.zeros(len(a), bool)
    place = np.arange(HEADS)
    for lo in range(0, len(a), 4096):
        x, y = a[lo : lo + 4096], b[lo : lo + 4096]
        before = (place < at[x][:, None])[:, :, None] & (place < at[y][:, None])[:, None, :]
        out[lo : lo + 4096] = ((heads[x][:, :, None] == heads[y][:, None, :]) & before).any(axis=(1, 2))
    return out


def _bounded(pairs: DataFrame, points: DataFrame, vectors: str) -> DataFrame:
    """Pairs whose vectors of that name let them reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, _AT_ONCE):
                batch = whole.slice(lo, _AT_ONCE)
                m, n = column(batch, "m").to_numpy(), column(batch, "n").to_numpy()
                fits = np.zeros(len(n), bool)
                gx, gy = (groups_of(k) if vectors == "fine" else np.full(len(k), GROUPS) for k in (m, n))
                for g in np.unique(np.stack([gx, gy], axis=1), axis=0).tolist():
                    some = np.flatnonzero((gx == g[0]) & (gy == g[1]))
                    x, y = (_fold(_unpacked(column(batch, c).take(pa.array(some)).to_pylist(), h), min(g)) for c, h in zip("xy", g, strict=True))
                    fits[some] = np.minimum(x, y).sum(axis=1, dtype=np.int64) >= _needed(m[some], n[some])
                yield pa.RecordBatch.from_arrays([column(batch, c).filter(pa.array(fits)) for c in "ab"], names=["a", "b"])

    x = points.select(F.col("id").alias("a"), F.col(vectors).alias("x"), F.col("n").alias("m"))
    y = points.select(F.col("id").alias("b"), F.col(vectors).alias("y"), "n")
    near = (100 * F.col("m") >= PERCENT * F.col("n")) & (100 * F.col("n") >= PERCENT * F.col("m"))
    return pairs.join(x, "a").join(y, "b").where(near).select("a", "b", "x", "y", "m", "n").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, points: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose sets are linked: only documents in pairs that their fine vectors (points:
    id, n, fine) let through are read again, and each pair's second set travels to its first."""
    pairs = stored(_bounded(pairs, points, "fine"), "pairs")
    wanted = stored(pairs.select(F.col("a").alias("i")).unionByName(pairs.select(F.col("b").alias("i"))).distinct(), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in passes(text_column(batch, text_col)):
                key, doc = shingle_sets(t)
                cut = np.searchsorted(doc, np.arange(t.n + 1))
                yield pa.RecordBatch.from_arrays([column(batch, id_col).slice(t.first, t.n), pa.array([key[a:b].tobytes() for a, b in itertools.pairwise(cut.tolist())], pa.binary())], names=["id", "keys"])

    found = stored(among(docs.select(id_col, text_col), id_col, wanted).mapInArrow(sets, "id long, keys binary"), "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(column(batch, "x"), column(batch, "y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([column(batch, c).filter(pa.array(good, pa.bool_())) for c in "ab"], names=["a", "b"])

    x, y = found.select(F.col("id").alias("a"), F.col("keys").alias("x")), found.select(F.col("id").alias("b"), F.col("keys").alias("y"))
    out = stored(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "verified")
    discard(found, pairs, wanted)
    return out


def _places(lists: DataFrame, found: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Entries with their components (found: node, component), and how many blocks the lists have that
    are of at least `least` entries and of more than one component."""
    own = lists.select("key", "id", "n", "at").join(found.withColumnRenamed("node", "id"), "id", "left")
    own = stored(own.withColumn("component", F.coalesce("component", "id")), "places")
    sums = own.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"))
    return own, stored(sums.where((F.col("x") != F.col("y")) & (F.col("size") >= least)).select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "mixed")


def _cells(own: DataFrame, mixed: DataFrame, points: DataFrame) -> DataFrame:
    """(key, cell, block, id, n, at, component, counts, heads): an entry of a list of several blocks
    comes once for each block that its own is paired with."""
    dealt = own.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = dealt.select("*", other.alias("other")).withColumn("cell", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
    return cells.join(points.select("id", "counts", "heads"), "id").select("key", F.col("cell").cast("int"), "block", "id", "n", "at", "component", "counts", "heads")


def _entries(alone: DataFrame) -> DataFrame:
    """(key, id, n, at, leader), stored: lists of two and more documents. Lists of shingles known to be
    frequent are never sorted into one task: their leaders are counted, partly before the shuffle. The
    other ones come in DEALS parts, one after the other, so that only one of these is on disk."""
    postings = alone.select("id", "n", "rare", F.posexplode("prefix").alias("at", "key"))
    rare = postings.where("at < rare").select("key", "id", "n", "at")
    parts = [stored(_lists(rare.where(F.pmod("key", F.lit(DEALS)) == k)), "lists-part") for k in range(DEALS)]
    short = functools.reduce(DataFrame.unionByName, parts)
    long_ = postings.where("at >= rare").select("key", "id", "n", "at")
    leaders = stored(long_.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader <> last").drop("last"), "leaders")
    lists = stored(short.unionByName(long_.join(leaders, "key")), "lists")
    discard(*parts, leaders)
    return lists


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: its set's size and the least id reachable by
    links, its own if there is none.

    Null texts and texts without words have the empty set and link with nothing. Equal sets are one
    class from the start. Rows that share an id each keep their own size and are of one class, with
    all that either links to; rows without an id link with nothing and have no class. Every link
    between different sets of different classes is looked for: lists have no cap, and their frequent
    shingles only change the order of prefixes. Links inside a class aren't counted.
    """
    wide = stored(prefixes(docs, frequent_shingles(docs, text_col), id_col, text_col), "prefixes")
    some = wide.where("n > 0 and id is not null").select("id", "n", "s1", "s2")
    twins = stored(some.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "equal-sets")
    members = stored(some.join(twins, ["n", "s1", "s2"]).select("id", "s1", "s2", "rep"), "members")
    shared = some.groupBy("id").agg(F.min(F.struct("s1", "s2")).alias("x"), F.max(F.struct("s1", "s2")).alias("y")).where("x <> y").select("id")
    same_id = members.where("id <> rep").join(shared, "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    alone = without(wide.where("n > 0 and id is not null").select("id", "n", "s1", "s2", "rare", "prefix"), stored(members.where("id <> rep").select("id", "s1", "s2").distinct(), "copies"))
    lists = _entries(alone)
    points = stored(among(wide.select("id", "n", "counts", "fine", F.slice("prefix", 1, HEADS).alias("heads")), "id", stored(lists.select("id").distinct(), "in-lists")), "points")
    sizes = stored(wide.select("id", "n"), "sizes")
    same_id = stored(same_id, "same-id")
    discard(wide)

    # First round: each document with the list leader that it shares most prefix shingles with.
    stars = lists.where("id <> leader").groupBy("id", "leader").count()
    best = stars.groupBy("id").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("leader"))
    pairs = best.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    star = stored(_bounded(pairs, points, "counts"), "star")
    links = verified(star, points, docs, id_col, text_col)
    discard(star)
    links = stored(links.unionByName(same_id), "links")
    found = stored(components(links), "first-round")

    # Second round: in long lists each document's best partner of another component. Third: the rest.
    for least, best_only in ((NODE + 1, True), (2, False)):
        places = _places(lists, found, least)
        candidates = stored(_tree_pairs(_cells(*places, points), best_only), "candidates")
        discard(*places)
        more = verified(candidates, points, docs, id_col, text_col)
        discard(candidates)
        links = stored(links.unionByName(more), "all-links")
        found = stored(components(links), "round")
    discard(lists, points)

    ids = members.groupBy("id").agg(F.min("rep").alias("rep"))
    of_copies = ids.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("c"))
    own = sizes.join(of_copies, "id", "left").join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    return own.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "c", "id").alias("component_id"))
