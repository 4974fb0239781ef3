"""Language-model scoring by context-tree weighting over bytes, beside a smoothed word model.

Each byte is predicted as eight binary decisions. A decision's context is the bits of the byte so
far and the 0 to DEPTH bytes before; at each context a Krichevsky-Trofimov estimator has counted
the bit. The tree mixes the estimators of all depths: a node's probability of all its training bits
is half its own estimator's and half its children's product, which gives the share that each depth
has in a prediction. Counts are all that matters, so training is counting n-grams of bytes.

The tree holds every context of the training texts, whatever their number: subtrees under two bytes
are weighted by the tasks that hold their counts, the driver mixes the 257 nodes above them, and a
second pass turns the subtrees into a distributed table of log probabilities. Tasks that score hold
the rows of the HELD most frequent contexts; bytes in other contexts are joined with the table.

Texts are lower-cased (A-Z), preceded by DEPTH marks and followed by one: byte 0xFF, never in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, stored, text_column
from .words import U64, Texts, passes

#: Bytes of the longest context. Subtrees start two levels below the root, so it is four.
DEPTH = 4
#: Contexts whose rows (256 doubles) every scoring task holds. Only the way to a row depends on it.
HELD = 16_384
#: Contexts of DEPTH bytes weighted together.
_AT_ONCE = 2_048
#: Words whose counts every task holds; the rest's counts are joined.
FREQUENT = 1 << 18
MARK = 0xFF
END_KEY = 1  # the end token's key among words' hashes

_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def _spread(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with marks around each text; places of the bytes to predict; bytes to predict by text."""
    size = np.diff(t.at)
    out = np.full(len(t.raw) + (DEPTH + 1) * t.n, MARK, np.uint8)
    doc = np.repeat(np.arange(t.n), size)
    place = np.arange(len(t.raw)) + DEPTH + (DEPTH + 1) * doc
    out[place] = _SMALL[t.raw]
    wanted = np.ones(len(out), bool)
    first = t.at[:-1] + (DEPTH + 1) * np.arange(t.n)
    for k in range(DEPTH):
        wanted[first + k] = False
    return out, np.flatnonzero(wanted), size + 1


def _held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 10 == 0


def _sum_equal(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def corpus_counts(train: DataFrame, text_col: str) -> DataFrame:
    """(kind, key, n): of all training texts, kind 0: words by hash and the end token; kind 1:
    DEPTH + 1 bytes. Each task sums what it has seen before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[list, list]] = [([], []), ([], [])]
        held = [0, 0]

        def send(kind: int) -> pa.RecordBatch:
            k, c = _sum_equal(*found[kind])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(c)], names=["kind", "key", "n"])

        for batch in batches:
            for t in passes(text_column(batch, text_col)):
                data, at, _ = _spread(t)
                gram = np.zeros(len(at), U64)
                for k in range(DEPTH + 1):
                    gram = (gram << U64(8)) | data[at - DEPTH + k]
                for kind, keys in ((0, np.append(word_keys(t), np.full(t.n, END_KEY, U64))), (1, gram)):
                    k, c = np.unique(keys, return_counts=True)
                    found[kind][0].append(k)
                    found[kind][1].append(c)
                    held[kind] += len(k)
                    if held[kind] > 3_000_000:  # bounds a task's memory, whatever it reads
                        k, c = _sum_equal(*found[kind])
                        if len(k) > 2_000_000:
                            yield send(kind)
                            k, c = k[:0], c[:0]
                        found[kind] = ([k], [c])
                        held[kind] = len(k)
        for kind in (0, 1):
            if found[kind][0]:
                yield send(kind)

    each = train.select(text_col).mapInArrow(run, "kind byte, key long, n long")
    return each.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def word_keys(t: Texts) -> np.ndarray:
    """Hashes of a pass's words; never END_KEY."""
    return t.hashes(lower=True) | U64(2)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: Stirling's series from x + 8 on, and the recurrence down."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    down = np.ones_like(x)
    for k in range(8):
        down = down * (x + k)
    return series - np.log(down)


_HALF = float(log_gamma(np.array([0.5]))[0])


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the estimator's probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - 2 * _HALF


_LOG2 = float(np.log(2))
#: The decisions of a byte, first to last bit: bytes lo to mid are a zero, mid to hi a one.
_CUTS = np.array([(lo, lo + (128 >> level), lo + (256 >> level)) for level in range(8) for lo in range(0, 256, 256 >> level)]).T


def _decisions(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each of the 255 decisions, from sums (k, 257) of counts of smaller bytes."""
    lo, mid, hi = _CUTS
    return (sums[:, mid] - sums[:, lo]).astype(float), (sums[:, hi] - sums[:, mid]).astype(float)


def _mixed(sums: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log of the weighted probability, share of its own estimator, its next prediction of a one) of
    nodes, from their counts and the sums of their children's logs."""
    zero, one = _decisions(sums)
    own = _log_kt(zero, one)
    both = np.logaddexp(own, children)
    return both - _LOG2, np.exp(own - both), (one + 0.5) / (zero + one + 1)


def _below(left: np.ndarray, so_far: np.ndarray, share: np.ndarray, kt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is left to a node's children, and what it and those above it have predicted."""
    return left * (1 - share), so_far + left * share * kt


def _log_rows(q: np.ndarray) -> np.ndarray:
    """log10 probabilities (k, 256) of all bytes from those of a one at each decision."""
    out = np.zeros((len(q), 256))
    one, zero = np.log10(q), np.log10(1 - q)
    for j, (lo, mid, hi) in enumerate(_CUTS.T.tolist()):
        out[:, lo:mid] += zero[:, j, None]
        out[:, mid:hi] += one[:, j, None]
    return out


def _unseen(left: np.ndarray, so_far: np.ndarray) -> np.ndarray:
    """Rows for contexts that a node has no child for: what is left predicts either bit alike."""
    return _log_rows(so_far + left * 0.5)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """(contexts of DEPTH bytes, sums of their counts, portions) of one pair of last bytes after
    another, from (two, key, n) sorted by pair and context. Portions are whole contexts of three."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        if not rows.num_rows:
            continue
        two = rows["two"].to_numpy()
        edges = [0, *(np.flatnonzero(two[1:] != two[:-1]) + 1).tolist()]
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield _subtree(rows.slice(lo, hi - lo))
        held = rows.slice(edges[-1])
    if held is not None and held.num_rows:
        yield _subtree(held)


def _subtree(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    key, n = rows["key"].to_numpy(), rows["n"].to_numpy()
    contexts, at = np.unique(key >> 8, return_inverse=True)
    three = contexts & 0xFFFFFF
    order = np.lexsort((contexts, three))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    contexts, three, at = contexts[order], three[order], place[at]
    entry = np.lexsort((key & 255, at))
    starts = np.flatnonzero(np.concatenate([[True], three[1:] != three[:-1]]))
    portions, lo = [], 0
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(contexts)], strict=True):
        if b - lo > _AT_ONCE and a > lo:
            portions.append((lo, a))
            lo = a
    portions.append((lo, len(contexts)))
    return contexts, np.stack([at[entry], key[entry] & 255, n[entry]]), portions


def _portion(contexts: np.ndarray, entries: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums of counts of contexts lo to hi, first ones of the contexts of three, these)."""
    a, b = np.searchsorted(entries[0], [lo, hi])
    sums = np.zeros((hi - lo, 257), np.int64)
    sums[entries[0, a:b] - lo, entries[1, a:b] + 1] = entries[2, a:b]
    np.cumsum(sums, axis=1, out=sums)
    three = contexts[lo:hi] & 0xFFFFFF
    first = np.flatnonzero(np.concatenate([[True], three[1:] != three[:-1]]))
    return sums, first, three[first]


def _weighed(contexts: np.ndarray, entries: np.ndarray, portions: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts, and of the children's logs, of the node that a subtree hangs from."""
    counts, children = np.zeros((1, 257), np.int64), np.zeros((1, 255))
    for lo, hi in portions:
        sums, first, _ = _portion(contexts, entries, lo, hi)
        above = np.add.reduceat(sums, first)
        logs = _mixed(above, np.add.reduceat(_log_kt(*_decisions(sums)), first))[0]
        counts += above.sum(axis=0)
        children += logs.sum(axis=0)
    return counts, children


def _top(spark: SparkSession, ordered: DataFrame) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], dict[int, np.ndarray], np.ndarray]:
    """Of the nodes of one byte: what is left to their children and has been predicted; rows for what
    is unseen below them, and below the root. The driver gets 256 nodes at most."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[int, list[np.ndarray]] = {}
        for contexts, entries, portions in _subtrees(batches):
            counts, children = _weighed(contexts, entries, portions)
            own = nodes.setdefault(int(contexts[0]) & 255, [np.zeros(257, np.int64), np.zeros(255)])
            own[0] += counts[0]
            own[1] += _mixed(counts, children)[0][0]
        yield _node_rows(nodes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for one, counts, logs in zip(*(column(batch, c).to_pylist() for c in ("one", "counts", "logs")), strict=True):
                own = nodes.setdefault(one, [np.zeros(257, np.int64), np.zeros(255)])
                own[0] += np.frombuffer(counts, np.int64)
                own[1] += np.frombuffer(logs)
        yield _node_rows(nodes)

    kind = "one int, counts binary, logs binary"
    nodes = ordered.mapInArrow(weigh, kind).repartition("one").sortWithinPartitions("one", "counts", "logs").mapInArrow(add, kind).toArrow().sort_by("one")
    ones = nodes["one"].to_pylist()
    counts = np.array([np.frombuffer(x, np.int64) for x in nodes["counts"].to_pylist()], np.int64).reshape(-1, 257)
    logs, share, kt = _mixed(counts, np.array([np.frombuffer(x) for x in nodes["logs"].to_pylist()], float).reshape(-1, 255))
    _, root_share, root_kt = _mixed(counts.sum(axis=0, keepdims=True), logs.sum(axis=0, keepdims=True))
    left, so_far = _below(np.ones((1, 255)), np.zeros((1, 255)), root_share, root_kt)
    below = _below(left, so_far, share, kt)
    rows = _unseen(*below) if ones else np.zeros((0, 256))
    return {one: (below[0][i], below[1][i]) for i, one in enumerate(ones)}, {one: rows[i] for i, one in enumerate(ones)}, _unseen(left, so_far)[0]


def _node_rows(nodes: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([*nodes], pa.int32()), *(pa.array([v[i].tobytes() for v in nodes.values()], pa.binary()) for i in (0, 1))], names=["one", "counts", "logs"])


def fit_bytes(grams: DataFrame) -> tuple[DataFrame, np.ndarray, dict[int, np.ndarray]]:
    """From (key, n) of DEPTH + 1 bytes: (depth, context, total, row) of all contexts of two bytes and
    more, row being the packed log10 probabilities of all bytes where nothing longer has been seen;
    the same for the empty context, and for those of one byte."""
    spark = grams.sparkSession
    ordered = grams.select(F.expr("(key >> 8) & 65535").cast("int").alias("two"), "key", "n").repartition("two").sortWithinPartitions("two", "key")
    nodes, ones, root = _top(spark, ordered)
    held = spark.sparkContext.broadcast(nodes)  # 256 nodes of 510 numbers at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(depth: int, contexts: np.ndarray, totals: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
            packed = pa.array([x.tobytes() for x in _log_rows(q)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(contexts), depth, np.int8)), pa.array(contexts), pa.array(totals), packed], names=["depth", "context", "total", "row"])

        for contexts, entries, portions in _subtrees(batches):
            left, so_far = held.value[int(contexts[0]) & 255]
            counts, children = _weighed(contexts, entries, portions)
            _, share, kt = _mixed(counts, children)
            left, so_far = _below(left, so_far, share, kt)
            yield out(2, contexts[:1] & 0xFFFF, counts[:, -1], so_far + left * 0.5)
            for lo, hi in portions:
                sums, first, three = _portion(contexts, entries, lo, hi)
                above = np.add.reduceat(sums, first)
                zero, one = _decisions(sums)
                _, share, kt = _mixed(above, np.add.reduceat(_log_kt(zero, one), first))
                left3, so_far3 = _below(left, so_far, share, kt)
                yield out(3, three, above[:, -1], so_far3 + left3 * 0.5)
                of = np.repeat(np.arange(len(first)), np.diff(np.append(first, hi - lo)))
                yield out(4, contexts[lo:hi], sums[:, -1], so_far3[of] + left3[of] * (one + 0.5) / (zero + one + 1))

    return stored(ordered.mapInArrow(rows, "depth byte, context long, total long, row binary"), "contexts"), root, ones


@dataclass
class HeldRows:
    """The rows of some contexts of DEPTH bytes, and how to find a text's contexts among them."""

    symbol: np.ndarray  # byte -> small number, 0 for bytes that no context has
    three: np.ndarray  # three symbols -> number, 0 for none
    four: np.ndarray  # number of three, symbol before -> 1 + row, 0 for none
    table: np.ndarray

    @classmethod
    def of(cls, contexts: np.ndarray, table: np.ndarray) -> HeldRows:
        raw = contexts[:, None] >> np.array([24, 16, 8, 0]) & 255
        used = np.unique(raw)
        symbol = np.zeros(256, np.int64)
        symbol[used] = np.arange(1, len(used) + 1)
        a = len(used) + 1
        s = symbol[raw]
        threes, number = np.unique((s[:, 1] * a + s[:, 2]) * a + s[:, 3], return_inverse=True)
        three = np.zeros(a**3, np.int32)
        three[threes] = np.arange(1, len(threes) + 1)
        four = np.zeros((len(threes) + 1) * a, np.int32)
        four[(number + 1) * a + s[:, 0]] = np.arange(1, len(contexts) + 1)
        return cls(symbol, three, four, table)

    def scores(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the sum over bytes whose context is held; (text, gram) of the other bytes."""
        data, at, size = _spread(t)
        s = self.symbol[data]
        a = int(self.symbol.max()) + 1
        number = self.three[(s[at - 3] * a + s[at - 2]) * a + s[at - 1]]
        row = self.four[number * a + s[at - 4]]
        table = self.table.ravel() if len(self.table) else np.zeros(256)
        p = np.where(row > 0, table[np.maximum(row - 1, 0).astype(np.int64) * 256 + data[at]], 0.0)
        other = np.flatnonzero(row == 0)
        gram = np.zeros(len(other), np.int64)
        for k in range(DEPTH + 1):
            gram = (gram << 8) | data[at[other] - DEPTH + k]
        return np.add.reduceat(p, np.cumsum(size) - size), np.searchsorted(np.cumsum(size), other, "right"), gram


def _steps(count: str):
    return F.floor(F.log2(count) * 8)


def _least_step(rows: DataFrame, count: str, most: int) -> int:
    """The least step of counts from which on there are at most `most` rows; no sorting, and the
    driver gets a few hundred sizes."""
    held, least = 0, 1 << 30
    for r in sorted(rows.groupBy(_steps(count).alias("s")).count().collect(), key=lambda r: -r["s"]):
        held += r["count"]
        if held > most:
            break
        least = r["s"]
    return least


def _others(scored: DataFrame, table: DataFrame, root: np.ndarray, ones: dict[int, np.ndarray]) -> DataFrame:
    """(row, more_score) from scored rows' other grams: each is looked up under the longest context
    that the table has."""
    grams = scored.select("row", F.explode("others").alias("gram")).groupBy("row", "gram").count()
    for depth in (4, 3, 2):
        own = table.where(F.col("depth") == depth).select(F.col("context").alias("c"), F.col("row").alias("p"))
        context = F.expr(f"(gram >> 8) & {(1 << 8 * depth) - 1}L")
        found = grams.join(own, context == F.col("c"), "left")
        value = F.substring("p", F.expr("8 * (gram & 255) + 1").cast("int"), 8)
        grams = found.withColumn(f"p{depth}", value).drop("c", "p")
    held = table.sparkSession.sparkContext.broadcast((root, ones))  # 257 rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, ones = held.value
        for batch in batches:
            gram, count = column(batch, "gram").to_numpy(), column(batch, "count").to_numpy()
            p = column(batch, "p").to_pylist()
            worth = [np.frombuffer(x)[0] if x is not None else ones.get(g >> 8 & 255, root)[g & 255] for x, g in zip(p, gram.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "row"), pa.array(np.array(worth, float) * count)], names=["row", "worth"])

    each = grams.select("row", "gram", "count", F.coalesce("p4", "p3", "p2").alias("p")).mapInArrow(run, "row long, worth double")
    return each.groupBy("row").agg(F.sum("worth").alias("more_score"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).

    Null and empty texts have the end token only. Words' counts: the FREQUENT ones are held by each
    task; the others of each document are joined with the counts by hash, none of which is hot.
    Repeated ids are scored as rows of their own.
    """
    spark = docs.sparkSession
    source = docs.select(id_col, text_col, _held_out(id_col).alias("held_out"))
    counts = stored(corpus_counts(source.where(~F.col("held_out")), text_col), "corpus-counts")
    words = counts.where("kind = 0").select("key", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    train_tokens, distinct = int(total[0]), int(total[1])
    top = words.where(_steps("n") >= _least_step(words, "n", FREQUENT)).toArrow()  # at most FREQUENT rows
    key = top["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    key, often = key[order], top["n"].to_numpy()[order]
    norm = np.log10(train_tokens + 0.1 * (distinct + 1))
    table, root, ones = fit_bytes(counts.where("kind = 1").select("key", "n"))
    longest = table.where(F.col("depth") == DEPTH)
    held = longest.where(_steps("total") >= _least_step(longest, "total", HELD)).select("context", "row").toArrow()  # at most HELD rows
    rows = HeldRows.of(held["context"].to_numpy(), np.frombuffer(b"".join(held["row"].to_pylist())).reshape(-1, 256))
    model = spark.sparkContext.broadcast((rows, key, often))
    complete = distinct == len(key)
    kind = dict(source.dtypes)[id_col]

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, key, often = model.value
        worth = np.log10(often + 0.1) - norm
        unknown = np.log10(0.1) - norm
        end = np.searchsorted(key, np.uint64(END_KEY))
        end_known = end < len(key) and key[end] == END_KEY
        for batch in batches:
            for t in passes(text_column(batch, text_col)):
                h = word_keys(t)
                at = np.minimum(np.searchsorted(key, h), max(len(key) - 1, 0))
                found = key[at] == h if len(key) else np.zeros(len(h), bool)
                base = t.counts_sum(np.where(found, worth[at] if len(key) else 0.0, unknown if complete else 0.0)) + (worth[end] if end_known else unknown)
                known = t.counts(found) + int(end_known)
                rare = t.counts(~found) if not complete else np.zeros(t.n, np.int64)
                rares = lists(h[~found].view(np.int64) if not complete else np.zeros(0, np.int64), rare)
                part = batch.slice(t.first, t.n)
                log, doc, grams = m.scores(t)
                yield pa.RecordBatch.from_arrays([column(part, id_col), column(part, "held_out"), pa.array(t.counts() + 1), pa.array(np.diff(t.at) + 1), pa.array(known), pa.array(base), pa.array(log), rares, lists(grams, np.bincount(doc, minlength=t.n))], names=[id_col, "held_out", "n_tokens", "n_bytes", "known", "base", "score", "rare", "others"])

    scored = source.mapInArrow(run, f"{id_col} {kind}, held_out boolean, n_tokens long, n_bytes long, known long, base double, score double, rare array<long>, others array<long>")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    if not complete:
        rare = scored.select("row", F.explode("rare").alias("key")).join(words, "key", "left")
        c = F.coalesce(F.col("n"), F.lit(0))
        extra = rare.groupBy("row").agg(F.count("n").alias("more_known"), F.sum(F.log10(c + 0.1) - float(norm)).alias("more_base"))
        scored = scored.join(extra, "row", "left")
        scored = scored.withColumns({"known": F.col("known") + F.coalesce("more_known", F.lit(0)), "base": F.col("base") + F.coalesce("more_base", F.lit(0.0))})
    scored = scored.join(_others(scored, table, root, ones), "row", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    bits = -F.col("score") / float(np.log10(2)) / F.col("n_bytes")
    return scored.select(id_col, "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", bits.alias("bits_per_byte"))
