"""Spelling variants: words one edit apart, and the form that each is a variant of.

The vocabulary is cut into shards of bounded size. Each shard is a compact trie: nodes as far as words
share them, then the rest of the one word below. Tries are broadcast, a few at a time; tasks walk every
word's distance-one automaton down every trie, depth first: along the word's own path all words of a
batch go together, and at each node of it the states with their one edit done are followed to their end
before the next node is visited. A task reduces what it finds to a number and a best form for each word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import column, discard, stored

# Letters, the share of words that lose a letter, and which words count.
LETTERS = r"[a-zÀ-ÿ]"
ONE_IN = 97
LEAST_LETTERS, LEAST_COUNT = 5, 3

#: Words and bytes of text of a shard at most (but for a single longer word); a trie takes about 50 bytes a word.
SHARD_WORDS, SHARD_BYTES = 1 << 18, 1 << 24
#: Tries that are broadcast at once.
AT_ONCE = 4
#: Words that a task takes, so that a vocabulary of any size is walked in enough tasks.
TASK_WORDS = 20_000


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (word) for each run of letters of whole texts that can have five letters left. Runs are lower-cased, and lose
    one letter where 97 divides the CRC of id and run. A null id counts as an empty one, a null text has no words."""
    runs = F.regexp_extract_all(lowered(F.col(text_col)), F.lit(f"{LETTERS}{{{LEAST_LETTERS},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    crc = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.pmod(crc, F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(crc % ONE_IN == 0, less).otherwise(F.col("run"))
    return each.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words that occur three times."""
    return words(docs, id_col, text_col).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Strings:
    """Words of one byte a letter, one after the other."""

    def __init__(self, each: pa.Array) -> None:
        parts = [w.encode("latin-1") for w in each.to_pylist()]
        self.raw = np.frombuffer(b"".join(parts) + b"\0", np.uint8)
        self.size = np.array([len(p) for p in parts], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def __len__(self) -> int:
        return len(self.size)

    def byte(self, word: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        """The letter at a place; at the end, whatever follows."""
        return self.raw[self.at[word] + place]


def shared_prefix(a: Strings, i: np.ndarray, x: np.ndarray, b: Strings, j: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Letters that words i of a from places x on have in common with words j of b from places y on."""
    most = np.minimum(a.size[i] - x, b.size[j] - y)
    out = np.zeros(len(i), np.int64)
    on = np.flatnonzero(most > 0)
    k = 0
    while len(on):
        on = on[a.byte(i[on], x[on] + k) == b.byte(j[on], y[on] + k)]
        k += 1
        out[on] = k
        on = on[most[on] > k]
    return out


def same_rest(a: Strings, i: np.ndarray, x: np.ndarray, b: Strings, j: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether words i of a from places x on are words j of b from places y on."""
    rest = a.size[i] - x
    out = rest == b.size[j] - y
    on = np.flatnonzero(out)
    out[on] = shared_prefix(a, i[on], x[on], b, j[on], y[on]) == rest[on]
    return out


class Trie:
    """Distinct words in code-point order, and their trie. Nodes are numbered by depth and then in order, so the
    edges, (parent, letter), are sorted too; a leaf is where only one word goes on."""

    def __init__(self, words: pa.Array, n: np.ndarray) -> None:
        order = np.argsort(np.array([w.encode("latin-1") for w in words.to_pylist()], dtype=object), kind="stable")
        words = words.take(pa.array(order))
        self.words, self.n = words, n[order]
        self.text = t = Strings(words)
        m = len(t)
        k = np.arange(max(m - 1, 0))
        zero = np.zeros(len(k), np.int64)
        with_next = shared_prefix(t, k, zero, t, k + 1, zero)
        before = np.concatenate([[0], with_next])[:m]
        after = np.concatenate([with_next, [0]])[:m]
        deepest = np.minimum(t.size, np.maximum(before, after) + 1)  # of the nodes that a word has
        on = np.arange(m)
        parents, keys, ends, leaves = np.zeros(m, np.int64), [], [np.full(1, -1)], [np.full(1, -1)]
        first, depth = 0, 0  # number of the first node of the last level
        makers = np.zeros(min(m, 1), np.int64)  # the first word of each node of the last level
        while len(on):
            depth += 1
            on = on[deepest[on] >= depth]
            new = on[before[on] < depth]
            if not len(new):
                continue
            parents = first + np.searchsorted(makers, new, "right") - 1
            keys.append(parents << 8 | t.byte(new, depth - 1))
            first += len(makers)
            makers = new
            # after[] of the word before the next node's is below this depth: the node's words end there
            whole = t.size[new] == depth
            alone = after[new] < depth
            ends.append(np.where(whole & ~alone, new, -1))
            leaves.append(np.where(alone, new, -1))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.end, self.leaf = np.concatenate(ends), np.concatenate(leaves)
        self.child_at = np.searchsorted(self.keys, np.arange(len(self.end) + 1) << 8)

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node below by a letter, or -1."""
        key = node << 8 | letter
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at + 1, -1) if len(self.keys) else np.full(len(key), -1)

    def children(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into node, letter, node below) of all children."""
        a, b = self.child_at[node], self.child_at[node + 1]
        size = b - a
        stop = np.cumsum(size)
        at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(a - stop + size, size)
        return np.repeat(np.arange(len(node)), size), self.keys[at] & 255, at + 1

    def _followed(self, q: Strings, i: np.ndarray, node: np.ndarray, place: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, word) accepted from states whose edit is done: words i go on at their places from nodes of a depth."""
        while len(i):
            leaf = self.leaf[node]
            at = np.flatnonzero(leaf >= 0)
            if len(at):
                good = at[same_rest(q, i[at], place[at], self.text, leaf[at], np.full(len(at), depth))]
                yield i[good], leaf[good]
            on = leaf < 0
            over = on & (place == q.size[i])
            done = np.flatnonzero(over & (self.end[node] >= 0))
            if len(done):
                yield i[done], self.end[node[done]]
            on = np.flatnonzero(on & ~over)
            i, node, place = i[on], node[on], place[on]
            node = self.child(node, q.byte(i, place))
            on = np.flatnonzero(node >= 0)
            i, node, place, depth = i[on], node[on], place[on] + 1, depth + 1

    def near(self, q: Strings) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into q, index of a word) that are exactly one insertion, deletion or replacement apart, each once.

        Of several places where an edit gives the same word only the last is tried."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        i, node, d = np.arange(len(q)), np.zeros(len(q), np.int64), 0
        while len(i) and len(self.keys):
            leaf = self.leaf[node]
            at = np.flatnonzero(leaf >= 0)
            if len(at):
                a, b, here = i[at], leaf[at], np.full(len(at), d)
                same = d + shared_prefix(q, a, here, self.text, b, here)
                longer = self.text.size[b] - q.size[a]
                good = (np.abs(longer) <= 1) & ~((longer == 0) & (same == q.size[a]))
                a, b, same, longer = a[good], b[good], same[good], longer[good]
                good = same_rest(q, a, same + (longer <= 0), self.text, b, same + (longer >= 0))
                found.append((a[good], b[good]))
            on = np.flatnonzero(leaf < 0)
            i, node = i[on], node[on]
            over = q.size[i] == d
            letter = np.where(over, 256, q.byte(i, d))
            which, label, below = self.children(node)
            other = label != letter[which]
            which, below = which[other], below[other]
            inside = ~over[which]
            here = np.full(len(which), d)
            following = np.where(q.size[i] == d + 1, 256, q.byte(i, np.minimum(d + 1, q.size[i])))
            gone = np.flatnonzero(~over & (letter != following))
            found += self._followed(q, i[which], below, here, d + 1)  # a letter more
            found += self._followed(q, i[which[inside]], below[inside], here[inside] + 1, d + 1)  # another letter
            found += self._followed(q, i[gone], node[gone], np.full(len(gone), d + 1), d)  # a letter less
            on = np.flatnonzero(~over)
            i, node = i[on], self.child(node[on], letter[on])
            on = np.flatnonzero(node >= 0)
            i, node, d = i[on], node[on], d + 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


_FOUND = "word string, n long, n_near long, best string, best_n long"


def _walk(vocab: DataFrame, tries: list[Broadcast]) -> DataFrame:
    """(word, n, n_near, best, best_n) of all words against some tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = column(batch, "word"), column(batch, "n")
            q = Strings(word)
            number, best, best_n = np.zeros(len(q), np.int64), [None] * len(q), np.zeros(len(q), np.int64)
            for trie in (t.value for t in tries):
                i, j = trie.near(q)
                number += np.bincount(i, minlength=len(q))
                order = np.lexsort((j, -trie.n[j], i))
                i, first = np.unique(i[order], return_index=True)
                j = j[order][first]
                for a, form, m in zip(i.tolist(), trie.words.take(pa.array(j)).to_pylist(), trie.n[j].tolist(), strict=True):
                    if m > best_n[a] or m == best_n[a] and form < best[a]:
                        best[a], best_n[a] = form, m
            yield pa.RecordBatch.from_arrays([word.cast(pa.string()), n, pa.array(number), pa.array(best, pa.string()), pa.array(best_n)], names=["word", "n", "n_near", "best", "best_n"])

    return vocab.select("word", "n").mapInArrow(run, _FOUND)


def _shards(vocab: DataFrame) -> tuple[DataFrame, int]:
    """The vocabulary with `shard`, and the number of shards, none of them above its bounds unless by one word."""
    total, size = vocab.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    k = max(1, math.ceil(total / SHARD_WORDS), math.ceil(size / SHARD_BYTES))
    while True:
        cut = vocab.withColumn("shard", F.pmod(F.xxhash64("word"), F.lit(k)))
        sums = cut.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("size"))
        if not sums.where((F.col("n") > 1.5 * SHARD_WORDS) | (F.col("size") > 1.5 * SHARD_BYTES) & (F.col("n") > 1)).limit(1).count():
            return cut, k
        k *= 2


def neighbours(vocab: DataFrame) -> DataFrame:
    """(word, n, n_near, best, best_n) of a vocabulary (word, n; distinct words of letters up to U+00FF, stored):
    words exactly one edit away, and the most frequent of them (of equals the first in code-point order)."""
    spark = vocab.sparkSession
    total = vocab.count()
    shards, k = _shards(vocab)
    dealt = vocab.repartition(max(1, math.ceil(total / TASK_WORDS)))
    out = None
    for first in range(0, k, AT_ONCE):
        tries = []
        for s in range(first, min(first + AT_ONCE, k)):
            part = shards.where(F.col("shard") == s).select("word", "n").toArrow().combine_chunks()
            words = part.column("word").combine_chunks() if part.num_rows else pa.array([], pa.string())
            tries.append(spark.sparkContext.broadcast(Trie(words, part.column("n").to_numpy())))
        found = stored(_walk(dealt, tries), "near")
        for t in tries:
            t.destroy()
        out = found if out is None else out.unionByName(found)
    if k <= AT_ONCE:
        return out
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))))
    summed = out.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return stored(summed.select("word", "n", "n_near", F.col("b.w").alias("best"), F.coalesce(-F.col("b.n"), F.lit(0)).alias("best_n")), "near-all")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form) without cycles: the last form that each word leads to. Each round
    doubles the steps that are taken at once."""
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        more = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(now.join(more, "root", "left").select("word", "root", "next"), "roots")
        moved = further.where("next is not null").limit(1).count()
        discard(now)
        now = further.select("word", F.coalesce("next", "root").alias("root"))
        if not moved:
            return now
        now = stored(now, "roots")
        discard(further)


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of whole texts.

    form: of the words one edit away the most frequent, if it is at least twice as frequent as the word,
    else null; root: the last word that forms lead to, the word itself without one. Rows that share
    an id count each; without texts there is no row.
    """
    vocab = stored(vocabulary(docs, id_col, text_col), "vocabulary")
    near = neighbours(vocab)
    is_form = F.col("best_n") >= 2 * F.col("n")
    found = near.select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    last = roots(found.where("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
