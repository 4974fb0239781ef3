"""Quality rules: plain counts per document and a hashed n-gram log-likelihood ratio.

The method's verdict compares two multinomials over hashed words and word pairs: one of documents
that labels call good and not toxic (the trusted target), one of all documents (the raw corpus).
A document's score is the mean over its n-grams of log(p_target / p_raw). A document is kept when
the score is not below a threshold fixed by labelled documents. Everything is deterministic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import IDS_SENT, column, stored, text_column
from .words import Texts, passes, splitmix, windows

#: Buckets that hash values of n-grams are counted in.
BUCKETS = 1 << 14
#: Ranges of scores of labelled documents that are ranked each by itself.
RANGES = 4096
#: Share of trusted documents that the threshold has to keep.
KEEP_TRUSTED = 0.998
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True

FEATURES = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


@dataclass
class Verdict:
    """weights: log(p_target / p_raw) for each bucket; threshold: the least mean that is kept."""

    weights: np.ndarray
    threshold: float


def _grams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a pass's words and word pairs, and the text of each."""
    h = t.hashes(lower=True)
    pairs, first = windows(t, h, 2)
    both = np.concatenate([h, splitmix(pairs)])
    return (both & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([t.doc, t.doc[first]])


def _repeats(keys: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over keys: equal to another one of the same group; equal to an earlier one of it."""
    n = len(keys)
    again, later = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        order = np.lexsort((keys, groups)) if n < 64 else np.argsort(keys ^ splitmix(groups), kind="stable")
        k, g = keys[order], groups[order]
        same = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
        later[order[1:]] = same
        again[order[1:]] = same
        again[order[:-1]] |= same
    return again, later


def base_counts(t: Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a pass's texts."""
    inside = np.zeros(len(t.raw) + 1, np.int8)
    inside[t.start] += 1
    inside[t.end] -= 1
    inside = np.cumsum(inside, dtype=np.int8)[:-1].astype(bool)
    h = t.hashes(lower=False)
    threes, first = windows(t, h, 3)
    again, _ = _repeats(threes, t.doc[first])
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[first[again] + k] = True
    breaks = np.flatnonzero(t.raw == 10)
    starts = np.union1d(t.at[:-1][np.diff(t.at) > 0], breaks + 1)
    starts = starts[starts < len(t.raw)]
    ends = np.minimum(np.append(starts[1:], len(t.raw)), len(t.raw))
    ends = ends - ((ends > starts) & (ends > 0) & (t.raw[ends - 1] == 10))
    worded = np.searchsorted(t.start, ends) > np.searchsorted(t.start, starts)
    starts, ends = starts[worded], ends[worded]
    line_doc = np.searchsorted(t.at, starts, "right") - 1
    _, later = _repeats(t.span_hashes(starts, ends, False), line_doc)
    return {
        "n_words": t.counts(),
        "word_chars": t.byte_sums(inside & ((t.raw & 0xC0) != 0x80)),
        "n_symbols": t.byte_sums(_IS_SYMBOL[t.raw]),
        "n_dup_lines": np.bincount(line_doc[later], minlength=t.n),
        "n_repeat_words": t.counts(covered),
    }


def _base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > 50 * base["n_words"])


def _labelled(labels: DataFrame, id_col: str) -> DataFrame:
    """(id, good) of all documents that labels call good and not toxic, or bad; what is called both is good."""
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), F.lit(False))
    rows = labels.where(F.col(id_col).isNotNull()).select(id_col, good.alias("good"), F.coalesce(F.col("quality") == 0, F.lit(False)).alias("bad"))
    return rows.where("good or bad").groupBy(id_col).agg(F.max("good").alias("good"))


def _sent(labelled: DataFrame) -> DataFrame:
    """Labelled documents to be joined: they go to the texts as long as they are few, else both are shuffled."""
    return F.broadcast(labelled) if labelled.limit(IDS_SENT + 1).count() <= IDS_SENT else labelled


def corpus_counts(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, raw, target): how often each bucket occurs in all documents and in the trusted ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = column(batch, "good").fill_null(False).to_numpy(zero_copy_only=False)
            for t in passes(text_column(batch, text_col)):
                buckets, doc = _grams(t)
                raw += np.bincount(buckets, minlength=BUCKETS)
                target += np.bincount(buckets[good[t.first + doc]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    each = docs.select(id_col, text_col).join(labelled, id_col, "left").select(text_col, "good").mapInArrow(count, "bucket long, raw long, target long")
    return each.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def _means(t: Texts, weights: np.ndarray) -> np.ndarray:
    buckets, doc = _grams(t)
    n = np.bincount(doc, minlength=t.n)
    return np.bincount(doc, weights[buckets], minlength=t.n) / np.maximum(n, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Verdict:
    """Fits the verdict. Without trusted documents every weight is 0 and every score passes.

    All labelled documents count. The driver gets BUCKETS counts, RANGES sums and the threshold.
    """
    labelled = _sent(stored(_labelled(labels, id_col), "quality-labels"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, g in corpus_counts(docs, labelled, id_col, text_col).collect():
        raw[bucket], target[bucket] = r, g
    weights = np.zeros(BUCKETS)
    if target.sum():
        weights = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in passes(text_column(batch, text_col)):
                some = ~_base_failed(base_counts(t))
                good = column(batch, "good").slice(t.first, t.n)
                yield pa.RecordBatch.from_arrays([good.filter(pa.array(some)), pa.array(_means(t, weights)[some])], names=["good", "score"])

    found = docs.select(id_col, text_col).join(labelled, id_col).select(text_col, "good").mapInArrow(scores, "good boolean, score double")
    return Verdict(weights, _threshold(stored(found, "quality-scores")))


def _threshold(scores: DataFrame) -> float:
    """Where labelled scores (good, score) part best, but never above what keeps KEEP_TRUSTED of the trusted. Of cuts
    between neighbouring scores that are as good the first; ranges of scores are ranked by themselves."""
    each = scores.groupBy("score").agg(F.sum(F.col("good").cast("long")).alias("yes"), F.sum((~F.col("good")).cast("long")).alias("no"))
    low, high = each.agg(F.min("score"), F.max("score")).first()
    if low is None:
        return float("-inf")
    width = F.lit(high - low if high > low else 1.0)
    each = each.withColumn("range", F.floor((F.col("score") - F.lit(low)) / width * F.lit(float(RANGES))).cast("int"))
    sums = sorted(each.groupBy("range").agg(F.sum("yes"), F.sum("no"), F.max("score")).collect())
    yes, no, last, before = 0, 0, None, []
    for number, y, n, top in sums:
        before.append((number, yes, no, last))
        yes, no, last = yes + y, no + n, top
    if not yes:
        return float("-inf")
    spark = scores.sparkSession
    own = Window.partitionBy("range").orderBy("score")
    earlier = lambda c: F.col(f"{c}_before") + F.coalesce(F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = each.join(F.broadcast(spark.createDataFrame(before, "range int, yes_before long, no_before long, last double")), "range")
    ranked = ranked.select("score", "yes", earlier("yes").alias("below"), earlier("no").alias("no_below"), F.coalesce(F.lag("score").over(own), "last").alias("previous"))
    place = int((1 - KEEP_TRUSTED) * yes) if no else 0
    most = ranked.where((F.col("below") <= place) & (F.col("below") + F.col("yes") > place)).first()["score"]
    if not no:
        return float(most)
    cut = F.coalesce((F.col("score") + F.col("previous")) / 2, F.col("score") - 1)
    cuts = ranked.select("score", cut.alias("cut"), "previous", (F.col("no_below") / F.lit(no) - F.col("below") / F.lit(yes)).alias("gain"))
    cuts = cuts.where((F.col("cut") <= F.lit(most)) & (F.col("previous").isNull() | (F.col("cut") > F.col("previous"))))
    return float(cuts.orderBy(F.desc("gain"), "score").first()["cut"])


def score(docs: DataFrame, verdict: Verdict, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """Adds the counts, base_failed, score and kept to each document, without a shuffle.

    Null and empty texts have no words, all counts 0, fail the base rule and are not kept.
    keep_columns: the documents' other columns stay too, but for those that are named like a result,
    which are replaced by it.
    """
    weights, threshold = verdict.weights, verdict.threshold
    source = docs if keep_columns else docs.select(id_col, text_col)
    kept_fields = source.schema.fields if keep_columns else [f for f in source.schema.fields if f.name == id_col]
    results = [*FEATURES.fields, T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    kept_fields = [f for f in kept_fields if f.name.lower() not in {r.name for r in results}]
    names = [f.name for f in kept_fields]
    out = T.StructType([*kept_fields, *results])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in passes(text_column(batch, text_col)):
                base = base_counts(t)
                failed = _base_failed(base)
                means = _means(t, weights)
                own = [column(batch, n).slice(t.first, t.n) for n in names]
                cols = [*own, *(pa.array(base[f.name], pa.int64()) for f in FEATURES.fields), pa.array(failed), pa.array(means), pa.array(~failed & (means >= threshold))]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in out.fields])

    return source.mapInArrow(run, out)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
