"""Languages of texts by the frequencies of short runs of bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs of one to so many bytes, counted by hashes in so many buckets.
LONGEST, BUCKETS = 4, 1 << 15
#: Labelled texts of a language that a model is fitted on, about; those with the smallest hashes of their ids.
SAMPLE = 2_000
#: Languages that a model can tell apart; the most frequent ones count.
MOST_LANGUAGES = 256
#: Bytes of text handled at once.
PASS_BYTES = 1 << 18

# Languages that are written without spaces, or nearly so.
DENSE = ["zh", "ja", "ko"]

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Model:
    """Languages, and the logarithm of each bucket's share in them (bucket by language)."""

    languages: list[str]
    weights: np.ndarray


def _passes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, where each text begins, with the end) of a large_string array without nulls. A long text
    makes a pass of its own."""
    n = len(texts)
    _, offsets, data = texts.buffers()
    if not n:
        return
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PASS_BYTES, "right")) - 1)
        yield lo, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def _buckets(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, text of each) of all runs of each size inside of one text."""
    low = _LOWER[raw]
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    code = np.zeros(len(low), np.uint32)
    for size in range(1, LONGEST + 1):
        n = len(low) - size + 1
        if n <= 0:
            return
        code = (code[:n] << np.uint32(8)) | low[size - 1 :]
        with np.errstate(over="ignore"):
            h = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(size) * np.uint32(0x9E3779B1)
            h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
        inside = text[:n] == text[size - 1 :]
        yield ((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS))[inside].astype(np.int64), text[:n][inside]


def _texts(batch: pa.RecordBatch, i: int) -> pa.Array:
    return batch.column(i).cast(pa.large_string()).fill_null("")


def sample(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", size: int = SAMPLE) -> DataFrame:
    """About `size` rows of each language, the same ones each time. Rows without a language aren't taken."""
    counts = docs.where(F.col(lang_col).isNotNull()).groupBy(lang_col).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), lang_col).limit(MOST_LANGUAGES)
    share = F.least(F.lit(1.0), F.lit(float(size)) / F.col("_n")) * (1 << 20)
    return docs.join(F.broadcast(counts), lang_col).where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < share).drop("_n")


def fit(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", size: int = SAMPLE) -> Model:
    """A model of labelled texts (id, lang, text), counted by tasks on whole texts. The driver gets at most MOST_LANGUAGES times
    BUCKETS counts. Without a labelled text it knows no language."""
    labelled = sample(docs, id_col, lang_col, size).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, raw, at in _passes(_texts(batch, 1)):
                own = {x: i for i, x in enumerate(dict.fromkeys(langs[first : first + len(at) - 1]))}
                lang = np.array([own[x] for x in langs[first : first + len(at) - 1]], np.int64)
                found = np.zeros(len(own) * BUCKETS, np.int64)
                for bucket, text in _buckets(raw, at):
                    found += np.bincount(lang[text] * BUCKETS + bucket, minlength=len(found))
                for x, i in own.items():
                    sums[x] = sums.get(x, 0) + found[i * BUCKETS : (i + 1) * BUCKETS]
        for x, n in sums.items():
            b = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(b), pa.string()), pa.array(b.astype(np.int32)), pa.array(n[b])], names=["lang", "bucket", "n"])

    rows = labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS, len(languages)))
    if languages:
        own = {x: i for i, x in enumerate(languages)}
        lang = np.array([own[x] for x in rows.column("lang").to_pylist()])
        counts[rows.column("bucket").to_numpy(), lang] = rows.column("n").to_numpy()
    return Model(languages, np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS)).astype(np.float32))


def detect(docs: DataFrame, model: Model, text_col: str = "text", output: str = "detected") -> DataFrame:
    """Documents with the language under which their runs of bytes are most likely, of equals the first by name; null
    for null and empty texts, and if the model knows none. No shuffle."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # MOST_LANGUAGES * BUCKETS * 4 bytes at most
    fields = [f for f in docs.schema if f.name != output]
    names = [f.name for f in fields]
    out = T.StructType([*fields, T.StructField(output, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, languages = sent.value.weights, sent.value.languages
        for batch in batches:
            texts = _texts(batch, batch.schema.get_field_index(text_col))
            best: list[str | None] = []
            for _, raw, at in _passes(texts):
                score = np.zeros((len(at) - 1, len(languages)))
                for bucket, text in _buckets(raw, at):
                    for i in range(len(languages)):
                        score[:, i] += np.bincount(text, weights[bucket, i], minlength=len(score))
                top = score.argmax(1) if languages else np.zeros(len(score), np.int64)
                best += [languages[i] if n and languages else None for i, n in zip(top.tolist(), np.diff(at).tolist(), strict=True)]
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(best, pa.string())], names=out.names)

    return docs.mapInArrow(run, out)
