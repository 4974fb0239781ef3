"""Repeated runs in arrays of tokens: where one would come again, and which tokens would make it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all windows of `size` tokens, each made of those of two windows half as long that
    overlap: as many steps as `size` has binary digits, whatever the size."""
    h, length = _mixed(tokens.astype(np.int64).view(_U) + _U(0x9E3779B97F4A7C15)), 1
    while length < size:
        step = min(length, size - length)
        with np.errstate(over="ignore"):
            h = _mixed(h[: len(h) - step] * _U(0x9E3779B97F4A7C15) + h[step:] + _U(step))
        length += step
    return h


def first_repeat(tokens: np.ndarray, size: int) -> tuple[int, int] | None:
    """(start, earlier): the first window of `size` tokens that is equal to an earlier one, and the first that it is
    equal to. Hashes find the windows, tokens are compared."""
    if size < 1 or len(tokens) <= size:
        return None
    h = window_hashes(tokens, size)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    for start in np.sort(order[1:][same]).tolist():  # the first of these is right but for equal hashes of unequal windows
        for earlier in np.flatnonzero(h[:start] == h[start]).tolist():
            if np.array_equal(tokens[earlier : earlier + size], tokens[start : start + size]):
                return start, earlier
    return None


def completing(tokens: np.ndarray, size: int) -> np.ndarray:
    """The distinct tokens that would make a window of `size` tokens come again behind these."""
    n, head = len(tokens), size - 1
    if size < 1 or n < size:
        return tokens[:0]
    if not head:
        return np.unique(tokens)
    h = window_hashes(tokens, head)
    starts = np.flatnonzero(h[:-1] == h[-1])
    good = [s for s in starts.tolist() if np.array_equal(tokens[s : s + head], tokens[n - head :])]
    return np.unique(tokens[np.array(good, np.int64) + head]) if good else tokens[:0]


def _by_row(df: DataFrame, tokens: str, fields: list[T.StructField], f: Callable[[np.ndarray | None], list]) -> DataFrame:
    names = [c for c in df.columns if c != tokens and c not in {x.name for x in fields}]
    out = T.StructType([*(df.schema[n] for n in names), *fields])
    kind = df.schema[tokens].dataType.elementType

    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"tokens are whole numbers, not {kind.simpleString()}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            lists = batch.column(at(tokens))
            rows = [f(x.values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64) if x.is_valid else np.zeros(0, np.int64)) for x in lists]
            types = [pa.list_(pa.int64()) if isinstance(x.dataType, T.ArrayType) else pa.int64() for x in fields]
            new = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*(batch.column(at(n)) for n in names), *new], names=out.names)

    return df.select(*names, tokens).mapInArrow(run, out)


def first_repeats(df: DataFrame, tokens: str, size: int = 100) -> DataFrame:
    """The other columns with (start, earlier) of each row's first repeated window, from 0, null without one. A generator
    that may not repeat windows of this size would have been stopped before the token at start + size - 1. Null
    tokens are left out, null lists are empty."""
    fields = [T.StructField(n, T.LongType()) for n in ("start", "earlier")]
    return _by_row(df, tokens, fields, lambda t: list(first_repeat(t, size) or (None, None)))


def banned_tokens(df: DataFrame, tokens: str, size: int = 100) -> DataFrame:
    """The other columns with `banned`: the tokens, in order, that may not come next if no window of `size` tokens
    may come twice."""
    return _by_row(df, tokens, [T.StructField("banned", T.ArrayType(T.LongType()))], lambda t: [completing(t, size).tolist()])
