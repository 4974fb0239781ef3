"""Work on whole pages in Python, many pages a batch, for what depends on order step by step."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def on_pages(df: DataFrame, work: Callable[[list[dict]], list[tuple]], schema: str, order: list[str]) -> DataFrame:
    """Rows that `work` gives for each page's rows, which come in the given order. Pages are dealt by
    their key; one page's rows are held at a time, and none becomes a frame of its own."""
    out = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        rows = itertools.chain.from_iterable(b.to_pylist() for b in batches)
        made: list[tuple] = []
        for _, page in itertools.groupby(rows, key=lambda r: r["page_id"]):
            made += work(list(page))
            if len(made) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), target, strict=True)], schema=target)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), target, strict=True)], schema=target)

    return df.repartition("page_id").sortWithinPartitions("page_id", *order).mapInArrow(run, out)
