"""Rows that Python gets at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of contents in a part of a batch, about.
PART_BYTES = 4 << 20


def parts(batch: pa.RecordBatch, content: str | int) -> Iterator[pa.RecordBatch]:
    """A batch's rows in order, in parts of about PART_BYTES of a column of bytes or text, a row at least."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(content)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size, dtype=np.int64) - size) // PART_BYTES
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for lo, hi in zip(cuts, np.append(cuts[1:], batch.num_rows), strict=True):
        yield batch.slice(int(lo), int(hi - lo))
