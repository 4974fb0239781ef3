"""Tables in OTSL, a stream of cell marks with text between, to HTML and to cells."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marks. nl ends a row, fcel and ecel begin a cell, lcel, ucel and xcel belong to
# the cell on the left, above, or both.
MARKS = ["nl", "fcel", "ecel", "lcel", "ucel", "xcel"]
_MARK = re.compile("(" + "|".join(f"<{m}>" for m in MARKS) + ")")


def grid(otsl: str) -> tuple[list[list[str]], list[list[str]]]:
    """Marks and texts by row and column, short rows filled up with empty cells.

    Texts go to cells as long as the stream and the grid agree mark by mark. Once they don't
    (text before the first mark or behind a row's end, an empty row), no later cell gets any.
    """
    parts = [p for p in _MARK.split(otsl) if p.strip()]
    rows: list[list[str]] = [[]]
    for p in parts:
        if p == "<nl>":
            rows.append([])
        elif _MARK.fullmatch(p):
            rows[-1].append(p[1:-1])
    rows = [r for r in rows if r]
    width = max(map(len, rows), default=0)
    rows = [r + ["ecel"] * (width - len(r)) for r in rows]
    texts = [[""] * width for _ in rows]
    at = 0
    for r, row in enumerate(rows):
        for c, mark in enumerate(row):
            if at < len(parts) and parts[at] == f"<{mark}>":
                at += 1
                if at < len(parts) and not _MARK.fullmatch(parts[at]):
                    texts[r][c] = parts[at]
                    at += 1
        if at < len(parts) and parts[at] == "<nl>":
            at += 1
    return rows, texts


def _run(marks: list[str], member: tuple[str, str]) -> int:
    n = 0
    while n < len(marks) and marks[n] in member:
        n += 1
    return n


def to_html(otsl: str) -> str:
    """HTML of a table; what is a table in HTML already stays. Without cells: empty."""
    if otsl.startswith("<table") and otsl.endswith("</table>"):
        return otsl
    rows, texts = grid(otsl)
    if not rows:
        return ""
    out = []
    for r, row in enumerate(rows):
        line = ""
        for c, mark in enumerate(row):
            if mark not in ("fcel", "ecel"):
                continue
            wide = 1 + _run(row[c + 1 :], ("lcel", "xcel"))
            high = 1 + _run([x[c] for x in rows[r + 1 :]], ("ucel", "xcel"))
            spans = (f' rowspan="{high}"' if high > 1 else "") + (f' colspan="{wide}"' if wide > 1 else "")
            line += f"<td{spans}>{html.escape(texts[r][c].strip())}</td>"
        out.append(f"<tr>{line}</tr>")
    return "<table>" + "".join(out) + "</table>"


def plain_table(c: Column) -> Column:
    """HTML without document tags, and with a border."""
    return F.replace(F.regexp_replace(c, "</?(html|body|thead)>", ""), F.lit("<table>"), F.lit('<table border="1">'))


def otsl_html(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else to_html(x))

    return plain_table(run(c))


_TOKEN = re.compile("<(nl|[feluxc]cel)>([^<]*)")
_CELL = pa.schema([("row", pa.int32()), ("col", pa.int32()), ("text", pa.string()), ("row_span", pa.int32()), ("col_span", pa.int32())])
#: Cells that leave a task at once, about.
CELLS = 10_000


def cells(otsl: str) -> list[tuple[int, int, str, int, int]]:
    """(row, col, text, row_span, col_span) of a table's cells."""
    rows: list[list[tuple[str, str]]] = [[]]
    for mark, text in _TOKEN.findall(otsl):
        if mark == "nl":
            rows.append([])
        else:
            rows[-1].append((mark, text))
    out, high = [], {}
    for r in range(len(rows) - 1, -1, -1):  # from below, with the marks of each column that continue a cell above
        wide = 0
        for c in range(len(rows[r]) - 1, -1, -1):
            mark, text = rows[r][c]
            if mark in ("fcel", "ecel"):
                out.append((r, c, text.strip(" "), 1 + high.get(c, 0), 1 + wide))
            wide = wide + 1 if mark in ("lcel", "xcel") else 0
            high[c] = high.get(c, 0) + 1 if mark in ("ucel", "xcel") else 0
    return out[::-1]


def otsl_cells(df: DataFrame, key: str, otsl: str) -> DataFrame:
    """(key, row, col, text, row_span, col_span) of each cell; a table is cut up in its own row, whatever its key. For
    streams whose rows all have text behind a cell's mark and no text elsewhere."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables, rows = [], []
            for i, stream in enumerate(batch.column(1).to_pylist()):
                found = cells(stream or "")
                tables += [i] * len(found)
                rows += found
                if len(rows) > CELLS or i == batch.num_rows - 1:
                    if rows:
                        each = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CELL.types, strict=True)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(tables)), *each], names=[key, *_CELL.names])
                    tables, rows = [], []

    return df.select(key, otsl).mapInArrow(run, T.StructType([df.schema[key], *(T.StructField(n, T.StringType() if n == "text" else T.IntegerType()) for n in _CELL.names)]))


def cell_text(text: Column, token: Column, parts: Column) -> Column:
    """A cell's text; where it has none, its box's token, else its parts' tokens."""
    return F.coalesce(text, F.when(F.coalesce(token, F.lit("")) != "", token), F.trim(F.array_join(parts, " ")), F.lit(""))
