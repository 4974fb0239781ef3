"""Pages of documents in folders as a data source, batch and stream.

    register(spark)
    spark.read.format("quireworks_pages").option("path", folder).load()

A row for each page of PDF files (content: a file of that page alone) and for each picture (content: its bytes), and one
with `error` for each file that can't be read. Files go to partitions by their bytes. Filters on kind
and page reach the source: of files of other kinds only the first
bytes are read, and other pages aren't cut out.

Options: path; recursive (default true); suffixes, comma-separated (others aren't opened; default those of the types
that are read); partitionBytes (default 64 MB); content (default true; false leaves it null and only counts pages
and sizes).
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..functions.batches import PART_BYTES, parts
from ..functions.pdf import BROKEN, opened
from ..functions.pictures import kind_of, size_of

# Suffixes of the types that are read.
SUFFIXES = ["pdf", "png", "jpg", "jpeg", "jp2", "gif", "bmp", "webp", "tif", "tiff"]
SCHEMA = "path string, kind string, digest string, page int, pages int, width double, height double, content binary, error string"
_ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("digest", pa.string()), ("page", pa.int32()), ("pages", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("content", pa.binary()), ("error", pa.string())])
#: First bytes of a file that tell its type.
HEAD = 64
#: Bytes of content in a batch of rows, about.
BATCH_BYTES = 16 << 20


@dataclass
class Files(InputPartition):
    """Paths with sizes."""

    paths: list[tuple[str, int]]


@dataclass
class Wanted:
    """What filters leave: kinds (None: all) and pages from a first to a last one."""

    kinds: set[str] | None = None
    first: int = 0
    last: float = float("inf")
    pages: set[int] | None = None

    def narrow(self, f: Filter) -> bool:
        """Takes a filter over, if it is one of those that the source can keep by itself."""
        attribute, value = getattr(f, "attribute", None), getattr(f, "value", None)
        if attribute == ("kind",) and isinstance(f, EqualTo | In):
            kinds = {value} if isinstance(f, EqualTo) else {*value}
            self.kinds = kinds if self.kinds is None else self.kinds & kinds
        elif attribute == ("page",) and isinstance(f, EqualTo | In):
            pages = {value} if isinstance(f, EqualTo) else {*value}
            self.pages = pages if self.pages is None else self.pages & pages
        elif attribute == ("page",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
            self.first = max(self.first, value + isinstance(f, GreaterThan))
        elif attribute == ("page",) and isinstance(f, LessThan | LessThanOrEqual):
            self.last = min(self.last, value - isinstance(f, LessThan))
        else:
            return False
        return True

    def of(self, n: int) -> list[int]:
        return [i for i in range(self.first, int(min(n - 1, self.last)) + 1) if self.pages is None or i in self.pages]

    @property
    def all_pages(self) -> bool:
        return self.first == 0 and self.last == float("inf") and self.pages is None


def _open_fs(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + folder[5:] if folder.startswith("file:") and "://" not in folder else folder)
    return fs.LocalFileSystem(), folder


@dataclass
class _Scan:
    folder: str
    recursive: bool = True
    suffixes: list[str] = field(default_factory=lambda: list(SUFFIXES))
    partition_bytes: int = 64 << 20
    content: bool = True

    def files(self, since: int = -1, until: float = float("inf")) -> list[fs.FileInfo]:
        """Files by path, of those changed after `since` and not after `until` (nanoseconds); hidden ones and results are left out."""
        files, top = _open_fs(self.folder)
        one = files.get_file_info(top)
        found = [one] if one.type == fs.FileType.File else files.get_file_info(fs.FileSelector(top, recursive=self.recursive))
        kept = [f for f in found if f.type == fs.FileType.File and f.extension.lower() in self.suffixes and not any(p.startswith((".", "_")) for p in f.path[len(top) :].split("/"))]
        return sorted((f for f in kept if since < (f.mtime_ns or 0) <= until), key=lambda f: f.path)

    def partitions(self, found: Iterable[fs.FileInfo]) -> list[Files]:
        """Files in partitions of about so many bytes, the largest first each into the one with least."""
        found = sorted(found, key=lambda f: (-f.size, f.path))
        n = max(1, min(len(found), -(-sum(f.size for f in found) // self.partition_bytes)))
        heap = [(0, k) for k in range(n)]
        out: list[list[tuple[str, int]]] = [[] for _ in range(n)]
        for f in found:
            size, k = heapq.heappop(heap)
            out[k].append((f.path, f.size))
            heapq.heappush(heap, (size + f.size, k))
        return [Files(x) for x in out if x]

    def rows(self, part: Files | None, wanted: Wanted) -> Iterator[pa.RecordBatch]:
        if part is None:  # without any partition Spark reads one that isn't there
            return
        files, _ = _open_fs(self.folder)
        held: list[tuple] = []
        size = 0
        for path, _ in part.paths:
            for row in self.rows_of(files, path, wanted):
                held.append(row)
                size += len(row[7] or b"")
                if size > BATCH_BYTES:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)

    def rows_of(self, files: fs.FileSystem, path: str, wanted: Wanted) -> Iterator[tuple]:
        try:
            with files.open_input_file(path) as f:
                head = f.read(HEAD)
                kind = kind_of(head)
                if wanted.kinds is not None and kind not in wanted.kinds:
                    return
                data = head + f.read()
        except OSError as e:
            if wanted.kinds is None and wanted.all_pages:
                yield path, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"
            return
        yield from rows_of_data(path, data, wanted, self.content)


def rows_of_data(path: str, data: bytes, wanted: Wanted, content: bool = True) -> Iterator[tuple]:
    """Rows of the source for a file's bytes."""
    kind, digest = kind_of(data), hashlib.sha256(data).hexdigest()
    broken = lambda why: (path, kind, digest, None, None, None, None, None, why)
    if kind == "pdf":
        pdf, why = opened(data)
        if pdf is None:
            if wanted.all_pages:  # an error has no page, so a filter on pages leaves it out
                yield broken(why)
            return
        made = []
        try:
            for i in wanted.of(len(pdf)):
                made.append((path, kind, digest, i, len(pdf), *pdf.size(i), pdf.subset([i]) if content else None, None))
        except BROKEN as e:
            made = [broken(str(e))] if wanted.all_pages else []
        yield from made
    elif wanted.of(1) or wanted.all_pages:
        size = size_of(data)
        if size and min(size) > 0:
            yield path, kind, digest, 0, 1, float(size[0]), float(size[1]), data if content else None, None
        elif wanted.all_pages:
            yield broken("no picture whose size is known" if kind else "of no known type")


def pages_of(files: DataFrame, path: str = "path", content: str = "content", cut: bool = True) -> DataFrame:
    """The source's rows for files in a table (path, content): a row for each page, or one with an error. cut: pages come
    as files of their own, else content is null. A null content is of no known type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                for row in rows_of_data(name.as_py(), data.as_py() or b"", Wanted(), cut):
                    held.append(row)
                    size += len(row[7] or b"")
                    if len(held) == 256 or size > PART_BYTES:
                        yield _batch(held)
                        held, size = [], 0
            if held:
                yield _batch(held)

    return files.select(F.col(path).cast("string"), content).mapInArrow(run, SCHEMA)


def subsets_of(files: DataFrame, pages: str = "page_ids", content: str = "content") -> DataFrame:
    """Files with `content` cut down to the pages that a column lists, in that order, and `error`, why that can't be done;
    numbers outside of a file are left out, an empty or null list keeps the file as it is."""
    out = T.StructType([*(f for f in files.schema if f.name != "error"), T.StructField("error", T.StringType())])
    names = out.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in parts(batch, content)):
            at = batch.schema.get_field_index
            data, errors = [], []
            for x, ids in zip(batch.column(at(content)).to_pylist(), batch.column(at(pages)).to_pylist(), strict=True):
                why = None
                if ids:
                    pdf, why = opened(x)
                    try:
                        x = pdf.subset([i for i in ids if i is not None and 0 <= i < len(pdf)]) if pdf else None
                    except BROKEN as e:
                        x, why = None, str(e)
                data.append(x)
                errors.append(why)
            cols = [pa.array(data, pa.binary()) if n == content else batch.column(at(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(errors, pa.string())], names=out.names)

    return files.select(*names).mapInArrow(run, out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class PagesReader(DataSourceReader):
    def __init__(self, scan: _Scan) -> None:
        self.scan, self.wanted = scan, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        left = [f for f in filters if not self.wanted.narrow(f)]
        # that a value is there follows from what the filters taken over ask for
        there = [("kind",)] * (self.wanted.kinds is not None) + [("page",)] * (not self.wanted.all_pages)
        return [f for f in left if not (isinstance(f, IsNotNull) and f.attribute in there)]

    def partitions(self) -> list[Files]:
        return self.scan.partitions(self.scan.files())

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.scan.rows(partition, self.wanted)


class PagesStreamReader(DataSourceStreamReader):
    """New files by the time they were changed; one that is changed again comes again."""

    def __init__(self, scan: _Scan) -> None:
        self.scan = scan

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"changed": max((f.mtime_ns or 0 for f in self.scan.files()), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.scan.partitions(self.scan.files(start["changed"], end["changed"]))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.scan.rows(partition, Wanted())

    def commit(self, end: dict) -> None:
        pass


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quireworks_pages"

    def schema(self) -> str:
        return SCHEMA

    def _scan(self) -> _Scan:
        o = self.options
        yes = lambda key: str(o.get(key, "true")).lower() == "true"
        suffixes = [s.strip().lower().lstrip(".") for s in o["suffixes"].split(",")] if "suffixes" in o else list(SUFFIXES)
        return _Scan(o["path"], yes("recursive"), suffixes, int(o.get("partitionBytes", 64 << 20)), yes("content"))

    def reader(self, schema: object) -> PagesReader:
        return PagesReader(self._scan())

    def streamReader(self, schema: object) -> PagesStreamReader:  # noqa: N802
        return PagesStreamReader(self._scan())


def register(spark: SparkSession) -> SparkSession:
    """Makes the source known to a session, and lets filters reach sources of its kind."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagesSource)
    return spark
