"""Files by name as a data sink with a two-phase commit.

    register(spark)
    rows.write.format("quireworks_files").mode("append").option("path", folder).save()

Rows are (name, digest, status, reason, path, content): a file of a document (path below the folder, content as bytes), or
with a null path only what became of the document. Tasks write below `_staging/<job>/<attempt>`, each attempt in
a folder of its own. When all tasks are through, the files that their messages name are moved to their places, and the
manifest of the job is put beside them last: what is in a manifest is whole. A job that fails leaves nothing, a
task that runs twice leaves its files once, and of files of one name the last of the partition with the
highest number stays.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .pages import _open_fs

ROWS = "name string, digest string, status string, reason string, path string, content binary"
MANIFEST = "name string, digest string, status string, reason string, files array<struct<path string, bytes long>>"
#: Files that are moved at once.
MOVERS = 16
#: How often an abort looks for what tasks leave, 0.3 seconds apart.
ABORT_LOOKS = 40


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: files (staged, place), and what became of which document."""

    partition: int
    files: list[tuple[str, str]] = field(default_factory=list)
    documents: list[dict] = field(default_factory=list)


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.job = uuid.uuid4().hex

    def _staging(self, top: str) -> str:
        return f"{top}/_staging/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, top = _open_fs(self.folder)
        own = f"{self._staging(top)}/{uuid.uuid4().hex}"
        out, documents, made = Written(TaskContext.get().partitionId()), {}, set()
        for batch in iterator:
            for row in batch.to_pylist():
                key = row["name"], row["digest"]
                entry = documents.setdefault(key, {"name": row["name"], "digest": row["digest"], "status": row["status"], "reason": row["reason"], "files": []})
                if row["path"] is None:
                    continue
                place = _below(row["path"])
                staged = f"{own}/{place}"
                parent = staged.rpartition("/")[0]
                if parent not in made:
                    files.create_dir(parent, recursive=True)
                    made.add(parent)
                data = row["content"] or b""
                with files.open_output_stream(staged, compression=None) as f:
                    f.write(data)
                out.files.append((staged, place))
                entry["files"].append({"path": place, "bytes": len(data)})
        out.documents = list(documents.values())
        return out

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, top = _open_fs(self.folder)
        written = sorted((m for m in messages if m), key=lambda m: m.partition)
        last = {place: staged for m in written for staged, place in m.files}
        for parent in {f"{top}/{p}".rpartition("/")[0] for p in last}:
            files.create_dir(parent, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda x: _moved(files, x[1], f"{top}/{x[0]}"), last.items()))
        documents: dict[tuple, dict] = {}
        for d in (d for m in written for d in m.documents):
            seen = documents.setdefault((d["name"], d["digest"]), d)
            if seen is not d:
                seen["files"] = [*seen["files"], *d["files"]]
        if documents:
            files.create_dir(f"{top}/_manifest", recursive=True)
            own = f"{self._staging(top)}/manifest"
            files.create_dir(self._staging(top), recursive=True)
            with files.open_output_stream(own, compression=None) as f:
                f.write("".join(json.dumps(d, ensure_ascii=False) + "\n" for d in documents.values()).encode())
            files.move(own, f"{top}/_manifest/{self.job}.json")
        self._cleared(files, top)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Tasks of the job that are still being stopped may write on for a moment, so this looks again until
        nothing more has come."""
        files, top = _open_fs(self.folder)
        quiet = 0
        for _ in range(ABORT_LOOKS):
            there = files.get_file_info(self._staging(top)).type == fs.FileType.Directory
            quiet = 0 if there else quiet + 1
            if quiet > 3:
                break
            with contextlib.suppress(OSError):  # a task may add to a folder while it is removed
                self._cleared(files, top)
            time.sleep(0.3)

    def _cleared(self, files: fs.FileSystem, top: str) -> None:
        staging = self._staging(top)
        if files.get_file_info(staging).type == fs.FileType.Directory:
            files.delete_dir(staging)
        above = f"{top}/_staging"
        if files.get_file_info(above).type == fs.FileType.Directory and not files.get_file_info(fs.FileSelector(above)):
            files.delete_dir(above)


def _below(path: str) -> str:
    """A path that can't leave the folder."""
    parts = path.split("/")
    if not path or any(p in ("", ".", "..") for p in parts) or parts[0] in ("_staging", "_manifest"):
        raise ValueError(f"no path below a folder: {path!r}")
    return path


def _moved(files: fs.FileSystem, staged: str, place: str) -> None:
    if files.get_file_info(place).type == fs.FileType.File:
        files.delete_file(place)  # not every store replaces a file by moving another one upon it
    files.move(staged, place)


class FilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quireworks_files"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema: object, overwrite: bool) -> FilesWriter:
        if overwrite:
            raise ValueError("files are added or replaced one by one: use append")
        return FilesWriter(self.options["path"])


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(FilesSink)
    return spark


def write(rows: DataFrame, folder: str) -> None:
    """Writes rows of the sink's form; columns that are missing are null."""
    register(rows.sparkSession)
    known = [f"CAST({c} AS {k}) AS {c}" if c in rows.columns else f"CAST(NULL AS {k}) AS {c}" for c, k in (x.split(" ") for x in ROWS.split(", "))]
    rows.selectExpr(*known).write.format(FilesSink.name()).mode("append").option("path", folder).save()


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(name, digest, status, reason, files) of all that was committed below a folder, of every job."""
    files, top = _open_fs(folder)
    if files.get_file_info(f"{top}/_manifest").type != fs.FileType.Directory:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{folder.rstrip('/')}/_manifest")
