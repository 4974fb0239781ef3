"""Places that the driver and every executor can reach, and files written there from tasks."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local temporary one only where that is unset (tests, local mode)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
        root = "file://" + os.path.join(tempfile.gettempdir(), "quireworks-shared")
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder no other run uses."""
    return f"{shared_root(spark)}/quireworks/{name}-{uuid.uuid4().hex}"


#: Rows that a Python worker gets at once while a table is stored: rows can hold whole sets or texts.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Garbage is collected between stored tables, but not more often than this.
GARBAGE_SECONDS = 1.5
_collected = 0.0


#: Environment of Python workers, which live through all stages of a query: arrays of a megabyte and more are given
#: back to the system when they are freed, and of what smaller ones took 16 megabytes at most are kept for those to come,
#: as memory that comes anew each time costs as much CPU as the work on it.
WORKERS = {"MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 24), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again, which cuts its lineage:
    a lost executor costs a reread, never the work before."""
    spark = df.sparkSession
    # Spark drops the shuffle files of what nothing refers to any more when it collects garbage;
    # without this they would stay until a driver with little to do gets round to it.
    global _collected
    if time.monotonic() - _collected > GARBAGE_SECONDS:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()
    path = new_folder(spark, name)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of longs sent to every task at most (8 to 24 bytes each); more are joined by a shuffle.
IDS_SENT = 1 << 20


def among(df: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose `col` is in the one column of ids (stored, distinct). Sends the ids to
    the rows as long as their counted number is small, so that texts stay where they are."""
    ids = ids.toDF(col)
    few = ids.limit(IDS_SENT + 1).count() <= IDS_SENT
    return df.join(F.broadcast(ids) if few else ids, col, "left_semi")


def without(df: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of df that have no equal in rows (stored, a few longs each), which are sent likewise."""
    few = rows.limit(IDS_SENT + 1).count() <= IDS_SENT
    return df.join(F.broadcast(rows) if few else rows, rows.columns, "left_anti")


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder's address, for use inside tasks."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri[5:]
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def write_file(folder: str, name: str, chunks: Iterator[bytes]) -> int:
    """Writes one file under a name of its own and then moves it into place, so that a task that is
    run twice leaves one whole file. Returns the bytes written."""
    files, path = open_fs(folder)
    files.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    size = 0
    with files.open_output_stream(own, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    files.move(own, f"{path}/{name}")
    return size


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column with nulls as empty strings."""
    return column(batch, name).cast(pa.large_string()).fill_null("")
