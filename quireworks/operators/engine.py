"""From a folder of documents to a folder of results in one call.

What can't be parsed is set apart with its reason, a document as a whole: a file that can't be read, a page that a
model has no answer for, a name that another input has. Documents that an earlier run finished, by name and
content, are left out before any model is asked. All that a run writes comes in one commit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pdf import opened
from ..functions.pictures import kind_of
from ..functions.scans import FAILED, as_pdf, orientation
from ..sources import files, pages, scans, sink
from . import inference, render

DONE, REJECTED = "done", "rejected"
#: Paths that are sent to every task at most; more are joined by a shuffle.
PATHS_SENT = 1 << 18

_NAME = r"([^/]+?)(\.[^./]*)?$"


def inputs(spark: SparkSession, source: str, **options: str) -> DataFrame:
    """(path, name, digest, error) of a folder's files; of files of one name the first path's counts."""
    rows = pages.register(spark).read.format(pages.PagesSource.name()).options(path=source, **options).option("content", "false").load()
    each = rows.groupBy("path").agg(F.max("digest").alias("digest"), F.max("error").alias("error")).withColumn("name", F.regexp_extract("path", _NAME, 1))
    first = each.groupBy("name").agg(F.min("path").alias("first"))
    twice = F.when(F.col("path") != F.col("first"), F.concat(F.lit("another input has this name: "), "first"))
    return each.join(first, "name").select("path", "name", "digest", F.coalesce("error", twice).alias("error"))


def open_work(found: DataFrame, known: DataFrame) -> DataFrame:
    """Inputs that no earlier run finished, by a manifest."""
    done = known.where(F.col("status") == DONE).select("name", "digest").distinct()
    return found.join(done, ["name", "digest"], "left_anti")


def of_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows whose path is among paths (checkpointed). Few paths are sent to the rows, so that contents stay where they are."""
    few = paths.limit(PATHS_SENT + 1).count() <= PATHS_SENT
    return rows.join(F.broadcast(paths) if few else paths, "path")


def layout_files(source: str, drawings: DataFrame) -> DataFrame:
    """(name, path, content): <name>/<name>_layout.pdf, the input with what is drawn on its pages, from (name, path, pages:
    array of (page, operators)). PNG and upright JPEG pictures become files of a page first; nothing for other
    pictures, nor for files that can't be updated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pages._open_fs(source)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"]) as f:
                    data = f.read()
                kind = kind_of(data)
                if kind == "jpeg" and orientation(data) != 1:  # its blocks are told from the picture as it is stored
                    continue
                try:
                    pdf, _ = opened(data if kind == "pdf" else as_pdf(data))
                    if pdf is None:
                        continue
                    data = pdf.with_drawings({p["page"]: p["operators"].encode() for p in row["pages"]})
                except FAILED:
                    continue
                name = row["name"]
                yield pa.RecordBatch.from_pydict({"name": [name], "path": [f"{name}/{name}_layout.pdf"], "content": pa.array([data], pa.binary())})

    return drawings.select("name", "path", "pages").mapInArrow(run, "name string, path string, content binary")


def parse_folder(
    spark: SparkSession, source: str, target: str, layout_model: str = "stub", content_model: str | None = None, skip: list[str] | None = None,
    lists: bool = True, paratext: bool = True, overlays: bool = True, dpi: int | None = None, **options: str,
) -> DataFrame:
    """Parses what lies in a folder and writes <name>/<name>.md, <name>/<name>_middle.json and <name>/<name>_layout.pdf
    below another one. Returns (name, digest, status, reason) of this run's documents;
    the sink's manifest keeps them all. dpi: scanned pages reach the models as pictures of so many dots an inch, other
    pages as files of a page, as all do without. options: those of the source of pages."""
    found = inference.kept(open_work(inputs(spark, source, **options), sink.manifest(spark, target)))
    work = found.where("error IS NULL").select("path", "name")
    rows = of_paths(pages.register(spark).read.format(pages.PagesSource.name()).options(path=source, **options).load(), work)
    rows = rows.where("error IS NULL")
    if dpi is not None:
        rows = scans.page_pictures(rows, dpi=dpi).withColumn("content", F.coalesce("picture", "content"))
    sheets = rows.select(
        "name", "path", "page", F.col("name").alias("doc_id"), F.col("page").alias("page_idx"), F.monotonically_increasing_id().alias("page_id"),
        F.col("content").alias("image"), F.round("width").cast("int").alias("width"), F.round("height").cast("int").alias("height"),
    )
    read = inference.read_pages(sheets, layout_model, content_model, skip)

    bad = read.where("error IS NOT NULL").groupBy("name").agg(F.min_by(F.concat(F.lit("page "), "page", F.lit(": "), "error"), "page").alias("reason"))
    told = found.where("error IS NULL").join(bad, "name", "left").select("path", "name", "digest", "reason")
    outcome = inference.kept(told.unionByName(found.where("error IS NOT NULL").select("path", "name", "digest", F.col("error").alias("reason"))))
    good = outcome.where("reason IS NULL").select("name", "digest")

    whole = read.join(good.select("name"), "name", "left_semi")
    blocks = inference.kept(inference.blocks_of_pages(whole, lists, paratext))
    made = inference.assembled(whole, blocks).withColumnRenamed("doc_id", "name")
    empty = F.lit('{"pdf_info":[],"_backend":"vlm","_version_name":"1.0.0"}')
    made = good.join(made, "name", "left").select("name", F.coalesce("document", empty).alias("document"), F.coalesce("markdown", F.lit("")).alias("markdown"))
    out = files.document_files(made)
    if overlays:
        drawn = render.overlay_operators(blocks).join(whole.select("page_id", "name", "path", "page"), "page_id")
        out = out.unionByName(layout_files(source, drawn.groupBy("name", "path").agg(F.collect_list(F.struct("page", "operators")).alias("pages"))))
    done = out.join(good, "name").withColumn("status", F.lit(DONE))
    rejected = outcome.where("reason IS NOT NULL").select("name", "digest", "reason", F.lit(REJECTED).alias("status"))
    sink.write(done.unionByName(rejected, allowMissingColumns=True), target)
    return outcome.select("name", "digest", F.when(F.col("reason").isNull(), DONE).otherwise(REJECTED).alias("status"), "reason")
