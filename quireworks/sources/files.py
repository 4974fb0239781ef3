"""Documents and pictures from folders, and results to files.

Files by name are written at once and in one commit (see sink), not whenever somebody looks at a result.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import image_format
from . import sink

# Suffixes of results that lie among inputs, and types that are read.
SKIPPED = ["json", "html"]
READABLE = ["pdf", "png", "jpeg", "gif", "bmp", "webp", "tiff"]


def scan(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """(path, content, kind): files of a folder by their first bytes; results among them are left out."""
    reader = (spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read).format("binaryFile")
    files = reader.load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when((suffix == "pdf") & F.substring("content", 1, 4).eqNullSafe(F.lit(b"%PDF")), F.lit("pdf")).otherwise(image_format(F.col("content")))
    return files.where(~suffix.isin(SKIPPED)).select("path", "content", kind.alias("kind"))


def readable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of known types, and the rest for a report."""
    known = F.coalesce(F.col("kind").isin(READABLE), F.lit(False))
    return files.where(known), files.where(~known).select("path", "kind")


def read_at(files: DataFrame, offset: int, size: int = -1) -> DataFrame:
    part = F.expr(f"substring(content, {offset + 1}, {size if size >= 0 else 2**31 - 1 - offset})")
    return files.withColumn("content", part)


def suffix_of(path: Column, content: Column) -> Column:
    """A file's type: by its first bytes, else by its name."""
    named = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    kind = image_format(content)
    return F.when((named == "pdf") & kind.isNotNull() & (kind != "pdf"), kind).otherwise(F.coalesce(kind, F.when(named != "", named)))


def inline_content(uri: Column) -> Column:
    """Bytes of a data URI or of plain base64; null where the text is the address of a file."""
    address = uri.rlike(r"(?i)^(https?|file)://") | uri.rlike(r"(?i)\.(png|jpe?g|webp|gif|pdf)$")
    text = F.when(uri.rlike("^data:[^;,]+;base64,"), F.element_at(F.split(uri, ","), 2)).otherwise(uri)
    return F.when(~address, F.try_to_binary(text, F.lit("base64")))


def load(requests: DataFrame, files: DataFrame, uri: str = "uri") -> DataFrame:
    """Requests with `content`: from the text itself, or from the file (path, content) that it names. Web
    addresses aren't fetched, and what isn't found has no content."""
    bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
    known = files.select(bare(F.col("path")).alias("_path"), F.col("content").alias("_content"))
    joined = requests.join(known, bare(F.col(uri)) == F.col("_path"), "left")
    return joined.withColumn("content", F.coalesce(inline_content(F.col(uri)), "_content")).drop("_path", "_content")


def write_named(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes files below the folder, one a row, in one commit (see sink); content is text or bytes. Returns
    (name, bytes) of what was written. Of rows with the same name any one stays, so take last_pictures
    first where that matters."""
    job = uuid.uuid4().hex
    data = F.col(content) if dict(rows.dtypes)[content] == "binary" else F.encode(content, "UTF-8")
    sink.write(rows.select(F.lit(job).alias("name"), F.col(name).alias("path"), data.alias("content")), folder)
    each = sink.manifest(rows.sparkSession, folder).where(F.col("name") == job).select(F.inline("files"))
    return each.select(F.col("path").alias("name"), "bytes")


def last_pictures(pictures: DataFrame, order: str, key: str = "path") -> DataFrame:
    """The last picture of each path."""
    rest = [c for c in pictures.columns if c != key]
    return pictures.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("p")).select(key, *(F.col(f"p.{c}").alias(c) for c in rest))


def document_files(documents: DataFrame, name: str = "name") -> DataFrame:
    """(name, path, content) of each document's files: <name>/<name>.md and <name>/<name>_middle.json from
    the columns markdown and document (as JSON with four spaces, letters as they are); a null one gives no file."""
    kinds = ((F.col("markdown"), ".md"), (indented(F.col("document")), "_middle.json"))
    parts = F.array(*(F.struct(F.concat(name, F.lit("/"), name, F.lit(end)).alias("path"), F.encode(c, "UTF-8").alias("content")) for c, end in kinds))
    return documents.select(F.col(name).alias("name"), F.inline(F.filter(parts, lambda x: x["content"].isNotNull())))


def write_documents(documents: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """Writes each document's files in one commit; (name, bytes) of them."""
    each = document_files(documents, name)
    return write_named(each.select("path", "content"), folder, "path", "content")


def _indented(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else json.dumps(json.loads(t), ensure_ascii=False, indent=4))


def indented(text: Column) -> Column:
    """JSON text with four spaces a level and without escaped letters."""
    return F.pandas_udf(_indented, "string")(text)


def rewrite_image_paths(blocks: DataFrame, mapping: DataFrame, kinds: list[str]) -> DataFrame:
    """Blocks with image_path replaced by the mapping (old, new) for these types; a path of them that
    the mapping lacks is an error; of several new paths for one the last in order counts."""
    unique = mapping.groupBy(F.col("old").alias("image_path")).agg(F.max("new").alias("new"))
    joined = blocks.join(unique, "image_path", "left")
    missing = F.raise_error(F.concat(F.lit("no new path for "), F.col("image_path")))
    path = F.when(F.col("type").isin(kinds) & F.col("image_path").isNotNull(), F.coalesce("new", missing)).otherwise(F.col("image_path"))
    return joined.withColumn("image_path", path).select(*blocks.columns)
