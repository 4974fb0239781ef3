"""WARC archives: writing records, normalising whole-file gzip streams, reading by offset.

Archives are first written as one gzip stream each. The normaliser inflates such a stream once,
piece by piece, and rewrites every record as a gzip member of its own, together with a sidecar
index (one JSON line a record: offset, length, type, id), so that any record can be read alone.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, new_folder, open_fs, stored, write_file

#: Equal payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
#: An archive is closed after so many bytes of records; one read task gets so many bytes of members.
ARCHIVE_BYTES = 1 << 25
READ_BYTES = 1 << 23
#: Archives of one task that are numbered apart.
_ARCHIVES = 1 << 20
_CHUNK = 1 << 18
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str, digest: str, size: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """One record: an HTTP response with its payload, or a revisit that has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join(url.split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def one_stream(records: Iterator[bytes]) -> Iterator[bytes]:
    """All records as a single gzip member."""
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    for r in records:
        if data := gz.compress(r):
            yield data
    yield gz.flush()


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip stream of any number of members, in bounded pieces."""
    gz = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            yield gz.decompress(chunk, _CHUNK)
            if gz.eof:
                chunk, gz = gz.unused_data, zlib.decompressobj(31)
            else:
                chunk = gz.unconsumed_tail


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of inflated bytes; holds one record and one piece at a time."""
    held = bytearray()
    need: int | None = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(fields(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("an archive ends inside a record")


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def normalise(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, dict]]:
    """(gzip member, index entry) of each record of a stream that is inflated once."""
    at = 0
    for data in split_records(inflated(chunks)):
        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = gz.compress(data) + gz.flush()
        head = fields(data[: data.index(b"\r\n\r\n")])
        yield member, {"offset": at, "length": len(member), "type": head["warc-type"], "id": head["warc-record-id"]}
        at += len(member)


def _page(ref: str | None) -> int | None:
    number = ref.rpartition(":")[2].rstrip(">") if ref else ""
    return int(number) if number else None


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, digest, type, refers_to) of a record; a response's digest and size
    are those of the payload found, and must be those that its header names."""
    end = data.index(b"\r\n\r\n")
    head = fields(data[:end])
    block = data[end + 4 : end + 4 + int(head["content-length"])]
    http_end = block.index(b"\r\n\r\n")
    size, digest = int(fields(block[:http_end])["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response":
        payload = block[http_end + 4 :]
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("a payload doesn't match its record's header")
    return _page(head["warc-record-id"]), size, digest, head["warc-type"], _page(head.get("warc-refers-to"))


def plan_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, size, refers_to): of equal payloads of at least `least`
    bytes, the one with the largest page_id stays. A null html is an empty payload.

    Payloads themselves aren't shuffled by digest: the groups' largest ids are counted from
    digests alone, partly before the shuffle, and only groups of two and more come back.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary"))
    own = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    groups = own.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "keeper")
    joined = own.join(groups, (F.col("digest") == F.col("d")) & (F.col("size") >= least), "left")
    return joined.select("page_id", "url", "payload", "digest", "size", F.when(F.col("keeper") != F.col("page_id"), F.col("keeper")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = REVISIT_BYTES) -> DataFrame:
    """Writes all pages as archives of one gzip stream each; (no, name, records, bytes) of each. A
    task closes an archive after ARCHIVE_BYTES and goes on with the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_records() -> Iterator[bytes]:
            for batch in batches:
                cols = [column(batch, c) for c in ("page_id", "url", "digest", "size", "payload", "refers_to")]
                for page, url, digest, size, payload, ref in zip(*cols, strict=True):
                    ref = ref.as_py()
                    yield record(page.as_py(), url.as_py(), digest.as_py(), size.as_py(), None if ref is not None else payload.as_py(), ref)

        left = all_records()
        for k, first in enumerate(left):
            n = held = 0

            def records() -> Iterator[bytes]:
                nonlocal n, held
                for data in chain([first], left):
                    n, held = n + 1, held + len(data)
                    yield data
                    if held >= ARCHIVE_BYTES:
                        return

            no = TaskContext.get().partitionId() * _ARCHIVES + k
            name = f"pages-{no:019d}.stream.warc.gz"
            size = write_file(folder, name, one_stream(records()))
            yield pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["no", "name", "records", "bytes"])

    return stored(plan_revisits(pages, least).mapInArrow(run, "no long, name string, records long, bytes long"), "warc-written")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Normalises each archive of the folder, streaming from file to file; (no, name, part, offset,
    length, type, id): the index that also lies beside each archive as .idx. Archives are dealt to as
    many tasks as there are archives, by ranges of their numbers."""
    files = archives.select("no", "name").repartitionByRange(max(1, archives.count()), "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        for batch in batches:
            for no, name in zip(column(batch, "no").to_pylist(), column(batch, "name").to_pylist(), strict=True):
                target = name.replace(".stream.warc.gz", ".warc.gz")
                index: list[dict] = []

                def members() -> Iterator[bytes]:
                    with fs.open_input_stream(f"{path}/{name}", compression=None) as source:
                        for member, entry in normalise(iter(lambda: source.read(_CHUNK), b"")):
                            index.append(entry)
                            yield member

                write_file(folder, target, members())
                write_file(folder, target + ".idx", iter(["".join(json.dumps(e) + "\n" for e in index).encode()]))
                cols = [pa.array([no] * len(index), pa.int64()), pa.array([target] * len(index)), pa.array([e["offset"] // READ_BYTES for e in index], pa.int64())]
                cols += [pa.array([e[k] for e in index], t) for k, t in (("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("id", pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=["no", "name", "part", "offset", "length", "type", "id"])

    return stored(files.mapInArrow(run, "no long, name string, part long, offset long, length long, type string, id string"), "warc-index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Reads every indexed record from its own member. Parts of archives of READ_BYTES are dealt to as
    many tasks as there are parts, by ranges; a task reads its parts in order."""
    parts = max(1, index.select("no", "part").distinct().count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        open_name, source = None, None
        for batch in batches:
            rows = []
            for name, offset, length in zip(*(column(batch, c).to_pylist() for c in ("name", "offset", "length")), strict=True):
                if name != open_name:
                    open_name, source = name, fs.open_input_file(f"{path}/{name}")
                source.seek(offset)
                rows.append(parse(zlib.decompress(source.read(length), 31)))
            kinds = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    dealt = index.select("no", "part", "name", "offset", "length").repartitionByRange(parts, "no", "part").sortWithinPartitions("no", "offset")
    return dealt.select("name", "offset", "length").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Writes, normalises and reads back all pages. Empty tables give no archive and no rows;
    null html is an empty payload, null url an empty one. Rows without a page_id, and rows that share
    the id of the one that stays, are responses."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_archives(normalise_archives(write_archives(pages, folder, least), folder), folder)
