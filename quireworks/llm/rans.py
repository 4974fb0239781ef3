"""Token-id files coded with a static range asymmetric numeral system.

A file holds the ids of consecutive documents. Its header has one frequency table, shared by all of
its blocks; each block codes up to BLOCK ids by itself. In a block, LANES coders take ids in turn
and share one stream of 32-bit words, so that NumPy handles a step of all lanes at once. Checkpoints
keep the lanes' states and the place in the stream every so many steps: decoding can begin at any of
them. Checksums cover the header, each block's bytes and each block's ids. A file is closed once it
has FILE_IDS ids, so that files, the units of parallel reading, stay small whatever is written.

    magic 8 | header length u32 | header crc u32 | header (zlib of JSON line + arrays) | blocks
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import column, new_folder, text_column, write_file
from .words import passes

MAGIC = b"IDRANS01"
LANES = 1024
BLOCK = 1 << 20
#: Steps of all lanes between two checkpoints.
CHECKPOINT = 256
#: A file has fewer ids than this but for those of its last document.
FILE_IDS = 1 << 22
#: Files of one range of ids that are numbered apart.
_FILES = 1 << 20
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


@dataclass
class Frequencies:
    """Symbols that occur, their frequencies with the sum 2**bits, and the sums before each."""

    symbols: np.ndarray
    freq: np.ndarray
    bits: int

    def __post_init__(self):
        self.start = np.concatenate([[0], np.cumsum(self.freq)])[:-1].astype(np.uint64)
        self.freq = self.freq.astype(np.uint64)

    @classmethod
    def of(cls, counts: np.ndarray) -> Frequencies:
        """From counts of 0, 1, 2, ...: scaled so that each id that occurs keeps at least 1."""
        symbols = np.flatnonzero(counts)
        n = counts[symbols].astype(np.float64)
        bits = max(12, int(len(symbols)).bit_length() + 3)
        room = (1 << bits) - len(symbols)
        share = n / n.sum() * room
        freq = 1 + np.floor(share).astype(np.int64)
        left = (1 << bits) - int(freq.sum())
        freq[np.argsort(np.floor(share) - share, kind="stable")[:left]] += 1
        return cls(symbols, freq, bits)


def encode_block(ranks: np.ndarray, table: Frequencies) -> tuple[dict, bytes]:
    """Codes indices into table.symbols. The last step may use only the first lanes."""
    n = len(ranks)
    lanes = min(LANES, n)
    steps = -(-n // lanes)
    freq, start = table.freq[ranks], table.start[ranks]
    bits, mask = np.uint64(table.bits), np.uint64(0xFFFFFFFF)
    full = np.uint64(63 - table.bits)
    x = np.full(lanes, _LOW)
    words: list[np.ndarray] = []
    kept: list[tuple[int, np.ndarray]] = []
    written = 0
    for step in range(steps - 1, -1, -1):
        lo, hi = step * lanes, min((step + 1) * lanes, n)
        f, c, s = freq[lo:hi], start[lo:hi], x[: hi - lo]
        over = s >= (f << full)
        if over.any():
            out = s[over]
            words.append((out & mask).astype("<u4"))
            written += len(out)
            s[over] = out >> _WORD
        q = s // f
        s[:] = (q << bits) + (s - q * f) + c
        if step % CHECKPOINT == 0:
            kept.append((written, x.copy()))
    kept.reverse()
    words.reverse()
    places = np.array([written - w for w, _ in kept], "<u4")
    states = np.concatenate([s for _, s in kept]).astype("<u8")
    data = b"".join([places.tobytes(), states.tobytes(), *(w.tobytes() for w in words)])
    return {"n": n, "lanes": lanes, "points": len(kept), "bytes": len(data), "crc": zlib.crc32(data)}, data


def decode_block(info: dict, data: bytes, table: Frequencies, slots: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """Indices into table.symbols, from checkpoint `first` up to checkpoint `last` (the end if None)."""
    if zlib.crc32(data) != info["crc"]:
        raise ValueError("a block's bytes don't match their checksum")
    n, lanes, points = info["n"], info["lanes"], info["points"]
    places = np.frombuffer(data, "<u4", points)
    states = np.frombuffer(data, "<u8", points * lanes, 4 * points)
    words = np.frombuffer(data, "<u4", offset=4 * points + 8 * points * lanes).astype(np.uint64)
    x = states[first * lanes : (first + 1) * lanes].astype(np.uint64)
    at = int(places[first])
    begin = first * CHECKPOINT
    end = min(-(-n // lanes), last * CHECKPOINT) if last is not None else -(-n // lanes)
    out = np.empty(min(end * lanes, n) - begin * lanes, np.int64)
    bits, low = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    base = begin * lanes
    for step in range(begin, end):
        lo, hi = step * lanes, min((step + 1) * lanes, n)
        s = x[: hi - lo]
        slot = s & low
        r = slots[slot]
        out[lo - base : hi - base] = r
        s[:] = table.freq[r] * (s >> bits) + (slot - table.start[r])
        under = s < _LOW
        k = int(np.count_nonzero(under))
        if k:
            s[under] = (s[under] << _WORD) | words[at : at + k]
            at += k
    return out


def slots_of(table: Frequencies) -> np.ndarray:
    return np.repeat(np.arange(len(table.freq)), table.freq.astype(np.int64))


def encode_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, nulls: int = 0) -> Iterator[bytes]:
    """The bytes of one file: documents' keys (the first `nulls` have none), their numbers of ids and
    all ids in order."""
    table = Frequencies.of(np.bincount(ids, minlength=1))
    ranks = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    ranks[table.symbols] = np.arange(len(table.symbols))
    blocks, parts = [], []
    for lo in range(0, len(ids), BLOCK):
        part = ids[lo : lo + BLOCK]
        info, data = encode_block(ranks[part], table)
        blocks.append(info | {"ids_crc": zlib.crc32(part.astype("<u4").tobytes())})
        parts.append(data)
    top = json.dumps({"bits": table.bits, "symbols": len(table.symbols), "docs": len(doc_ids), "nulls": nulls, "blocks": blocks})
    arrays = [np.diff(table.symbols, prepend=0).astype("<u4"), table.freq.astype("<u4"), np.diff(doc_ids, prepend=0).astype("<i8"), lengths.astype("<u8")]
    header = zlib.compress(top.encode() + b"\n" + b"".join(a.tobytes() for a in arrays))
    yield MAGIC + struct.pack("<II", len(header), zlib.crc32(header)) + header
    yield from parts


@dataclass
class TokenFile:
    """A file read back: documents' keys, their numbers of ids, and blocks to decode."""

    doc_ids: np.ndarray
    nulls: int  # so many documents at the beginning have no key
    lengths: np.ndarray
    table: Frequencies
    blocks: list[dict]
    body: bytes

    @classmethod
    def read(cls, data: bytes) -> TokenFile:
        size, crc = struct.unpack_from("<II", data, len(MAGIC))
        at = len(MAGIC) + 8
        packed = data[at : at + size]
        if not data.startswith(MAGIC) or zlib.crc32(packed) != crc:
            raise ValueError("not a token file, or its header is damaged")
        header = zlib.decompress(packed)
        line = header.index(b"\n")
        top = json.loads(header[:line])
        arrays, p = [], line + 1
        for kind, n in (("<u4", top["symbols"]), ("<u4", top["symbols"]), ("<i8", top["docs"]), ("<u8", top["docs"])):
            arrays.append(np.frombuffer(header, kind, n, p))
            p += n * np.dtype(kind).itemsize
        table = Frequencies(np.cumsum(arrays[0].astype(np.int64)), arrays[1].astype(np.int64), top["bits"])
        return cls(np.cumsum(arrays[2]), top["nulls"], arrays[3].astype(np.int64), table, top["blocks"], data[at + size :])

    def ids(self) -> Iterator[np.ndarray]:
        """Ids of each block, little-endian unsigned 32-bit."""
        slots = slots_of(self.table)
        symbols = self.table.symbols.astype("<u4")
        at = 0
        for info in self.blocks:
            got = symbols[decode_block(info, self.body[at : at + info["bytes"]], self.table, slots)]
            if zlib.crc32(got.tobytes()) != info["ids_crc"]:
                raise ValueError("a block's ids don't match their checksum")
            at += info["bytes"]
            yield got

    def some_ids(self, first: int, last: int) -> np.ndarray:
        """Ids from place `first` up to `last` of the file: of the blocks that hold them only the
        steps between the nearest checkpoints are decoded."""
        slots, symbols = slots_of(self.table), self.table.symbols.astype("<u4")
        out, at, lo = [np.zeros(0, "<u4")], 0, 0
        for info in self.blocks:
            a, b = max(first - lo, 0), min(last - lo, info["n"])
            if a < b:
                span = CHECKPOINT * info["lanes"]
                got = decode_block(info, self.body[at : at + info["bytes"]], self.table, slots, a // span, -(-b // span))
                out.append(symbols[got[a - a // span * span : b - a // span * span]])
            at += info["bytes"]
            lo += info["n"]
        return np.concatenate(out)


MANIFEST = "file_no long, name string, docs long, tokens long, bytes long"


def write_token_files(docs: DataFrame, path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents' ids, each with end_id appended, in ascending order of id_col; returns
    the manifest (stored beside the files). Each range of ids makes as many files as it needs; a task
    that is run again writes the same files again. Null texts are empty. Rows without an id come
    first, and keep none; rows that share an id are documents of their own, in no certain order."""
    ordered = docs.select(id_col, text_col).repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import run_encoder

        encoder = run_encoder(path)
        end = encoder.width.type(end_id)
        keys: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held, files = 0, 0

        def close() -> pa.RecordBatch:
            """Writes what is held as the next file."""
            nonlocal keys, lengths, parts, held, files
            no = TaskContext.get().partitionId() * _FILES + files
            doc_ids, n, ids = pa.concat_arrays(keys), np.concatenate(lengths), np.concatenate(parts)
            keys, lengths, parts, held, files = [], [], [], 0, files + 1
            name = f"ids-{no:019d}.rans"
            size = write_file(folder, name, encode_file(doc_ids.fill_null(0).to_numpy(zero_copy_only=False), n, ids, doc_ids.null_count))
            return pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([name]), pa.array([len(n)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([size], pa.int64())], names=["file_no", "name", "docs", "tokens", "bytes"])

        for batch in batches:
            for t in passes(text_column(batch, text_col)):
                got, n = encoder.encode(t)
                keys.append(column(batch, id_col).slice(t.first, t.n).cast(pa.int64()))
                lengths.append(n + 1)
                parts.append(np.insert(got, np.cumsum(n), end))
                held += len(parts[-1])
                if held >= FILE_IDS:
                    yield close()
        if held:
            yield close()

    manifest = ordered.mapInArrow(run, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame, folder: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document in the files. start counts the ids
    of all documents before; files' totals are summed in two levels, by ranges of ids and inside each."""
    spark = manifest.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(column(batch, "path").to_pylist(), column(batch, "content"), strict=True):
                file = TokenFile.read(content.as_buffer().to_pybytes())
                blocks = [*file.ids()]
                ids = np.concatenate(blocks) if blocks else np.zeros(0, "<u4")
                stop = np.cumsum(file.lengths)
                start = stop - file.lengths
                data = memoryview(ids.tobytes())
                each = [data[4 * a : 4 * b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                cols = [pa.array(np.full(len(each), int(name[-24:-5]), np.int64)), pa.array(file.doc_ids, mask=np.arange(len(each)) < file.nulls), pa.array(start), pa.array(file.lengths), pa.array([zlib.crc32(e) for e in each], pa.int64())]
                if with_ids:
                    cols.append(pa.array([bytes(e) for e in each], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["file_no", id_col, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rans").load(folder).select("path", "content")
    docs = files.mapInArrow(run, f"file_no long, {id_col} long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    group = F.floor(F.col("file_no") / _FILES)
    totals = manifest.groupBy(group.alias("g")).agg(F.sum("tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("g").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = manifest.withColumn("g", group).join(totals.select("g", before.alias("before")), "g").select("file_no", (F.col("before") + inside).alias("base"))
    return docs.join(offsets, "file_no").withColumn("start", F.col("start") + F.col("base")).drop("file_no", "base")


def token_files(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files into a new shared folder and reads them back."""
    folder = new_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, path, end_id, folder, id_col, text_col), folder, id_col)
