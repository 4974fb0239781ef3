"""Secrets in texts, also below layers of encoding.

A worklist holds layers: at first the text, then what its encoded parts decode to, and so on until a
layer has no encoded part that hasn't been seen. Every layer is searched for the same kinds of secret,
and each of its code points knows the place in the text that it comes from, so that what is found
has a span of the text.

Layers: escapes (percent, backslash, character references, full-width letters), taken back until none is left
in one sweep; base64, plain and for addresses, on one line or wrapped; gzip, zlib, bzip2, xz and zstd
streams inside of either; texts of 16-bit units. Layers with the same content and place count once, which
ends cycles such as a stream that inflates to itself.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import column, text_column
from .words import Texts, passes

# Kinds of secrets in their order, and the least length of each.
KINDS = ["assign", "access", "hex"]
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_VALUE = 6
#: Parts of the names in lower case, one of which every assignment has.
_NAMES = [b"passw", b"secret", b"token", b"apikey", b"api_key"]

# Escapes; a backslash may itself be escaped where it stands in a text. None that is put
# together from decoded characters is longer than _LONGEST code points.
def _escapes(backslash: str) -> re.Pattern[str]:
    return re.compile(
        r"%[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4}|" + backslash + r"(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|u\{[0-9A-Fa-f]{1,6}\}|x[0-9A-Fa-f]{2}|[\"'/])"
        r"|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|amp|apos|equals|colon|lt|gt);|[\uff01-\uff5e]"
    )


_UNIT, _INNER = _escapes(r"\\{1,8}"), _escapes(r"\\")
_LONGEST = 10
_ENTITIES = {"quot": '"', "amp": "&", "apos": "'", "equals": "=", "colon": ":", "lt": "<", "gt": ">"}

#: The shortest secret has 12 characters, which take 16 in base64.
_LEAST = 16
_BASE64 = re.compile(r"[A-Za-z0-9+/]{16,}")
_BASE64_URL = re.compile(r"[A-Za-z0-9_-]{16,}")
_LINE_END = re.compile(r"\r?\n(?=[A-Za-z0-9+/])")
_LINE = re.compile(r"[A-Za-z0-9+/]+")
#: Lines of wrapped base64 are as long as this at least, but for the last.
_LEAST_LINE = 40

# The first bytes of compressed streams.
_STREAMS = {b"\x1f\x8b": "gzip", b"BZh": "bzip2", b"\xfd7zXZ": "xz", b"\x28\xb5\x2f\xfd": "zstd", b"x": "zlib"}
_MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_STREAM = re.compile(_MAGIC.pattern.decode("latin-1"))

#: Inflated bytes are searched in windows of so many, the next one beginning so many before the last's end.
WINDOW, OVERLAP = 8 << 20, 64 << 10
#: Streams inside of streams are followed so deep; every other kind of layer shrinks and so ends by itself.
MOST_INFLATED = 32

FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("layers", T.StringType())]))


@dataclass
class Layer:
    """Text, the span of the document that each of its code points comes from, how it was made, which
    code points it doesn't share with the layer above (None: all), and streams inflated so far."""

    text: str
    start: np.ndarray
    end: np.ndarray
    how: tuple[str, ...] = ()
    new: np.ndarray | None = None
    inflated: int = 0

    def span(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


def matches(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end), leftmost and non-overlapping for each kind."""
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= _VALUE:
            yield 0, m.start(), m.end()
    for kind, pattern in ((1, _ACCESS), (2, _HEX)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def _meaning(unit: str) -> str | int:
    """The character that an escape stands for, or a byte of 128 and more."""
    if len(unit) == 1:
        return chr(ord(unit) - 0xFEE0)
    if unit[0] == "&":
        if unit[1] != "#":
            return _ENTITIES[unit[1:-1]]
        code = int(unit[3:-1], 16) if unit[2] in "xX" else int(unit[2:-1])
    elif unit[-1] in "\"'/":
        return unit[-1]
    else:
        code = int(unit.strip("%\\uUx{}"), 16)
        if code >= 128 and ("x" in unit or unit[0] == "%" and unit[1] != "u"):
            return code
    return chr(code) if code < 0x110000 else "\ufffd"


def unescape(text: str) -> tuple[list[str | int], list[int], list[int]] | None:
    """Characters and bytes of a text without escapes, none left, and the spans they come from; None if it has none.

    What an escape stands for can complete another one, with what is already out, with what follows or
    with both; so each is looked at in its surroundings before it goes out. Each step shortens the
    text, so the sweep is linear however deep escapes are nested.
    """
    m = _UNIT.search(text)
    if not m:
        return None
    out: list[str | int] = []
    start: list[int] = []
    end: list[int] = []
    at, near = 0, _LONGEST - 1
    while m:
        a, b = m.span()
        out.extend(text[at:a])
        start.extend(range(at, a))
        end.extend(range(at + 1, a + 1))
        c = _meaning(m.group())
        while isinstance(c, str):
            before = out[-near:]
            around = "".join(x if isinstance(x, str) else "\x00" for x in before) + c + text[b : b + near]
            k = len(before)
            hit = next((x for x in _INNER.finditer(around) if x.start() <= k < x.end()), None)
            if hit is None:
                break
            taken, more = k - hit.start(), hit.end() - k - 1
            if taken:
                a = start[-taken]
                del out[-taken:], start[-taken:], end[-taken:]
            b += more
            c = _meaning(hit.group())
        out.append(c)
        start.append(a)
        end.append(b)
        at = b
        m = _UNIT.search(text, at)
    out.extend(text[at:])
    start.extend(range(at, len(text)))
    end.extend(range(at + 1, len(text) + 1))
    return out, start, end


def _joined(out: list[str | int], start: np.ndarray, end: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """Text of characters and bytes: bytes that are UTF-8 together make one character, others one
    each; two halves of a 16-bit pair make one, a lone half the replacement character."""
    chars: list[str] = []
    first: list[int] = []
    i, n = 0, len(out)
    while i < n:
        c, size = out[i], 1
        if isinstance(c, int):
            size = 2 if 0xC2 <= c < 0xE0 else 3 if 0xE0 <= c < 0xF0 else 4 if 0xF0 <= c < 0xF5 else 1
            part = out[i : i + size]
            try:
                c = bytes(x if isinstance(x, int) else 0 for x in part).decode()
            except UnicodeDecodeError:
                c, size = chr(c), 1
        elif "\ud800" <= c < "\ue000":
            low = out[i + 1] if i + 1 < n else ""
            if c < "\udc00" and isinstance(low, str) and "\udc00" <= low < "\ue000":
                c, size = chr(0x10000 + ((ord(c) - 0xD800) << 10) + ord(low) - 0xDC00), 2
            else:
                c = "\ufffd"
        chars.append(c)
        first.append(i)
        i += size
    a = np.array(first, np.int64)
    return "".join(chars), start[a], end[np.append(a[1:], n) - 1]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def unescaped(layer: Layer) -> Iterator[Layer]:
    """Layers without escapes of a layer's lines that have some (no secret goes across lines), and of streams in them."""
    text, at = layer.text, 0
    while m := _UNIT.search(text, at):
        a = text.rfind("\n", 0, m.start()) + 1
        b = text.find("\n", m.end())
        at = b = len(text) if b < 0 else b
        line = text[a:b]
        out, start, end = unescape(line)
        start, end = np.array(start, np.int64), np.array(end, np.int64)
        joined, s, e = _joined(out, start, end)
        new = (e - s != 1) | (_points(joined) != _points(line)[s])
        yield Layer(joined, layer.start[a + s], layer.end[a + e - 1], (*layer.how, "escapes"), new, layer.inflated)
        flat = "".join(chr(x) if isinstance(x, int) else x for x in out)
        for m in _STREAM.finditer(flat):
            run = re.compile(r"[\x00-\xff]+").match(flat, m.start())
            data = run.group().encode("latin-1")
            data = data[: stream_size(data)]
            span = (int(layer.start[a + start[m.start()]]), int(layer.end[a + end[m.start() + len(data) - 1] - 1]))
            yield from inflated(data, span, (*layer.how, "escapes"), layer.inflated)


#: Bytes of a zstd stream that are inflated at once: no more than a window comes out of them.
_ZSTD_PIECE = 256


def _pieces(data: bytes) -> Iterator[bytes]:
    """What a stream inflates to, in pieces of about a window at most; returns the bytes that it takes of data."""
    if data[:4] == b"\x28\xb5\x2f\xfd":
        stream = zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()
        for i in range(0, len(data), _ZSTD_PIECE):
            yield stream.decompress(data[i : i + _ZSTD_PIECE])
            if stream.eof:
                return min(i + _ZSTD_PIECE, len(data)) - len(stream.unused_data)
    elif data[:3] == b"BZh" or data[:6] == b"\xfd7zXZ\x00":
        stream = bz2.BZ2Decompressor() if data[:3] == b"BZh" else lzma.LZMADecompressor()
        yield stream.decompress(data, WINDOW)
        while not (stream.eof or stream.needs_input):
            yield stream.decompress(b"", WINDOW)
        return len(data) - len(stream.unused_data)
    else:
        stream, rest = zlib.decompressobj(31 if data[:2] == b"\x1f\x8b" else 15), data
        while rest and not stream.eof:
            yield stream.decompress(rest, WINDOW)
            rest = stream.unconsumed_tail
        return len(data) - len(stream.unused_data)
    return len(data)


_UNSOUND = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError)


def stream_size(data: bytes) -> int:
    """Bytes of data that belong to the stream it begins with; all of them if the stream isn't sound to its end."""
    pieces = _pieces(data)
    try:
        while True:
            next(pieces)
    except StopIteration as end:
        return end.value
    except _UNSOUND:
        return len(data)


def windows_of(data: bytes) -> Iterator[bytes]:
    """What a compressed stream inflates to, as far as it is sound, in windows that overlap."""
    held = bytearray()
    try:
        for got in _pieces(data):
            held += got
            while len(held) > WINDOW + OVERLAP:
                yield bytes(held[:WINDOW])
                del held[: WINDOW - OVERLAP]
    except _UNSOUND:
        pass  # not a stream, or cut off: what came out before counts
    if held:
        yield bytes(held)


def inflated(data: bytes, span: tuple[int, int], how: tuple[str, ...], depth: int) -> Iterator[Layer]:
    """Layers of a compressed stream; everything in them has the stream's span."""
    if depth >= MOST_INFLATED:
        return
    name = next(n for first, n in _STREAMS.items() if data.startswith(first))
    for part in windows_of(data):
        at = np.broadcast_to(np.int64(span[0]), len(part)), np.broadcast_to(np.int64(span[1]), len(part))
        yield from decoded(part, *at, (*how, name), depth + 1)


def decoded(data: bytes, start: np.ndarray, end: np.ndarray, how: tuple[str, ...], depth: int) -> Iterator[Layer]:
    """Layers of bytes and the spans they come from: what they inflate to, else their text in UTF-8, in
    16-bit units, or with a character for each byte."""
    if _MAGIC.match(data):
        sound = False
        for layer in inflated(data, (int(start[0]), int(end[-1])), how, depth):
            sound = True
            yield layer
        if sound:
            return
    if len(data) >= 8 and data[1::2].count(0) * 10 >= len(data) * 4:
        text = data[: len(data) // 2 * 2].decode("utf-16-le", "replace")
        lead = np.cumsum([0, *(2 + 2 * (c > "\uffff") for c in text)])
        yield Layer(text, start[lead[:-1]], end[lead[1:] - 1], (*how, "utf-16"), None, depth)
        return
    try:
        text = data.decode()
    except UnicodeDecodeError:
        yield Layer(data.decode("latin-1"), start, end, how, None, depth)
        return
    if len(text) == len(data):
        yield Layer(text, start, end, how, None, depth)
    else:
        lead = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        yield Layer(text, start[lead], end[np.append(lead[1:], len(data)) - 1], how, None, depth)


def _places(text: str) -> Iterator[tuple[np.ndarray, bytes]]:
    """Places of characters that may be base64 together, and these characters in the plain alphabet."""
    plain = [m.span() for m in _BASE64.finditer(text)]
    for a, b in sorted({*plain, *(m.span() for m in _BASE64_URL.finditer(text))}):
        yield np.arange(a, b), text[a:b].replace("-", "+").replace("_", "/").encode()
    ended = 0
    for a, b in plain:
        parts = [(a, b)]
        while a >= ended and parts[-1][1] - parts[-1][0] >= _LEAST_LINE and (m := _LINE_END.match(text, parts[-1][1])):
            parts.append(_LINE.match(text, m.end()).span())
        if len(parts) > 1:
            ended = parts[-1][1]
            yield np.concatenate([np.arange(*x) for x in parts]), "".join(text[x:y] for x, y in parts).encode()


def from_base64(layer: Layer) -> Iterator[Layer]:
    for at, code in _places(layer.text):
        size = len(code) - (len(code) % 4 == 1)
        data = base64.b64decode(code[:size] + b"=" * (-size % 4))
        k = np.arange(len(data))
        start, end = layer.start[at[8 * k // 6]], layer.end[at[(8 * k + 13) // 6 - 1]]
        yield from decoded(data, start, end, (*layer.how, "base64"), layer.inflated)


def search(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, layers) of a text's secrets by start, kind and end; layers are joined by ">" from the
    outside in, "" for what stands in the text as it is. Spans found on several ways count once, the shortest way first."""
    place = np.arange(len(text) + 1)
    found: dict[tuple[int, int, int], str] = {}
    work = deque([Layer(text, place[:-1], place[1:])])
    seen = set()
    while work:
        layer = work.popleft()
        if not layer.text:
            continue
        key = hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), *layer.span(0, len(layer.text))
        if key in seen:
            continue
        seen.add(key)
        changed = None if layer.new is None else np.concatenate([[0], np.cumsum(layer.new)])
        for kind, a, b in matches(layer.text):
            if changed is None or changed[b] > changed[a]:
                start, end = layer.span(a, b)
                found.setdefault((start, kind, end), ">".join(layer.how))
        work.extend(unescaped(layer))
        work.extend(from_base64(layer))
    return [(KINDS[kind], start, end, how) for (start, kind, end), how in sorted(found.items())]


_IS_64 = np.zeros(256, bool)
_IS_64[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")] = True
#: Bytes that every escape has: the signs before them, and the first byte of full-width letters.
_SIGNS = [b"%", b"\\", b"&", b"\xef\xbc", b"\xef\xbd"]


def _worth(t: Texts) -> np.ndarray:
    """Which of a pass's texts can hold a secret at all: long runs of the base64 alphabet (which long hexadecimal
    numbers and access keys are too), a name, or an escape."""
    edge = np.diff(np.concatenate([[0], _IS_64[t.raw].astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.zeros(t.n, bool)
    out[np.searchsorted(t.at, a[b - a >= _LEAST], "right") - 1] = True
    for i in np.flatnonzero(~out).tolist():
        raw = t.raw[t.at[i] : t.at[i + 1]].tobytes()
        low = raw.lower()
        out[i] = any(x in low for x in _NAMES) or any(x in raw for x in _SIGNS)
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found) of every whole text: found has kind, start and end (code points, end exclusive) and layers of
    each secret, by start and kind; layers is "" for those of the text as it is. No shuffle.

    Null and empty texts have none. Rows are searched each by itself, whatever their ids; a text takes
    about 20 times its size while it is searched.
    """
    source = docs.select(id_col, text_col)
    out = T.StructType([source.schema[id_col], T.StructField("found", FOUND)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layers", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in passes(text_column(batch, text_col)):
                worth = _worth(t)
                rows = [[dict(zip(("kind", "start", "end", "layers"), x, strict=True)) for x in search(t.text(i))] if worth[i] else [] for i in range(t.n)]
                yield pa.RecordBatch.from_arrays([column(batch, id_col).slice(t.first, t.n), pa.array(rows, kind)], names=out.names)

    return source.mapInArrow(run, out)


def _spans(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of find_secrets' rows: numbers and the digest are of
    what stands in the texts as they are, spans of everything."""
    own = F.filter("found", lambda x: x["layers"] == "")
    kinds = F.transform(own, lambda x: x["kind"])
    count = [F.size(F.array_remove(kinds, k)) for k in KINDS]
    count = [(F.size(own) - n).cast("long").alias(f"n_{k}") for k, n in zip(KINDS, count, strict=True)]
    return found.select(id_col, *count, F.sha2(_spans(own), 256).alias("base_sha256"), _spans(F.col("found")).alias("spans"), "found")
