"""SentencePiece encoding and decoding for models of the merge type, without the library's encoder.

Encoding goes from left to right. At a position it takes the longest piece that an Aho-Corasick
automaton finds there, provided that the piece and the one before it are compatible: merging the
characters of both again must give just these two. If not, it tries shorter pieces, and if none
fits it goes back by a piece; positions from which no end was reached are kept in a bitfield and
never tried again. A sequence whose neighbours are all compatible is the one that merging gives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .merges import Memo, compatible, last_merges
from .shared import column, text_column

SPACE = "▁"


def _proto(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """A merge-type model: identity normaliser, byte fallback, spaces kept."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        rule = dict(next((_proto(v) for f, v in _proto(sp.serialized_model_proto()) if f == 3), ()))
        if rule.get(2) or rule.get(4, 1):
            raise ValueError("only the identity normaliser that keeps spaces is supported")
        self.prefix = bool(rule.get(3, 1))
        self.hidden = {i for i in range(n) if sp.is_control(i)}
        self.byte_of = {i: int(self.piece[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.special = {*self.hidden, *self.byte_of, self.unk}
        normal = [i for i in range(n) if i not in self.hidden and i not in self.byte_of and i != self.unk]
        self.score = {self.piece[i]: sp.get_score(i) for i in normal}
        self.id = {self.piece[i]: i for i in normal}
        self.last = last_merges({p: p for p in self.id}, self.rank)
        self.chars = {c for p in self.last for c in p}
        self.automaton = ahocorasick.Automaton()
        for p in self.last:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.last), None) for p in self.last}
        # Merges never cross from another character to a space if no piece holds such a pair, nor a
        # character that no piece holds: texts are cut there, and each part is encoded by itself.
        cut = not any(a != SPACE and b == SPACE for p in self.id for a, b in zip(p, p[1:], strict=False))
        line = "" if "\n" in self.chars else "\n"
        self.parts = re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + ("|\n" if line else "") if cut else r"(?s).+")
        self.compatible = Memo(self._compatible)
        self.ids = Memo(self._part)

    def rank(self, left: str, right: str) -> float | None:
        score = self.score.get(left + right)
        return None if score is None else -score

    def _compatible(self, pair: tuple[str, str]) -> bool:
        return compatible(*pair, self.last, self.rank)

    def _known(self, text: str) -> list[str]:
        """Pieces of a text all of whose characters are in pieces."""
        n = len(text)
        longest = [0] * n
        for last, size in self.automaton.iter(text):
            longest[last + 1 - size] = size  # ends come in ascending order
        out: list[str] = []
        at = 0
        failed = bytearray((n >> 3) + 1)  # a bit for each place from which no sequence reached the end
        piece: str | None = text[: longest[0]]
        while at < n:
            while piece:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.compatible[out[-1], piece]):
                    break
                piece = self.shorter[piece]
            if piece:
                out.append(piece)
                at += len(piece)
                piece = text[at : at + longest[at]] if at < n else None
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:  # merging gives a compatible sequence, so this can only be a broken vocabulary
                    raise ValueError("no compatible pieces cover the text")
                piece = out.pop()
                at -= len(piece)
                # The end of this piece is marked as failed, so the loop above goes on to a shorter one.
        return out

    def _part(self, text: str) -> bytes:
        """Ids of a part, as little-endian unsigned 32-bit integers."""
        ids: list[int] = []
        known = self.chars
        run = ""
        for c in (*text, None):
            if c in known:
                run += c
                continue
            if run:
                ids += map(self.id.__getitem__, self._known(run))
                run = ""
            if c is not None:
                data = c.encode()
                ids += [self.byte_id[b] for b in data] if self.byte_id else [self.unk]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str, ends: bool = True) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers, with begin and end ids if `ends`."""
        if text:
            text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        body = b"".join(map(self.ids.__getitem__, self.parts.findall(text)))
        return np.array([self.bos], "<u4").tobytes() + body + np.array([self.eos], "<u4").tobytes() if ends else body

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no valid UTF-8 become U+FFFD each."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        pieces = self.piece
        if numbers and numbers[0] in self.hidden and (len(numbers) < 2 or numbers[1] not in self.hidden):
            del numbers[0]
        if numbers and numbers[-1] in self.hidden:
            numbers.pop()
        if not self.special.isdisjoint(numbers):
            shown = [i for i in numbers if i not in self.hidden]
            out: list[str] = []
            held = bytearray()
            for i in numbers:
                if i in self.byte_of:
                    held.append(self.byte_of[i])
                    continue
                if held:
                    out.append(_utf8(bytes(held)))
                    held.clear()
                out.append(" ⁇ " if i == self.unk else "" if i in self.hidden else pieces[i])
            if held:
                out.append(_utf8(bytes(held)))
            lead = bool(shown) and shown[0] not in self.byte_of
            text = "".join(out)
        else:
            text, lead = "".join([pieces[i] for i in numbers]), True
        if lead and self.prefix and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")


def _utf8(data: bytes) -> str:
    """Valid characters as they are, every other byte as U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=4)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """(id, n_tokens, ids binary, decoded): each whole text's ids with begin and end ids, as
    little-endian unsigned 32-bit integers, and the text they decode to. No shuffle.

    Null and empty texts have the begin and end id only and decode to the empty string.
    """
    source = docs.select(id_col, text_col)
    out = T.StructType([source.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), *[T.StructField("decoded", T.StringType())] * decode])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = [m.encode(t) for t in text_column(part, text_col).to_pylist()]
                cols = [column(part, id_col), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decode:
                    cols.append(pa.array([m.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return source.mapInArrow(run, out)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    from pyspark.sql import functions as F

    return encoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


