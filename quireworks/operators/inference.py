"""Recognition models as batch functions over pages and blocks. No model is part of this engine.

A page is one row from its picture to its contents: the layout model adds the page's blocks, the content model an
answer for each of them, and the picture stays where it is. So each model is asked once, a picture
is in one row only, and no shuffle or join carries it.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions import pixels as P
from ..functions.latex import equation, inline_math
from ..functions.tables import otsl_html
from ..schema import NOT_EXTRACTED, PROMPTS
from . import assemble, layout


class Model(Protocol):
    """Answers for a batch of requests, in their order. With more than one open call it is called from as many threads."""

    def __call__(self, images: list[bytes | None], prompts: list[str]) -> list[str]: ...


@dataclass(frozen=True)
class Limits:
    """How a model is asked by a task: requests of a call, bytes of a call's pictures (each counts once, a larger one goes
    alone), calls that are open at once, and how often a request is asked by itself after its call failed."""

    requests: int = 256
    picture_bytes: int = 32 << 20
    open_calls: int = 1
    retries: int = 1


#: Pixels of a page that is cut up; larger ones are scaled down first.
MOST_PIXELS = 64_000_000
#: Bytes of cut-out pictures that leave a task at once, about.
HELD = 4 << 20

_MODELS: dict[str, tuple[Callable[[], Model], Limits]] = {}
_loaded: dict[str, Model] = {}
Request = tuple[bytes | None, str]
#: An answer, or why there is none.
Answer = tuple[str | None, str | None]


def register(name: str, make: Callable[[], Model], limits: Limits = Limits()) -> None:  # noqa: B008
    _MODELS[name] = make, limits


def stub() -> Model:
    """Answers with the size of the picture and the prompt: for tests of the plumbing only."""
    return lambda images, prompts: [f"{len(i or b'')} bytes: {p.strip()}" for i, p in zip(images, prompts, strict=True)]


def echo() -> Model:
    """Answers the layout prompt with the picture's own bytes, all else as the stub does."""
    other = stub()
    return lambda images, prompts: [(i or b"").decode() if p == PROMPTS["layout"] else other([i], [p])[0] for i, p in zip(images, prompts, strict=True)]


register("stub", stub)
register("echo", echo)


def calls(requests: Iterable[Request], limits: Limits) -> Iterator[list[Request]]:
    """Requests in calls that keep the limits; neighbours that share a picture share its bytes."""
    held: list[Request] = []
    size, last = 0, None
    for image, prompt in requests:
        more = 0 if image is None or image is last and held else len(image)
        if held and (len(held) >= limits.requests or size + more > limits.picture_bytes):
            yield held
            held, size, more = [], 0, len(image or b"")
        held.append((image, prompt))
        size, last = size + more, image
    if held:
        yield held


def _answers(model: Model, call: list[Request]) -> list[str]:
    images, prompts = map(list, zip(*call, strict=True))
    got = model(images, prompts)
    if len(got) != len(call):
        raise ValueError("a model must give one answer for each request")
    return got


def _reason(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def ask(model: Model, requests: Iterable[Request], limits: Limits = Limits()) -> Iterator[Answer]:  # noqa: B008
    """An answer for each request, in their order. At most so many calls are open at once as the limits
    say, and no more requests are taken than these need. Requests of a call that failed are asked one by
    one; one that fails then too has its reason instead of an answer."""

    def one(request: Request) -> Answer:
        for left in range(limits.retries, -1, -1):
            try:
                return _answers(model, [request])[0], None
            except Exception as e:  # whatever a model raises is its answer's reason
                if not left:
                    return None, _reason(e)
        raise AssertionError

    def all_of(call: list[Request]) -> list[Answer]:
        try:
            return [(x, None) for x in _answers(model, call)]
        except Exception:
            return [one(r) for r in call]

    if limits.open_calls <= 1:
        for call in calls(requests, limits):
            yield from all_of(call)
        return
    with ThreadPoolExecutor(limits.open_calls) as pool:
        window: deque = deque()
        for call in calls(requests, limits):
            if len(window) == limits.open_calls:
                yield from window.popleft().result()
            window.append(pool.submit(all_of, call))
        while window:
            yield from window.popleft().result()


def _model(name: str, make: Callable[[], Model]) -> Model:
    """A worker loads a model once."""
    if name not in _loaded:
        _loaded[name] = make()
    return _loaded[name]


def recognise(requests: DataFrame, model: str = "stub", image: str = "image", prompt: str = "prompt", output: str = "output", priority: str | None = None, error: str | None = None, keep_image: bool = False) -> DataFrame:
    """Requests with the model's answers. Rows keep their keys, so no join brings answers back.
    priority: a column; a task asks for its smallest first. error: a column for the reasons of requests
    without an answer; without it the first of them fails the job."""
    requests = requests if priority is None else requests.sortWithinPartitions(priority)
    make, limits = _MODELS[model]
    names = [n for n in requests.columns if keep_image or n != image]
    out = T.StructType([*(requests.schema[n] for n in names), *(T.StructField(n, T.StringType()) for n in (output, error) if n)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model, make)
        for batch in batches:
            at = batch.schema.get_field_index
            images = batch.column(at(image))
            asked = ((i.as_py(), p.as_py()) for i, p in zip(images, batch.column(at(prompt)), strict=True))
            answers = list(ask(own, asked, limits))
            if not error and (bad := [e for _, e in answers if e]):
                raise RuntimeError(bad[0])
            new = [pa.array([x for x, _ in answers], pa.string()), *([pa.array([e for _, e in answers], pa.string())] if error else [])]
            yield pa.RecordBatch.from_arrays([*(batch.column(at(n)) for n in names), *new], names=out.names)

    return requests.mapInArrow(run, out)


def prompt_of(kind: Column, skip: list[str] | None = None) -> Column:
    """The prompt of a type, null for those that aren't asked about."""
    known = F.create_map(*(F.lit(x) for k, p in PROMPTS.items() for x in (k, p)))
    return F.when(~kind.isin([*NOT_EXTRACTED, *(skip or [])]), F.coalesce(F.try_element_at(known, kind), F.lit(PROMPTS["default"])))


def read_layouts(pages: DataFrame, model: str = "stub") -> DataFrame:
    """Pages (page_id, image, ...) with `blocks`, an array of (idx, type, bbox, angle), from the answer to the
    layout prompt, and `error`, why there is none; the picture stays."""
    asked = recognise(pages.withColumn("prompt", F.lit(PROMPTS["layout"])), model, output="_layout", error="error", keep_image=True)
    return asked.withColumn("blocks", layout.blocks_of(F.col("_layout"), rectangles=True)).drop("_layout", "prompt")


def layout_pictures(pages: DataFrame, width: int = 1036, height: int = 1036, image: str = "image") -> DataFrame:
    """Pages with their pictures (PNG) in the size that a layout model takes, and `error`, why one can't be opened."""
    names = [n for n in pages.columns if n not in (image, "error")]
    out = T.StructType([*(pages.schema[n] for n in names), T.StructField(image, T.BinaryType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            made, errors = [], []
            for data in batch.column(at(image)):
                try:
                    made.append(P.encoded(P.resized(P.opened(data.as_py() or b""), width, height)))
                    errors.append(None)
                except P.Undecodable as e:
                    made.append(None)
                    errors.append(_reason(e))
            yield pa.RecordBatch.from_arrays([*(batch.column(at(n)) for n in names), pa.array(made, pa.binary()), pa.array(errors, pa.string())], names=out.names)

    return pages.select(*names, image).mapInArrow(run, out)


def cut_pictures(pages: DataFrame, kinds: list[str] | None = None, frame: bool = True, image: str = "image") -> DataFrame:
    """(page_id, idx, type, picture, width, height, error): what is cut out of the pages' pictures (PNG) for each of their
    `blocks` of some types (null: those that are recognised), turned upright, and with `frame` of at least 28 by 28 pixels and
    not longer than 50 times its width. Blocks without a pixel have no row; a picture that can't be opened
    gives one with its error and no idx. A page's picture is opened once and no further than its own row."""
    out = "idx int, type string, picture binary, width int, height int, error string"
    key = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for page, data, blocks in zip(*(batch.column(i) for i in range(3)), strict=True):
                wanted = [b for b in blocks.as_py() or [] if (b["type"] not in NOT_EXTRACTED if kinds is None else b["type"] in kinds)]
                page = page.as_py()
                if wanted:
                    try:
                        pixels = P.fitted(P.opened(data.as_py() or b""), MOST_PIXELS)
                    except P.Undecodable as e:
                        rows.append((page, None, None, None, None, None, _reason(e)))
                        wanted = []
                for b in wanted:
                    part = P.cut_out(pixels, b["bbox"], b["angle"])
                    if part is not None:
                        part = P.framed(part) if frame else part
                        rows.append((page, b["idx"], b["type"], P.encoded(part), part.shape[1], part.shape[0], None))
                        size += len(rows[-1][3])
                        if size > HELD:
                            yield told(batch, rows)
                            rows, size = [], 0
            if rows:
                yield told(batch, rows)

    def told(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "idx", "type", "picture", "width", "height", "error"])

    return pages.select("page_id", image, "blocks").mapInArrow(run, f"page_id {key}, {out}")


def _cuts(data: bytes, blocks: list[dict], prompts: list[str | None]) -> Iterator[bytes | None]:
    """A page's cut-outs as PNG, one for each prompt, None for a block without a pixel."""
    pixels = P.fitted(P.opened(data), MOST_PIXELS)
    for b, p in zip(blocks, prompts, strict=True):
        if p is not None:
            part = P.cut_out(pixels, b["bbox"], b["angle"])
            yield None if part is None else P.encoded(P.framed(part))


def read_contents(pages: DataFrame, model: str = "stub", skip: list[str] | None = None, cut: bool = False) -> DataFrame:
    """Pages of read_layouts without their pictures, with `contents`: an answer for each block, null for types that
    aren't asked about, and the first error. The model gets the page's picture with each request, or with
    `cut` what is cut out of it (PNG only), and isn't asked about blocks without a pixel."""
    make, limits = _MODELS[model]
    asked = pages.withColumn("prompts", F.transform("blocks", lambda b: prompt_of(b["type"], skip)))
    names = [n for n in asked.columns if n not in ("image", "prompts", "error")]
    out = T.StructType([*(asked.schema[n] for n in names), T.StructField("contents", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model, make)
        for batch in batches:
            at = batch.schema.get_field_index
            images, prompts = batch.column(at("image")), batch.column(at("prompts")).to_pylist()
            errors = batch.column(at("error")).to_pylist()
            empty: set[tuple[int, int]] = set()  # blocks without a pixel, of pages by place

            def asked() -> Iterator[Request]:
                for i, (image, some) in enumerate(zip(images, prompts, strict=True)):
                    if not any(p is not None for p in some or []):
                        continue
                    data = image.as_py()  # one object for all of a page's requests
                    if not cut:
                        yield from ((data, p) for p in some if p is not None)
                        continue
                    wanted = [k for k, p in enumerate(some) if p is not None]
                    try:
                        parts = list(_cuts(data or b"", batch.column(at("blocks"))[i].as_py(), some))
                    except P.Undecodable as e:
                        errors[i] = errors[i] or _reason(e)
                        parts = [None] * len(wanted)
                    for k, part in zip(wanted, parts, strict=True):
                        if part is None:
                            empty.add((i, k))
                        else:
                            yield part, some[k]

            answered = list(ask(own, asked(), limits))  # by then it is known which blocks are empty
            answers, contents = iter(answered), []
            for i, some in enumerate(prompts):
                got = [next(answers) if p is not None and (i, k) not in empty else (None, None) for k, p in enumerate(some or [])]
                errors[i] = errors[i] or next((e for _, e in got if e), None)
                contents.append([x for x, _ in got] if some is not None else None)
            new = [pa.array(contents, pa.list_(pa.string())), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(at(n)) for n in names), *new], names=out.names)

    return asked.mapInArrow(run, out)


def read_pages(pages: DataFrame, layout_model: str = "stub", content_model: str | None = None, skip: list[str] | None = None, cut: bool = False) -> DataFrame:
    """Pages without pictures, with blocks, contents and error: both steps in one task each page, without a
    shuffle, checkpointed so that models are asked once whatever is made of their answers."""
    return kept(read_contents(read_layouts(pages, layout_model), content_model or layout_model, skip, cut))


def blocks_of_pages(read: DataFrame, lists: bool = True, paratext: bool = True) -> DataFrame:
    """Blocks of read_pages' rows (with width and height) with contents repaired, boxes in whole points and unwanted
    types left out: (page_id, idx, type, x0, y0, x1, y1, angle, content, bbox). Pages with an error have none."""
    both = F.transform(F.arrays_zip("blocks", "contents"), lambda x: F.struct(*(x["blocks"][c].alias(c) for c in ("idx", "type", "bbox", "angle")), x["contents"].alias("content")))
    each = read.where(F.col("error").isNull()).select("page_id", "width", "height", F.inline(both))
    points = G.to_pixels(F.col("bbox"), F.col("width"), F.col("height"))
    placed = layout.kept_blocks(repaired(each), lists, paratext)
    return placed.select("page_id", "idx", "type", *(F.get(points, F.lit(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))), "angle", "content", "bbox")


def extract(pages: DataFrame, layout_model: str = "stub", content_model: str | None = None, skip: list[str] | None = None, lists: bool = True, paratext: bool = True) -> DataFrame:
    """Blocks of pages (page_id, image, width, height) in two steps, layout and contents, as blocks_of_pages
    has them; a page that a model has no answer for fails the job."""
    read = read_pages(pages, layout_model, content_model, skip)
    return blocks_of_pages(read.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")))), lists, paratext)


def repaired(blocks: DataFrame, kind: str = "type", content: str = "content") -> DataFrame:
    """Blocks, batch or stream, with their contents repaired by type."""
    k, c = F.col(kind), F.col(content)
    formula = F.when(k == "equation", c)  # Python gets all rows, so it gets null for what is no formula
    return blocks.withColumn(content, F.when(k == "equation", equation(formula)).when(k == "text", inline_math(c)).when(k == "table", otsl_html(c)).otherwise(c))


def assembled(read: DataFrame, blocks: DataFrame, folder: str = "images") -> DataFrame:
    """(doc_id, document, markdown) of read pages (doc_id, page_idx, page_id, width, height) and their blocks.
    Pages without a block have no part in either; documents without any, no row."""
    info = assemble.pages(blocks, read.select("page_id", "width", "height"), folder).join(read.select("page_id", "doc_id", "page_idx"), "page_id")
    return assemble.documents(info)


def parse_documents(pages: DataFrame, layout_model: str = "stub", content_model: str | None = None, folder: str = "images", skip: list[str] | None = None, lists: bool = True, paratext: bool = True) -> DataFrame:
    """(doc_id, document, markdown) of pages (doc_id, page_idx, page_id, image, width, height): scan to
    result in one plan; a page that a model has no answer for fails the job (see engine for rejects)."""
    read = read_pages(pages, layout_model, content_model, skip)
    read = read.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))))
    return assembled(read, blocks_of_pages(read, lists, paratext), folder)


def kept(df: DataFrame) -> DataFrame:
    """The same rows as a reliable checkpoint, so that a lost executor doesn't cost them and nothing is
    computed again. A cluster names the folder in spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        root = context.getConf().get("spark.checkpoint.dir")
        if not root and (not context.master.startswith("local") or "cluster" in context.master):
            raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="quireworks-checkpoint-"))
    return df.checkpoint()
