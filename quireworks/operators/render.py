"""What is drawn or cut out of a page: figures' text, paths of pictures, labels of overlays."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import parts
from ..functions.pdf import BROKEN, opened
from ..functions.text import strip


def figure_text(content: Column) -> Column:
    """Markdown of a scientific figure's text; empty if it has up to five characters."""
    return strip(F.when(F.length(content) > 5, content).otherwise(F.lit("")))


def image_path(kind: Column, digest: Column, page: Column, box: Column) -> Column:
    """Path of a cut-out picture; empty if the box has no area."""
    name = F.format_string("%s/%s_%d_%d_%d_%d_%d.jpeg", kind, digest, page, *(F.get(box, F.lit(k)) for k in range(4)))
    return F.when((F.get(box, F.lit(0)) < F.get(box, F.lit(2))) & (F.get(box, F.lit(1)) < F.get(box, F.lit(3))), name).otherwise(F.lit(""))


def overlay_labels(blocks: DataFrame) -> DataFrame:
    """(page_id, idx, label): the number and angle that an overlay shows for each block."""
    from .structure import reading_order

    return reading_order(blocks).select("page_id", "idx", F.concat((F.col("order") + 1).cast("string"), F.lit("+"), F.coalesce("angle", F.lit(0)).cast("string")).alias("label"))


def overlay_spans(blocks: DataFrame) -> DataFrame:
    """(page_id, idx, kind, bbox) of the spans that an overlay draws, by what they hold; seals, figures
    and blocks that aren't read have none."""
    kind = F.when(F.col("type") == "equation", "interline_equation").when(F.col("type").isin("image", "table"), F.col("type")).when(~F.col("type").isin("equation_block", "unknown", "seal", "char", "list"), "text")
    return blocks.select("page_id", "idx", kind.alias("kind"), F.array("x0", "y0", "x1", "y1").alias("bbox")).where("kind is not null")


# Colours of overlays by kind of block; others are grey.
COLOURS = {"text": "#b4d2ff", "title": "#6666ff", "image": "#99ff33", "table": "#cccc00", "list": "#28a95c", "code": "#6600cc", "interline_equation": "#00ff00", "equation": "#00ff00"}


def overlay_svg(blocks: DataFrame, width: int = 1000, height: int = 1000, filled: bool = True, numbered: bool = True) -> DataFrame:
    """(page_id, svg): a drawing to lay over each page: a box for each block in reading order, filled or
    as a frame, with its number if asked for. Vector text in place of a stamped document."""
    from .structure import reading_order

    colour = F.lit("#9e9e9e")
    for kind, own in COLOURS.items():
        colour = F.when(F.col("type") == kind, own).otherwise(colour)
    style = F.concat(F.lit("fill:"), colour, F.lit(";fill-opacity:0.3")) if filled else F.concat(F.lit("fill:none;stroke:"), colour)
    x, y, w, h = F.col("x0").cast("int"), F.col("y0").cast("int"), (F.col("x1") - F.col("x0")).cast("int"), (F.col("y1") - F.col("y0")).cast("int")
    rect = F.concat(F.format_string('<rect x="%d" y="%d" width="%d" height="%d" style="', x, y, w, h), style, F.lit('"/>'))
    label = F.format_string('<text x="%d" y="%d">%d</text>', F.col("x1").cast("int"), y, F.col("order") + 1) if numbered else F.lit("")
    parts = reading_order(blocks).select("page_id", F.struct("order", F.concat(rect, label).alias("part")).alias("p")).groupBy("page_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">'
    return parts.select("page_id", F.concat(F.lit(head), F.array_join(F.transform("ps", lambda p: p["part"]), ""), F.lit("</svg>")).alias("svg"))


def _rgb(colour: str) -> str:
    return " ".join(f"{int(colour[i : i + 2], 16) / 255:.3f}" for i in (1, 3, 5))


def with_overlays(files: DataFrame, drawings: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Files (key, content, ...) with `content` updated by drawings (key, page, operators), and `error`, why that can't be
    done; pages that a file doesn't have are left out. Drawings meet their file in one row, by one shuffle."""
    out = T.StructType([*(f for f in files.schema if f.name != "error"), T.StructField("error", T.StringType())])
    names = out.names[:-1]
    each = drawings.groupBy(key).agg(F.collect_list(F.struct("page", "operators")).alias("_drawn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in parts(batch, content)):
            at = batch.schema.get_field_index
            data, errors = [], []
            for x, drawn in zip(batch.column(at(content)).to_pylist(), batch.column(at("_drawn")).to_pylist(), strict=True):
                why = None
                if drawn:
                    pdf, why = opened(x)
                    try:
                        x = pdf.with_drawings({d["page"]: d["operators"].encode() for d in drawn if 0 <= d["page"] < len(pdf)}) if pdf else x
                    except BROKEN as e:
                        why = str(e)
                data.append(x)
                errors.append(why)
            cols = [pa.array(data, pa.binary()) if n == content else batch.column(at(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(errors, pa.string())], names=out.names)

    return files.select(*names).join(each, key, "left").mapInArrow(run, out)


def overlay_operators(blocks: DataFrame, filled: bool = True, numbered: bool = True) -> DataFrame:
    """(page_id, operators): what overlay_svg draws, as drawing operators for the update of a PDF file."""
    from .structure import reading_order

    fill, grey = F.lit(_rgb("#9e9e9e")), "#9e9e9e"
    for kind, own in {**COLOURS, "": grey}.items():
        fill = F.when(F.col("type") == kind, _rgb(own)).otherwise(fill)
    x, y, w, h = F.col("x0").cast("int"), F.col("y0").cast("int"), (F.col("x1") - F.col("x0")).cast("int"), (F.col("y1") - F.col("y0")).cast("int")
    box = F.format_string("%d %d %d %d re", x, y, w, h)
    drawn = F.concat(F.lit("/QwG gs "), fill, F.lit(" rg "), box, F.lit(" f")) if filled else F.concat(fill, F.lit(" RG "), box, F.lit(" S"))
    label = F.format_string(" BT 1 0 0 rg /QwF 10 Tf 1 0 0 -1 %d %d Tm (%d) Tj ET", F.col("x1").cast("int") + 2, y + 10, F.col("order") + 1) if numbered else F.lit("")
    parts = reading_order(blocks).select("page_id", F.struct("order", F.concat(F.lit("q "), drawn, label, F.lit(" Q")).alias("part")).alias("p"))
    return parts.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), " ").alias("operators"))
