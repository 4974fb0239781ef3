"""Whole pages from recognised blocks: figures, tables and code with their captions and footnotes, lists
with their items, loose members as text, all in reading order; as Markdown and as nested documents.

A page's blocks are gathered into one row, by the only shuffle; all that follows works on that row's
array. Blocks are (page_id, idx, type, x0, y0, x1, y1, angle, content[, image_path]) with whole points
as coordinates and idx distinct on a page. Null contents are empty. Blocks of unknown type go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import area, center_distance, contains, overlap_area
from ..functions.text import code_language, fold_title, half_width, joined_piece, once, strip, where_it, without_fence, without_language
from ..schema import PLAIN_TYPES

#: Families of two layers, and whether their captions and footnotes must lie beside the body.
FAMILIES = {"image": True, "table": True, "code": False}
#: Kinds that hold nothing to read, or hold it twice.
NO_PICTURES = ("image", "list", "seal", "char")
_SHOWN = [*PLAIN_TYPES, "title", "list", "page_number", "aside_text", "page_footnote", "seal", "char"]


def _box(x: Column) -> list[Column]:
    return [x[c] for c in ("x0", "y0", "x1", "y1")]


def _apart(blocks: Column) -> Column:
    """Blocks that lie in no other one of them; equal boxes contain each other."""
    return once(blocks, lambda all_: F.filter(all_, lambda x: ~F.exists(all_, lambda y: (x["idx"] != y["idx"]) & contains(_box(y), _box(x)))))


def _nearest(x: Column, bodies: Column) -> Column:
    """Index of the body next to a block: in order, then by centres, then the first."""
    rank = F.transform(bodies, lambda b: F.struct(F.abs(b["idx"] - x["idx"]).alias("a"), F.round(center_distance(_box(x), _box(b)), 9).alias("b"), b["idx"].alias("idx")))
    return F.array_min(rank)["idx"]


def _run(members: Column, body: Column, down: bool) -> Column:
    """Sorted members of a body up to the first gap; captions (down) count from the highest index, and
    the body's own place is no gap among them."""
    place = (lambda i: F.when(i < body, i + 1).otherwise(i)) if down else (lambda i: i)
    ordered = F.sort_array(members, asc=not down)
    return once(ordered, lambda m: F.filter(m, lambda i, j: place(i) == place(F.get(m, F.lit(0))) + (-j if down else j)))


def _members(bodies: Column, captions: Column, footnotes: Column, kind: str, beside: bool) -> Column:
    """(idx, top, owner, part) of all parts of a family."""
    tied = lambda rows: F.transform(rows, lambda x: F.struct(x["idx"].alias("idx"), _nearest(x, bodies).alias("top")))

    def moved(pairs: Column) -> Column:
        """Footnotes before their body go to the nearest other body before them; else they are loose."""
        before = lambda p: F.array_max(F.transform(F.filter(bodies, lambda b: (b["idx"] <= p["idx"]) & (b["idx"] != p["top"])), lambda b: b["idx"]))
        return F.transform(pairs, lambda p: F.struct(p["idx"].alias("idx"), F.when(p["idx"] >= p["top"], p["top"]).otherwise(before(p)).alias("top")))

    def parts(body: Column, pairs: Column, part: str) -> Column:
        own = F.transform(F.filter(pairs, lambda p: p["top"] == body["idx"]), lambda p: p["idx"])
        return F.transform(_run(own, body["idx"], part == "caption") if beside else own, lambda i: member(i, body, part))

    def member(i: Column, body: Column, part: str) -> Column:
        return F.struct(i.alias("idx"), body["idx"].alias("top"), F.lit(kind).alias("owner"), F.lit(part).alias("part"))

    def all_parts(caps: Column, notes: Column) -> Column:
        return F.flatten(F.transform(bodies, lambda b: F.concat(F.array(member(b["idx"], b, "body")), parts(b, caps, "caption"), parts(b, notes, "footnote"))))

    notes = moved(tied(footnotes)) if beside else tied(footnotes)
    return once(F.struct(tied(captions).alias("c"), notes.alias("n")), lambda t: all_parts(t["c"], t["n"]))


def page_rows(blocks: DataFrame) -> DataFrame:
    """(page_id, rows): each block that belongs to the page, in order, with the paragraph it is part of:
    top, kind, part (body, caption, footnote, item; self for what stands alone, and for lists), type,
    sub_type, language, text and piece, as it is joined to its paragraph.

    Captions and footnotes that no body takes, and bodies inside others, become text paragraphs; text
    in lists leaves the running text, and lists without items go.
    """
    picture = "image_path" if "image_path" in blocks.columns else F.lit(None).cast("string").alias("image_path")
    family = F.when(F.col("type") == "algorithm", "code").otherwise(F.col("type"))
    block = F.struct("idx", family.alias("family"), "type", "x0", "y0", "x1", "y1", "angle", "content", picture)
    pages = blocks.select("page_id", block.alias("b")).groupBy("page_id").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    # What a lambda uses comes in by `once`: a column named inside one would be computed in each call.
    family_of = lambda bs, kind: _apart(F.filter(bs, lambda x: x["family"] == kind))

    def family(bs: Column, k: str, beside: bool) -> Column:
        three = F.struct(family_of(bs, k).alias("b"), family_of(bs, f"{k}_caption").alias("c"), family_of(bs, f"{k}_footnote").alias("n"))
        return once(three, lambda t: _members(t["b"], t["c"], t["n"], k, beside))

    def in_lists(bs: Column, lists: Column) -> Column:
        home = lambda x: F.array_min(F.transform(F.filter(lists, lambda s: (area(_box(x)) > 0) & (10 * overlap_area(_box(x), _box(s)) >= 8 * area(_box(x)))), lambda s: s["idx"]))
        texts = F.filter(bs, lambda x: x["type"].isin("text", "ref_text"))
        return F.filter(F.transform(texts, lambda x: F.struct(x["idx"].alias("idx"), home(x).alias("top"), F.lit("list").alias("owner"), F.lit("item").alias("part"), x["type"].alias("type"))), lambda x: x["top"].isNotNull())

    families = once(F.col("bs"), lambda bs: F.concat(*(family(bs, k, beside) for k, beside in FAMILIES.items())))
    items = once(F.col("bs"), lambda bs: once(F.filter(bs, lambda x: x["family"] == "list"), lambda lists: in_lists(bs, lists)))
    pages = pages.select("page_id", "bs", families.alias("families"), items.alias("items"))
    by_idx = F.map_from_entries(F.transform(F.concat("families", F.transform("items", lambda x: F.struct(x["idx"].alias("idx"), x["top"].alias("top"), x["owner"].alias("owner"), x["part"].alias("part")))), lambda x: F.struct(x["idx"].alias("key"), x.alias("value"))))
    pages = pages.select("page_id", "bs", "items", by_idx.alias("used"))
    loose = [f"{k}{p}" for k in FAMILIES for p in ("", "_caption", "_footnote")]

    def sub_type(x: Column, items: Column) -> Column:
        """The more frequent type of a list's items, texts if there are as many."""
        own = F.filter(items, lambda i: i["top"] == x["idx"])
        refs = F.filter(own, lambda i: i["type"] == "ref_text")
        return F.when(F.size(own) > 0, F.when(F.size(refs) * 2 > F.size(own), "ref_text").otherwise("text"))

    clean = lambda x: without_fence(F.coalesce(x["content"], F.lit("")))

    def row(x: Column, u: Column, items: Column) -> Column:
        code, body = x["family"] == "code", F.coalesce(u["part"] == "body", F.lit(False))
        own = F.when(x["family"].isin(loose), "text").when(x["type"] == "equation", "interline_equation").otherwise(x["type"])
        kind = F.when(u["owner"].isNull() | (u["part"] == "item"), own).when(body, F.concat(u["owner"], F.lit("_body"))).otherwise(x["type"])
        text = F.when(code, without_language(clean(x))).when(x["type"].isin("image", "table") & u["owner"].isNull(), F.lit(None)).otherwise(x["content"])
        return F.struct(
            x["idx"].alias("idx"), F.coalesce(u["top"], x["idx"]).alias("top"), F.coalesce(u["owner"], own).alias("kind"), F.coalesce(u["part"], F.lit("self")).alias("part"), kind.alias("type"),
            F.when(body & code, x["type"]).when(x["type"] == "list", sub_type(x, items)).alias("sub_type"), F.when(body & (x["type"] == "code"), code_language(clean(x))).alias("language"),
            F.array(*_box(x)).alias("bbox"), x["angle"].alias("angle"), text.alias("content"), x["image_path"].alias("image_path"),
        )

    def rows(e: Column) -> Column:
        return F.transform(e["bs"], lambda x: once(F.struct(F.try_element_at(e["used"], x["idx"]).alias("u")), lambda u: row(x, u["u"], e["items"])))

    shown = lambda r: r["kind"].isin([*FAMILIES, *_SHOWN]) & ((r["kind"] != "list") | (r["part"] == "item") | r["sub_type"].isNotNull())
    return pages.select("page_id", F.filter(once(F.struct("bs", "used", "items"), rows), shown).alias("rows"))


def _piece(kind: Column, content: Column) -> Column:
    """A block's text as it is joined to its paragraph."""
    text = half_width(F.when(kind == "title", fold_title(content)).otherwise(content))
    return F.when(kind == "interline_equation", strip(content)).otherwise(once(text, joined_piece))


_PART = ["idx", "part", "type", "sub_type", "language", "bbox", "angle", "content", "image_path"]


def page_paragraphs(blocks: DataFrame, drop: tuple[str, ...] = (), pieces: bool = True) -> DataFrame:
    """(page_id, paras): paragraphs of a page in order, each (top_idx, kind, sub_type, language, parts),
    parts in order of their index, in lists the list itself, then texts, then references. drop: kinds
    of paragraphs that are left out (NO_PICTURES for what can be read on). Without pieces parts have no
    text as it is joined, which Spark would make even where nothing reads it."""

    def part(r: Column) -> Column:
        late = F.when((r["kind"] == "list") & (r["type"] == "ref_text"), 1).when((r["kind"] == "list") & (r["part"] == "self"), -1).otherwise(0)
        return F.struct(late.alias("late"), *(r[n].alias(n) for n in _PART), *([_piece(r["type"], F.coalesce(r["content"], F.lit(""))).alias("piece")] if pieces else []))

    def para(rows: Column, top: Column) -> Column:
        own = F.filter(rows, lambda r: r["top"] == top)
        first = lambda rows, name: F.array_max(F.transform(rows, lambda r: r[name]))
        return once(own, lambda rows: F.struct(top.alias("top_idx"), F.get(rows, F.lit(0))["kind"].alias("kind"), first(rows, "sub_type").alias("sub_type"), first(rows, "language").alias("language"), F.array_sort(F.transform(rows, part)).alias("parts")))

    tops = lambda rows: F.array_sort(F.array_distinct(F.transform(rows, lambda r: r["top"])))
    paras = once(F.col("rows"), lambda rows: F.transform(tops(rows), lambda top: para(rows, top)))
    rows = page_rows(blocks).select("page_id", F.filter("rows", lambda r: ~r["kind"].isin(list(drop))).alias("rows")) if drop else page_rows(blocks)
    return rows.select("page_id", where_it(paras, lambda x: F.size(x) > 0).alias("paras"))


def paragraphs(blocks: DataFrame, pieces: bool = True) -> DataFrame:
    """(page_id, top_idx, kind, sub_type, language, parts) of each paragraph."""
    return page_paragraphs(blocks, pieces=pieces).select("page_id", F.inline("paras"))


def _joined(parts: Column, part: str, f) -> Column:
    return F.concat_ws("", F.transform(F.filter(parts, lambda x: x["part"] == part), f))


def paragraph_markdown(para: Column, folder: str = "") -> Column:
    """Markdown of a paragraph; empty for what isn't shown."""
    p, kind = para["parts"], para["kind"]
    link = lambda x: F.when(F.coalesce(x["image_path"], F.lit("")) != "", F.concat(F.lit(f"![]({folder}/"), x["image_path"], F.lit(")"))).otherwise(F.lit(""))
    above = _joined(p, "caption", lambda x: F.concat(x["piece"], F.lit("  \n")))
    table = _joined(p, "body", lambda x: F.when(F.coalesce(x["content"], F.lit("")) != "", F.concat(F.lit("\n"), x["content"], F.lit("\n"))).otherwise(link(x)))
    code = _joined(p, "body", lambda x: F.when(para["sub_type"] == "code", F.concat(F.lit("```"), para["language"], F.lit("\n"), x["piece"], F.lit("\n```"))).otherwise(x["piece"]))
    picture = _joined(p, "body", link)
    first = F.get(p, F.lit(0))
    return strip(
        F.when((kind == "image") & F.exists(p, lambda x: x["part"] == "footnote"), F.concat(above, picture, _joined(p, "footnote", lambda x: F.concat(F.lit("  \n"), x["piece"]))))
        .when(kind == "image", F.concat(picture, _joined(p, "caption", lambda x: F.concat(F.lit("  \n"), x["piece"]))))
        .when(kind == "table", F.concat(above, table, _joined(p, "footnote", lambda x: F.concat(F.lit("\n"), x["piece"], F.lit("  ")))))
        .when(kind == "code", F.concat(above, code))
        .when(kind == "list", _joined(p, "item", lambda x: F.concat(x["piece"], F.lit("  \n"))))
        .when(kind == "title", F.concat(F.lit("# "), first["piece"]))
        .when((kind == "char") & (F.length(first["content"]) > 5), first["content"])
        .when(kind.isin(PLAIN_TYPES), first["piece"])
        .otherwise(F.lit(""))
    )


def _span(x: Column) -> Column:
    kind = F.when(x["type"].isin("image_body", "table_body"), F.replace(x["type"], F.lit("_body"), F.lit(""))).when(x["type"].isin("interline_equation", "seal", "char"), x["type"]).otherwise(F.lit("text"))
    html, picture = x["type"] == "table_body", x["type"].isin("image_body", "seal", "char")
    title = F.when(x["type"] == "title", fold_title(x["content"])).otherwise(x["content"])
    return F.struct(x["bbox"].alias("bbox"), kind.alias("type"), F.when(~html & (x["type"] != "image_body"), title).alias("content"), F.when(html, x["content"]).alias("html"), F.when(picture, x["image_path"]).alias("image_path"))


def _block(x: Column) -> list[Column]:
    return [x["bbox"].alias("bbox"), x["type"].alias("type"), x["angle"].alias("angle"), F.array(F.struct(x["bbox"].alias("bbox"), F.array(_span(x)).alias("spans"))).alias("lines")]


def _info(para: Column, i: Column) -> Column:
    """A paragraph with its lines and spans, or with its blocks' lines and spans."""
    kind, parts = para["kind"], para["parts"]
    nested = kind.isin([*FAMILIES, "list"])
    inner = F.filter(parts, lambda x: (kind != "list") | (x["part"] == "item"))

    def made(lead: Column) -> Column:
        lines = F.array(F.struct(lead["bbox"].alias("bbox"), F.array(_span(lead)).alias("spans")))
        return F.struct(
            i.alias("index"), kind.alias("type"), lead["bbox"].alias("bbox"), F.when(~nested | (kind == "list"), lead["angle"]).alias("angle"), para["sub_type"].alias("sub_type"), para["language"].alias("guess_lang"),
            F.when(~nested, lines).alias("lines"), F.when(nested, F.transform(inner, lambda x: F.struct(x["idx"].alias("index"), *_block(x)))).alias("blocks"),
        )

    return once(F.get(F.filter(parts, lambda x: x["part"].isin("body", "self")), F.lit(0)), made)


def _sized(rows: DataFrame, sizes: DataFrame | None) -> tuple[DataFrame, Column]:
    """Pages' paragraphs with their sizes, and the info of such a row."""
    if sizes is not None:
        rows = rows.join(sizes, "page_id", "left")
    size = F.array(*(F.coalesce(F.col(c) if sizes is not None else F.lit(None), F.lit(1000)) for c in ("width", "height")))
    return rows, F.struct(F.transform("paras", _info).alias("para_blocks"), F.array().cast("array<string>").alias("discarded_blocks"), size.alias("page_size"))


def pages(blocks: DataFrame, sizes: DataFrame | None = None, folder: str = "", drop: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, markdown, info) of pages. markdown: shown paragraphs in order, an empty line between,
    empty without any. info: paragraphs numbered in order; sizes: (page_id, width, height), else 1000 by
    1000."""
    rows, info = _sized(page_paragraphs(blocks, drop), sizes)
    text = F.array_join(F.filter(F.transform("paras", lambda x: paragraph_markdown(x, folder)), lambda x: x != ""), "\n\n")
    return rows.select("page_id", text.alias("markdown"), info.alias("info"))


def markdown(blocks: DataFrame, folder: str = "") -> DataFrame:
    """(page_id, markdown) of the pages that show anything."""
    return pages(blocks, folder=folder).select("page_id", where_it(F.col("markdown"), lambda x: x != "").alias("markdown"))


def page_info(blocks: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    rows, info = _sized(page_paragraphs(blocks, pieces=False), sizes)
    return rows.select("page_id", info.alias("info"))


def documents(pages: DataFrame, key: str = "doc_id", order: str = "page_idx", version: str = "1.0.0") -> DataFrame:
    """(key, document[, markdown]): one JSON document of each group of pages (key, order, info), in their
    order, and the text of pages that have markdown, an empty line between."""
    rows = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in ("info", "markdown") if c in pages.columns)))).alias("p"))
    info = F.transform("p", lambda x: F.struct(*(x["info"][n].alias(n) for n in ("para_blocks", "discarded_blocks", "page_size")), x[order].alias("page_idx")))
    out = [F.to_json(F.struct(info.alias("pdf_info"), F.lit("vlm").alias("_backend"), F.lit(version).alias("_version_name"))).alias("document")]
    if "markdown" in pages.columns:
        out.append(F.array_join(F.filter(F.transform("p", lambda x: x["markdown"]), lambda x: x != ""), "\n\n").alias("markdown"))
    return rows.select(key, *out)
