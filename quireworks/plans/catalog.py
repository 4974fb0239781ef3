"""All queries by name, and SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import latex as L
from ..functions import pixels, runs
from ..functions import tables as TB
from ..functions import text as X
from ..operators import assemble, inference, layout, render, structure, suppress
from ..schema import FREQUENCY_PENALTY, NOT_EXTRACTED, PARATEXT, PROMPTS
from ..sources import derived as D
from ..sources import pages, scans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with SQL over the derived relations."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = D.SQL + sql
        return f

    return add


_BOX = ("x0", "y0", "x1", "y1")
_IN = lambda a, b: f"({b}.x0 >= {a}.x0 AND {b}.y0 >= {a}.y0 AND {b}.x1 <= {a}.x1 AND {b}.y1 <= {a}.y1)"
_MEET = lambda a, b: f"(greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0) * greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0))"
_AREA = lambda a: f"(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))"
_KIND = "CASE WHEN {0}.type = 'algorithm' THEN 'code' ELSE {0}.type END"
_WHITE = "".join(f"\\x{{{ord(c):X}}}" for c in X.WHITE)
_STRIP = lambda c: f"regexp_replace({c}, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g')"


def _alone(kind: str, codes: bool = False) -> str:
    own = lambda t: f"{_KIND.format(t)} = 'code'" if codes and kind == "code" else f"{t}.type = '{kind}'"
    return f"SELECT a.* FROM blocks a WHERE {own('a')} AND NOT EXISTS (SELECT 1 FROM blocks b WHERE {own('b')} AND b.page_id = a.page_id AND b.idx <> a.idx AND {_IN('b', 'a')})"


def _nearest(sub: str, obj: str) -> str:
    return f"""
  (SELECT page_id, obj_idx, sub_idx FROM (
    SELECT o.page_id, o.idx AS obj_idx, s.idx AS sub_idx, row_number() OVER (PARTITION BY o.page_id, o.idx ORDER BY abs(o.idx - s.idx),
      round(sqrt(((o.x0 + o.x1) / 2.0 - (s.x0 + s.x1) / 2.0) ** 2 + ((o.y0 + o.y1) / 2.0 - (s.y0 + s.y1) / 2.0) ** 2), 9), s.idx) AS r
    FROM ({_alone(obj, True)}) o JOIN ({_alone(sub, True)}) s ON o.page_id = s.page_id) WHERE r = 1)"""


_CAPTIONS = f", captions AS {_nearest('image', 'image_caption')}"
_NOTES = f", notes AS {_nearest('table', 'table_footnote')}"


@query(""", lines AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY idx) - 1 AS idx, type,
    [x0, y0, x1, y1] AS p, angle FROM blocks WHERE idx % 17 <> 0 AND idx % 19 <> 0)
  SELECT page_id, CAST(idx AS INTEGER) AS idx, type, list_transform(p, lambda v: v / 1000.0) AS bbox, angle FROM lines""")
def layout_parse(spark, d):
    return layout.parse_layout(D.layout_text(spark, d))


@query(" SELECT page_id, idx, CAST(trunc(x0 / 1000.0::DOUBLE * 595) AS INTEGER) AS px0, CAST(trunc(y0 / 1000.0::DOUBLE * 842) AS INTEGER) AS py0, CAST(trunc(x1 / 1000.0::DOUBLE * 595) AS INTEGER) AS px1, CAST(trunc(y1 / 1000.0::DOUBLE * 842) AS INTEGER) AS py1 FROM blocks")
def bbox_scale(spark, d):
    p = G.to_pixels(F.array(*(F.col(c) / F.lit(1000.0) for c in _BOX)), F.lit(595), F.lit(842))
    return D.blocks(spark, d).select("page_id", "idx", *(F.get(p, F.lit(k)).alias(f"p{c}") for k, c in enumerate(_BOX)))


@query(f" SELECT page_id, idx, type FROM blocks WHERE type NOT IN ('image', 'list', 'equation_block', {', '.join(map(repr, PARATEXT))})")
def skip_filter(spark, d):
    return layout.kept_blocks(layout.to_extract(D.blocks(spark, d)), paratext=False).select("page_id", "idx", "type")


@query(f""", prompts(type, prompt) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in PROMPTS.items() if k != 'default')})
  SELECT page_id, idx, b.type AS type, coalesce(prompt, '{PROMPTS['default']}') AS prompt FROM blocks b LEFT JOIN prompts p ON b.type = p.type""")
def prompt_lookup(spark, d):
    return layout.requests(D.blocks(spark, d)).select("page_id", "idx", "type", "prompt")


@query(f" SELECT page_id, idx, type FROM blocks a WHERE type IN ('image', 'table', 'image_caption') AND NOT EXISTS (SELECT 1 FROM blocks b WHERE b.page_id = a.page_id AND b.type IN ('image', 'table', 'image_caption') AND b.idx <> a.idx AND {_IN('b', 'a')})")
def containment_antijoin(spark, d):
    return structure.without_contained(D.blocks(spark, d).where("type in ('image', 'table', 'image_caption')")).select("page_id", "idx", "type")


@query(_CAPTIONS + " SELECT page_id, obj_idx, sub_idx FROM captions")
def nearest_caption(spark, d):
    return structure.attach(D.blocks(spark, d), "image", "caption")


_MOVED = _NOTES + f""", bodies AS ({_alone('table')}), moved AS (
  SELECT page_id, obj_idx, sub_idx FROM notes WHERE obj_idx > sub_idx UNION ALL
  SELECT n.page_id, n.obj_idx, max(b.idx) FROM notes n LEFT JOIN bodies b ON b.page_id = n.page_id AND b.idx <= n.obj_idx AND b.idx <> n.sub_idx
  WHERE n.obj_idx < n.sub_idx GROUP BY n.page_id, n.obj_idx)"""


@query(_MOVED + " SELECT page_id, obj_idx, sub_idx FROM moved")
def misplaced_footnote_asof(spark, d):
    b = D.blocks(spark, d)
    return structure.reassign_footnotes(structure.attach(b, "table", "footnote"), structure.without_contained(b.where("type = 'table'")))


def _runs(rel: str, down: bool) -> str:
    order = "DESC" if down else "ASC"
    gap = "prev - idx" if down else "idx - prev"
    broken = f"{gap} <> 1" + (f" AND NOT ({gap} = 2 AND sub_idx = idx + 1)" if down else "")
    return f"""(SELECT page_id, sub_idx, idx, sum(CASE WHEN prev IS NOT NULL AND {broken} THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, sub_idx ORDER BY idx {order} ROWS UNBOUNDED PRECEDING) = 0 AS kept
      FROM (SELECT page_id, sub_idx, obj_idx AS idx, lag(obj_idx) OVER (PARTITION BY page_id, sub_idx ORDER BY obj_idx {order}) AS prev FROM {rel}))"""


@query(_CAPTIONS + f" SELECT page_id, sub_idx, idx, kept FROM {_runs('captions', True)}")
def caption_runs(spark, d):
    return structure.contiguous(structure.attach(D.blocks(spark, d), "image", "caption").withColumnRenamed("obj_idx", "idx"), True)


_LISTS = f""", members AS (SELECT t.page_id, t.idx, t.type, min(s.idx) AS list_idx FROM blocks t JOIN blocks s ON t.page_id = s.page_id AND s.type = 'list'
  WHERE t.type IN ('text', 'ref_text') AND 10 * {_MEET('t', 's')} >= 8 * {_AREA('t')} GROUP BY ALL)"""


@query(_LISTS + " SELECT page_id, idx, type, list_idx FROM members")
def list_membership(spark, d):
    return structure.list_members(D.blocks(spark, d))


@query(_LISTS + """ SELECT page_id, list_idx, type AS sub_type FROM (SELECT *, row_number() OVER (PARTITION BY page_id, list_idx ORDER BY n DESC, type DESC) AS r
  FROM (SELECT page_id, list_idx, type, count(*) AS n FROM members GROUP BY ALL)) WHERE r = 1""")
def list_subtype_mode(spark, d):
    return structure.list_subtypes(structure.list_members(D.blocks(spark, d)))


@query(_CAPTIONS + """ SELECT b.page_id, b.idx, CASE WHEN b.type = 'image_caption' AND c.obj_idx IS NULL THEN 'text' ELSE b.type END AS type
  FROM blocks b LEFT JOIN captions c ON c.page_id = b.page_id AND c.obj_idx = b.idx""")
def orphan_to_text(spark, d):
    b = D.blocks(spark, d)
    return structure.orphans_to_text(b, structure.attach(b, "image", "caption"), ["image_caption"]).select("page_id", "idx", "type")


@query(""" SELECT page_id, idx, type, CAST(row_number() OVER (PARTITION BY page_id ORDER BY idx) - 1 AS INTEGER) AS "order" FROM blocks WHERE type <> 'equation_block'""")
def reading_order(spark, d):
    return structure.reading_order(layout.kept_blocks(D.blocks(spark, d))).select("page_id", "idx", "type", "order")


@query(f"""{_MOVED}, caps AS {_nearest('table', 'table_caption')}, parts AS (
  SELECT page_id, idx AS sub_idx, idx, 'body' AS part FROM bodies UNION ALL
  SELECT page_id, sub_idx, idx, 'caption' FROM {_runs('caps', True)} WHERE kept UNION ALL
  SELECT page_id, sub_idx, idx, 'footnote' FROM {_runs('(SELECT * FROM moved WHERE sub_idx IS NOT NULL)', False)} WHERE kept)
  SELECT page_id, sub_idx, count(*) FILTER (part = 'caption') AS captions, count(*) FILTER (part = 'footnote') AS footnotes, string_agg(idx || ':' || part, ',' ORDER BY idx, part) AS children FROM parts GROUP BY page_id, sub_idx""")
def two_layer_blocks(spark, d):
    return structure.two_layer(D.blocks(spark, d), "table")


def _pairs(spark, d):
    b = D.blocks(spark, d)
    return structure._side(b, "a_", "idx", *_BOX).join(structure._side(b, "b_", "idx", *_BOX), "page_id").where("a_idx < b_idx")


_PAIRS = " FROM blocks a JOIN blocks b ON a.page_id = b.page_id AND a.idx < b.idx"


@query(f""" SELECT a.page_id, a.idx AS a_idx, b.idx AS b_idx, round({_MEET('a', 'b')} / ({_AREA('a')} + {_AREA('b')} - {_MEET('a', 'b')})::DOUBLE, 6) AS iou,
  round({_MEET('a', 'b')} / least({_AREA('a')}, {_AREA('b')})::DOUBLE, 6) AS of_smaller, round({_MEET('a', 'b')} / {_AREA('a')}::DOUBLE, 6) AS of_first {_PAIRS} WHERE {_MEET('a', 'b')} > 0""")
def pairwise_iou(spark, d):
    a, b = G.box("a_"), G.box("b_")
    p = _pairs(spark, d).where(G.overlaps(a, b))
    return p.select("page_id", "a_idx", "b_idx", F.round(G.iou(a, b), 6).alias("iou"), F.round(G.overlap_of_smaller(a, b), 6).alias("of_smaller"), F.round(G.overlap_of_first(a, b), 6).alias("of_first"))


@query(f""" SELECT a.page_id, a.idx AS a_idx, b.idx AS b_idx, round(sqrt(greatest(b.x0 - a.x1, a.x0 - b.x1, 0) ** 2 + greatest(b.y0 - a.y1, a.y0 - b.y1, 0) ** 2), 6) AS gap,
  b.x1 < a.x0 AS "left", a.x1 < b.x0 AS "right", b.y1 < a.y0 AS bottom, a.y1 < b.y0 AS top {_PAIRS}""")
def box_distance(spark, d):
    a, b = G.box("a_"), G.box("b_")
    return _pairs(spark, d).select("page_id", "a_idx", "b_idx", F.round(G.distance(a, b), 6).alias("gap"), G.relative(a, b).alias("r")).select("page_id", "a_idx", "b_idx", "gap", "r.*")


@query(f" SELECT a.page_id, a.idx AS a_idx, b.idx AS b_idx, round(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) / (a.x1 - a.x0)::DOUBLE, 6) AS share {_PAIRS}")
def projection_overlap(spark, d):
    return _pairs(spark, d).select("page_id", "a_idx", "b_idx", F.round(G.column_overlap(G.box("a_"), G.box("b_")), 6).alias("share"))


@query(f""", t AS (SELECT * FROM stacked_tables WHERE page_id IN (SELECT page_id FROM stacked_tables GROUP BY 1 HAVING count(*) >= 3)),
  held AS (SELECT a.page_id, a.idx AS idx, {_AREA('a')} AS own, b.idx AS bi, b.x0, b.y0, b.x1, b.y1 FROM t a JOIN t b ON a.page_id = b.page_id AND a.idx <> b.idx AND 10 * {_MEET('a', 'b')} >= 8 * {_AREA('b')})
  SELECT page_id, idx FROM held h GROUP BY page_id, idx HAVING count(*) >= 3 AND 10 * sum({_AREA('h')}) > 8 * min(own)
  AND NOT EXISTS (SELECT 1 FROM held x JOIN held y ON x.page_id = y.page_id AND x.idx = y.idx AND x.bi < y.bi AND {_MEET('x', 'y')} > 0 WHERE x.page_id = h.page_id AND x.idx = h.idx)""")
def nested_table_filter(spark, d):
    return structure.nested_tables(D.stacked_tables(spark, d))


@query()
def greedy_match(spark, d):
    b = D.blocks(spark, d)
    return structure.match_greedily(b.where("type = 'image'"), b.where("type = 'image_caption'"))


@query()
def suppressed_boxes(spark, d):
    return suppress.suppress(D.detections(spark, d))


@query(f""" SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND b <> '' THEN a || '$ x $' || b || '$' ELSE
    a || CASE WHEN a = '' OR regexp_matches(right(a, 1), '[{_WHITE}]') THEN '' ELSE ' ' END || '$x$' || CASE WHEN b = '' OR regexp_matches(left(b, 1), '[{_WHITE}]') THEN '' ELSE ' ' END || b END AS content,
  CAST(CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 2 END AS INTEGER) AS dollars FROM split_math""")
def inline_math(spark, d):
    return D.text_math(spark, d).select("doc_id", L.inline_math(F.col("content")).alias("content"), F.regexp_count("content", F.lit(r"\$")).alias("dollars"))


@query(r""" SELECT p_partkey, CASE WHEN p_partkey % 8 = 1 THEN '$' || split_part(latex, ' ', 1) || '$ ' || split_part(latex, ' ', 2) WHEN p_partkey % 8 = 2 THEN '$y=f$ (x)'
  WHEN p_partkey % 8 = 0 THEN '$$' || substr(latex, 3, len(latex) - 4) || '$$' ELSE '$$' || replace(replace(trim(latex), '%', '\%'), ' tag{', ' \tag{') || '$$' END AS latex FROM equations""")
def equation_basic(spark, d):
    return D.equations(spark, d).select("p_partkey", L.escape_percent(L.wrap_display(L.strip_brackets(F.col("latex")))).alias("latex"))


@query()
def equation_stack(spark, d):
    return D.equations(spark, d).select("p_partkey", L.equation(F.col("latex")).alias("latex"), L.count_left(F.col("latex")).alias("lefts"), L.count_right(F.col("latex")).alias("rights"))


@query(r" SELECT p_partkey, replace(replace(replace(latex, '≤', '\leq '), '×', '\times '), '→', '\rightarrow ') AS commands, replace(replace(replace(latex, '≤', '≤ '), '×', '× '), '→', '→ ') AS characters FROM equations")
def symbol_map(spark, d):
    e = D.equations(spark, d).select("p_partkey", L.to_latex(F.col("latex")).alias("commands"))
    return e.withColumn("characters", L.to_unicode(F.col("commands")))


_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
_WIDE_LETTERS, _LETTERS = X._WIDE(X._LETTERS), X._LETTERS


@query(f"""SELECT doc_id, translate(t, '{_WIDE_LETTERS}', '{_LETTERS}') AS letters, translate(t, '{_WIDE.replace("'", "''")}', '{X._VISIBLE.replace("'", "''")}') AS all_marks
  FROM (SELECT doc_id, translate(text, '{_LETTERS}.,', '{_WIDE_LETTERS}．，') AS t FROM documents)""")
def fullwidth(spark, d):
    wide = F.translate("text", _LETTERS + ".,", _WIDE_LETTERS + "．，")
    t = D.table(spark, d, "documents").select("doc_id", wide.alias("t"))
    return t.select("doc_id", X.half_width(F.col("t")).alias("letters"), X.half_width(F.col("t"), marks=True).alias("all_marks"))


@query(""", t AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY l_orderkey ORDER BY i) % 4 = 0, false) AS high FROM ranked_items)
  SELECT l_orderkey, '<table border="1">' || string_agg('<tr>' || CASE WHEN i % 3 = 0 THEN '<td colspan="2">' || l_returnflag || '</td>' ELSE '<td>' || l_returnflag || '</td><td>' || l_linestatus || '</td>' END ||
    CASE WHEN i % 4 = 0 THEN '' ELSE CASE WHEN high THEN '<td rowspan="2">' ELSE '<td>' END || l_linenumber || '</td>' END || '</tr>', '' ORDER BY i) || '</table>' AS html FROM t GROUP BY l_orderkey""")
def otsl_html(spark, d):
    return D.otsl_tables(spark, d).select("l_orderkey", TB.otsl_html(F.col("otsl")).alias("html"))


@query("""SELECT l_orderkey, CAST(i - 1 AS INTEGER) AS "row", 0 AS col, l_returnflag AS text, 1 AS row_span, 1 + CAST(i % 3 = 0 AS INTEGER) AS col_span FROM ranked_items UNION ALL
  SELECT l_orderkey, CAST(i - 1 AS INTEGER), 1, l_linestatus, 1, 1 FROM ranked_items WHERE i % 3 <> 0 UNION ALL
  SELECT a.l_orderkey, CAST(a.i - 1 AS INTEGER), 2, CAST(a.l_linenumber AS VARCHAR), 1 + CAST(b.i IS NOT NULL AS INTEGER), 1 FROM ranked_items a LEFT JOIN ranked_items b ON a.l_orderkey = b.l_orderkey AND b.i = a.i + 1 AND b.i % 4 = 0 WHERE a.i % 4 <> 0""")
def otsl_cells(spark, d):
    return TB.otsl_cells(D.otsl_tables(spark, d), "l_orderkey", "otsl")


def _family(kind: str, beside: bool) -> tuple[str, str]:
    """Relations of a family's members, and its parts."""
    body, caps, notes = f"{kind}_bodies", f"{kind}_caps", f"{kind}_notes"
    made = f""", {body} AS ({_alone(kind, True)}), {caps} AS {_nearest(kind, kind + '_caption')}, {notes} AS {_nearest(kind, kind + '_footnote')}, {kind}_moved AS (
      SELECT page_id, obj_idx, sub_idx FROM {notes} WHERE obj_idx > sub_idx UNION ALL
      SELECT n.page_id, n.obj_idx, max(b.idx) FROM {notes} n LEFT JOIN {body} b ON b.page_id = n.page_id AND b.idx <= n.obj_idx AND b.idx <> n.sub_idx WHERE n.obj_idx < n.sub_idx GROUP BY n.page_id, n.obj_idx)"""
    in_run = lambda rel, down: f"SELECT page_id, idx, sub_idx FROM {_runs(rel, down)} WHERE kept"
    captions = in_run(caps, True) if beside else f"SELECT page_id, obj_idx, sub_idx FROM {caps}"
    footnotes = in_run(f"(SELECT * FROM {kind}_moved WHERE sub_idx IS NOT NULL)", False) if beside else f"SELECT page_id, obj_idx, sub_idx FROM {notes}"
    rows = [f"SELECT page_id, idx, idx AS top, '{kind}' AS owner, 'body' AS part FROM {body}", *(f"SELECT *, '{kind}', '{part}' FROM ({q})" for part, q in (("caption", captions), ("footnote", footnotes)))]
    return made, " UNION ALL ".join(rows)


_FAMILY = [_family(k, beside) for k, beside in assemble.FAMILIES.items()]
_LOOSE = ", ".join(f"'{k}{p}'" for k in ("image", "table", "code", "algorithm") for p in ("", "_caption", "_footnote"))
_KINDS = ", ".join(f"'{k}'" for k in [*assemble.FAMILIES, *assemble._SHOWN])
_PAGE = f"""{_LISTS}{''.join(m for m, _ in _FAMILY)}, used AS ({' UNION ALL '.join(q for _, q in _FAMILY)}),
  subtypes AS (SELECT page_id, list_idx, CASE WHEN 2 * count(*) FILTER (type = 'text') >= count(*) THEN 'text' ELSE 'ref_text' END AS sub_type FROM members GROUP BY ALL),
  placed AS (SELECT b.page_id, b.idx, coalesce(u.top, m.list_idx, b.idx) AS top_idx, coalesce(u.owner, CASE WHEN m.list_idx IS NOT NULL THEN 'list' WHEN b.type IN ({_LOOSE}) THEN 'text' WHEN b.type = 'equation' THEN 'interline_equation' ELSE b.type END) AS kind,
    coalesce(u.part, CASE WHEN m.list_idx IS NOT NULL THEN 'item' ELSE 'self' END) AS part, b.type AS own, CASE WHEN u.part = 'body' AND u.owner = 'code' THEN b.type ELSE s.sub_type END AS sub_type,
    CASE WHEN b.type IN ('code', 'algorithm') THEN regexp_replace({_STRIP('b.content')}, '^<_.*?_>', '') WHEN b.type IN ('image', 'table') AND u.owner IS NULL THEN '' ELSE b.content END AS c, b.content
    FROM blocks b LEFT JOIN used u USING (page_id, idx) LEFT JOIN members m USING (page_id, idx) LEFT JOIN subtypes s ON s.page_id = b.page_id AND s.list_idx = b.idx),
  page AS (SELECT *, CASE WHEN part = 'item' AND own = 'ref_text' THEN 1 WHEN kind = 'list' AND part = 'self' THEN -1 ELSE 0 END AS late, {_STRIP("CASE WHEN own = 'title' THEN regexp_replace(c, chr(10) || '[" + _WHITE + "]*', ' ', 'g') ELSE c END")} AS t
    FROM placed WHERE kind IN ({_KINDS}) AND (kind <> 'list' OR part = 'item' OR sub_type IS NOT NULL))"""


@query(_PAGE + """ SELECT page_id, top_idx, kind, max(sub_type) AS sub_type, string_agg(idx || ':' || part, ',' ORDER BY late, idx) AS parts FROM page GROUP BY page_id, top_idx, kind""")
def page_paragraphs(spark, d):
    parts = F.array_join(F.transform("parts", lambda x: F.concat(x["idx"].cast("string"), F.lit(":"), x["part"])), ",")
    return assemble.paragraphs(D.blocks(spark, d), pieces=False).select("page_id", "top_idx", "kind", "sub_type", parts.alias("parts"))


_BREAK = "'  ' || chr(10)"
_PIECES = f"""{_PAGE}, pieces AS (SELECT *, CASE WHEN own = 'equation' OR t = '' OR regexp_matches(t, '[A-Za-z]+-$') THEN t ELSE t || ' ' END AS p FROM page),
  paras AS (SELECT page_id, top_idx, kind, bool_or(part = 'footnote') AS noted, max(sub_type) AS sub_type, coalesce(string_agg(p || {_BREAK}, '' ORDER BY idx) FILTER (part = 'caption'), '') AS above,
    coalesce(string_agg({_BREAK} || p, '' ORDER BY idx) FILTER (part = 'caption'), '') AS below, coalesce(string_agg({_BREAK} || p, '' ORDER BY idx) FILTER (part = 'footnote'), '') AS notes,
    coalesce(string_agg(chr(10) || p || '  ', '' ORDER BY idx) FILTER (part = 'footnote'), '') AS table_notes, string_agg(p || {_BREAK}, '' ORDER BY late, idx) FILTER (part = 'item') AS items,
    max(p) FILTER (part IN ('body', 'self')) AS p, max(c) FILTER (part IN ('body', 'self')) AS c, bool_or(part = 'body' AND starts_with(content, '<_')) AS marked FROM pieces GROUP BY page_id, top_idx, kind),
  shown AS (SELECT page_id, top_idx, {_STRIP("""CASE kind WHEN 'image' THEN CASE WHEN noted THEN above || notes ELSE below END WHEN 'table' THEN above || CASE WHEN c <> '' THEN chr(10) || c || chr(10) ELSE '' END || table_notes
    WHEN 'code' THEN above || CASE WHEN sub_type = 'code' THEN '```' || CASE WHEN marked THEN 'python' ELSE 'txt' END || chr(10) || p || chr(10) || '```' ELSE p END
    WHEN 'list' THEN items WHEN 'title' THEN '# ' || p WHEN 'char' THEN CASE WHEN length(c) > 5 THEN c ELSE '' END WHEN 'seal' THEN '' WHEN 'page_number' THEN '' ELSE p END""")} AS md FROM paras)
  SELECT page_id, string_agg(md, chr(10) || chr(10) ORDER BY top_idx) AS markdown FROM shown WHERE md <> '' GROUP BY page_id"""


@query(_PIECES)
def render_markdown(spark, d):
    return assemble.markdown(D.blocks(spark, d))


@query()
def doc_json(spark, d):
    pages = assemble.page_info(D.blocks(spark, d)).select("page_id", F.floor(F.col("page_id") / 3).alias("doc_id"), (F.col("page_id") % 3).cast("int").alias("page_idx"), "info")
    return assemble.documents(pages)


@query("SELECT doc_id, upper(md5(text)) AS md5_upper, md5(text) AS md5_lower, sha256(text) AS sha FROM documents")
def content_hash(spark, d):
    c = F.col("text")
    return D.table(spark, d, "documents").select("doc_id", X.bytes_md5(c.cast("binary")).alias("md5_upper"), F.md5(c.cast("binary")).alias("md5_lower"), F.sha2(c.cast("binary"), 256).alias("sha"))


@query("""SELECT l.page_id AS doc_id, CAST(w.position AS INTEGER) AS position, l.idx AS page_idx FROM (SELECT page_id, 0 AS position, 2 AS idx FROM split_docs UNION ALL SELECT page_id, 1, 0 FROM split_docs UNION ALL SELECT page_id, 2, 2 FROM split_docs) w
  JOIN doc_lines l ON l.page_id = w.page_id AND l.idx = w.idx WHERE l.page_id % 2 = 0 UNION ALL SELECT page_id, idx, idx FROM doc_lines WHERE page_id % 2 = 1""")
def page_projection(spark, d):
    pages = D.doc_lines(spark, d).select(F.col("page_id").alias("doc_id"), F.col("idx").alias("page_idx"))
    wanted = D.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(2), F.lit(0), F.lit(2))).otherwise(F.array().cast("array<int>")).alias("page_ids"))
    return layout.project_pages(pages, wanted).select("doc_id", "position", "page_idx")


@query(r"""SELECT doc_id, gram, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))) GROUP BY ALL HAVING count(*) > 1""")
def repeated_ngrams(spark, d):
    return X.repeated_grams(D.table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w")), "w", 3)


@query(" SELECT page_id, idx, CAST(greatest(least(idx - 1, 4), 0) AS INTEGER) AS level FROM blocks WHERE type = 'title'")
def title_level(spark, d):
    return D.blocks(spark, d).where("type = 'title'").select("page_id", "idx", X.title_level(F.col("idx") - 1).alias("level"))


@query(f" SELECT page_id, idx, {_STRIP('content')} AS md FROM blocks WHERE length(content) > 5 AND {_STRIP('content')} <> ''")
def figure_filter(spark, d):
    return D.blocks(spark, d).select("page_id", "idx", render.figure_text(F.col("content")).alias("md")).where("md <> ''")


@query(""" SELECT page_id, idx, CAST(row_number() OVER (PARTITION BY page_id ORDER BY idx) AS VARCHAR) || '+' || angle AS label FROM blocks""")
def overlay_labels(spark, d):
    return render.overlay_labels(D.blocks(spark, d))


@query(""" SELECT page_id, idx, CASE idx % 4 WHEN 3 THEN [842 - y1, 595 - x1, y1 - y0, x1 - x0] WHEN 2 THEN [595 - x1, y0, x1 - x0, y1 - y0] WHEN 1 THEN [y0, x0, y1 - y0, x1 - x0] ELSE [x0, 842 - y1, x1 - x0, y1 - y0] END AS rect FROM blocks""")
def canvas_rects(spark, d):
    return D.blocks(spark, d).select("page_id", "idx", G.canvas_rect(G.box(), F.lit(595), F.lit(842), F.col("angle")).alias("rect"))


@query(""" SELECT page_id, idx, CASE WHEN x0 < x1 AND y0 < y1 THEN type || '/' || upper(md5(CAST(page_id AS VARCHAR))) || '_' || page_id || '_' || x0 || '_' || y0 || '_' || x1 || '_' || y1 || '.jpeg' ELSE '' END AS path FROM blocks WHERE type IN ('image', 'seal', 'char')""")
def image_paths(spark, d):
    b = D.blocks(spark, d).where("type in ('image', 'seal', 'char')")
    return b.select("page_id", "idx", render.image_path(F.col("type"), X.bytes_md5(F.col("page_id").cast("string")), F.col("page_id"), F.array(*_BOX)).alias("path"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark, d):
    from ..streaming.layouts import event_counts

    return event_counts(D.table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query(""" SELECT page_id, type, angle, idx AS "index", [x0, y0, x1, y1] AS pos, content AS text FROM blocks WHERE type NOT IN ('image', 'table')""")
def content_blocks(spark, d):
    return layout.content_blocks(D.blocks(spark, d))


@query(" SELECT page_id AS doc_id, idx, CASE WHEN page_id % 2 = 0 AND idx < 3 THEN [5, 3, 8][idx + 1] ELSE idx END AS page_idx FROM doc_lines")
def restored_pages(spark, d):
    lines = D.doc_lines(spark, d).select(F.col("page_id").alias("doc_id"), "idx", F.col("idx").alias("page_idx"))
    lists = lines.select("doc_id").distinct().where("doc_id % 2 = 0").withColumn("page_ids", F.array(*map(F.lit, (5, 3, 8))))
    return layout.restore_page_ids(lines, lists, page="page_idx")


_SETTINGS = ", ".join(f"('{k}', {FREQUENCY_PENALTY.get(k, 0.0)}, {1.0 if k in FREQUENCY_PENALTY else 0.0})" for k in PROMPTS if k != "default")


@query(f""", settings(type, f, p) AS (VALUES {_SETTINGS}), asked AS (SELECT page_id, idx, coalesce(f, {FREQUENCY_PENALTY['default']}) AS f, coalesce(p, 1.0) AS p FROM blocks b LEFT JOIN settings s ON b.type = s.type)
  SELECT page_id, idx, CAST(sum(CASE WHEN lf IS NULL OR (lf = f AND lp = p) THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS INTEGER) AS run
  FROM (SELECT *, lag(f) OVER (PARTITION BY page_id ORDER BY idx) AS lf, lag(p) OVER (PARTITION BY page_id ORDER BY idx) AS lp FROM asked)""")
def request_runs(spark, d):
    asked = layout.requests(D.blocks(spark, d))
    return layout.param_runs(asked, "page_id", "idx", ["frequency_penalty", "presence_penalty"]).select("page_id", "idx", "run")


@query(""", sized_pages AS (SELECT *, CAST(page_id % 400 + 60 AS INTEGER) AS pw, CAST(page_id * 7 % 900 + 40 AS INTEGER) AS ph FROM blocks WHERE type NOT IN ('image', 'list', 'equation_block')),
  px AS (SELECT page_id, idx, angle, CAST(trunc(CAST(x0 / 1000.0::DOUBLE AS FLOAT) * CAST(pw AS FLOAT)) AS INTEGER) AS a, CAST(trunc(CAST(y0 / 1000.0::DOUBLE AS FLOAT) * CAST(ph AS FLOAT)) AS INTEGER) AS b,
    CAST(trunc(CAST(x1 / 1000.0::DOUBLE AS FLOAT) * CAST(pw AS FLOAT)) AS INTEGER) AS c, CAST(trunc(CAST(y1 / 1000.0::DOUBLE AS FLOAT) * CAST(ph AS FLOAT)) AS INTEGER) AS d FROM sized_pages),
  cut AS (SELECT page_id, idx, a, b, c - a AS cw, d - b AS ch, CASE WHEN angle IN (90, 270) THEN d - b ELSE c - a END AS w, CASE WHEN angle IN (90, 270) THEN c - a ELSE d - b END AS h FROM px WHERE c > a AND d > b),
  wide AS (SELECT *, CASE WHEN greatest(w, h) / least(w, h)::DOUBLE > 50 THEN CAST(ceil(greatest(w, h) / 50.0::DOUBLE) AS INTEGER) ELSE least(w, h) END AS e FROM cut),
  framed AS (SELECT *, CASE WHEN w > h THEN w ELSE e END AS fw, CASE WHEN w > h THEN e ELSE h END AS fh FROM wide)
  SELECT page_id, idx, a AS x, b AS y, cw, ch, CAST(CASE WHEN e < 28 THEN ceil(fw * (28.0::DOUBLE / least(fw, fh))) ELSE fw END AS INTEGER) AS width, CAST(CASE WHEN e < 28 THEN ceil(fh * (28.0::DOUBLE / least(fw, fh))) ELSE fh END AS INTEGER) AS height FROM framed""")
def crop_sizes(spark, d):
    b = D.blocks(spark, d)
    pages = b.select("page_id").distinct().select("page_id", (F.col("page_id") % 400 + 60).cast("int").alias("width"), (F.col("page_id") * 7 % 900 + 40).cast("int").alias("height"))
    shares = b.select("page_id", "idx", "type", "angle", F.array(*(F.col(c) / F.lit(1000.0) for c in _BOX)).alias("bbox"))
    return layout.crops(shares, pages).select("page_id", "idx", "crop.x", "crop.y", F.col("crop.width").alias("cw"), F.col("crop.height").alias("ch"), "size.width", "size.height")


@query(""", sized_pages AS (SELECT *, CAST(page_id % 400 + 60 AS INTEGER) AS pw, CAST(page_id * 7 % 900 + 40 AS INTEGER) AS ph FROM blocks WHERE type NOT IN ('image', 'list', 'equation_block')),
  px AS (SELECT page_id, idx, angle, CAST(trunc(CAST(x0 / 1000.0::DOUBLE AS FLOAT) * CAST(pw AS FLOAT)) AS INTEGER) AS a, CAST(trunc(CAST(y0 / 1000.0::DOUBLE AS FLOAT) * CAST(ph AS FLOAT)) AS INTEGER) AS b,
    CAST(trunc(CAST(x1 / 1000.0::DOUBLE AS FLOAT) * CAST(pw AS FLOAT)) AS INTEGER) AS c, CAST(trunc(CAST(y1 / 1000.0::DOUBLE AS FLOAT) * CAST(ph AS FLOAT)) AS INTEGER) AS d FROM sized_pages),
  spots AS (SELECT *, CASE WHEN angle IN (90, 180) THEN c - 1 ELSE a END AS x, CASE WHEN angle IN (180, 270) THEN d - 1 ELSE b END AS y FROM px WHERE c > a AND d > b)
  SELECT page_id, idx, CAST(CASE WHEN angle IN (90, 270) THEN d - b ELSE c - a END AS INTEGER) AS width, CAST(CASE WHEN angle IN (90, 270) THEN c - a ELSE d - b END AS INTEGER) AS height,
    [CAST(x % 256 AS INTEGER), CAST(y % 256 AS INTEGER), CAST((x + y) % 256 AS INTEGER)] AS corner FROM spots""")
def cut_out_pictures(spark, d):
    """What is cut out of pages' pictures, opened again: its size, and the pixel in its upper left corner."""
    cut = inference.cut_pictures(D.page_pictures(spark, d), frame=False)

    def corner(pictures: pd.Series) -> pd.Series:
        return pictures.map(lambda x: pixels.opened(x)[0, 0].tolist())

    return cut.select("page_id", "idx", "width", "height", F.pandas_udf(corner, "array<int>")("picture").alias("corner"))


@query(""" SELECT page_id, idx, CASE idx % 4 WHEN 3 THEN [842 - y0, 595 - x0, 842 - y0, 595 - x1, 842 - y1, 595 - x1, 842 - y1, 595 - x0] WHEN 2 THEN [595 - x0, y0, 595 - x1, y0, 595 - x1, y1, 595 - x0, y1]
  WHEN 1 THEN [y0, x0, y0, x1, y1, x1, y1, x0] ELSE [x0, 842 - y0, x1, 842 - y0, x1, 842 - y1, x0, 842 - y1] END AS quad FROM blocks""")
def canvas_quads(spark, d):
    quad = F.array(*(F.col(c) for c in ("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1")))
    return D.blocks(spark, d).select("page_id", "idx", G.canvas_quad(quad, F.lit(595), F.lit(842), F.col("angle")).alias("quad"))


@query(f""" SELECT a.page_id, a.idx AS a_idx, b.idx AS b_idx, [greatest(a.x0, b.x0), greatest(a.y0, b.y0), least(a.x1, b.x1), least(a.y1, b.y1)] AS both {_PAIRS} WHERE {_MEET('a', 'b')} > 0""")
def intersections(spark, d):
    both = G.intersection(G.box("a_"), G.box("b_"))
    return _pairs(spark, d).select("page_id", "a_idx", "b_idx", both.alias("both")).where("both is not null")


def _first_repeats_sql(size: int) -> str:
    return f""", words AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents),
  grams AS (SELECT doc_id, i - 1 AS start, hash(w[i:i + {size - 1}]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM words)),
  seen AS (SELECT *, min(start) OVER (PARTITION BY doc_id, g) AS earlier FROM grams),
  firsts AS (SELECT doc_id, min(start) AS start, arg_min(earlier, start) AS earlier FROM seen WHERE start > earlier GROUP BY doc_id)
  SELECT d.doc_id, start, earlier FROM documents d LEFT JOIN firsts f ON f.doc_id = d.doc_id"""


def _word_tokens(spark, d):
    words = F.split(F.coalesce("text", F.lit("")), " ")
    return D.table(spark, d, "documents").select("doc_id", F.transform(words, lambda w: F.xxhash64(w)).alias("tokens"))


@query(_first_repeats_sql(3))
def first_repeats(spark, d):
    return runs.first_repeats(_word_tokens(spark, d), "tokens", 3)


@query(_first_repeats_sql(100))
def first_repeats_100(spark, d):
    """Where a generator that may not repeat a hundred words would have had to stop."""
    return runs.first_repeats(_word_tokens(spark, d), "tokens", 100)


@query(""", words AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents)
  SELECT doc_id, CAST(coalesce((SELECT count(DISTINCT w[i + 1]) FROM (SELECT unnest(range(1, len(w))) AS i) WHERE w[i] = w[-1]), 0) AS INTEGER) AS n_banned FROM words""")
def banned_tokens(spark, d):
    return runs.banned_tokens(_word_tokens(spark, d), "tokens", 2).select("doc_id", F.size("banned").alias("n_banned"))


@query(" SELECT page_id, page, pages, CASE WHEN page_id % 2 = 1 THEN h ELSE w END AS width, CASE WHEN page_id % 2 = 1 THEN w ELSE h END AS height FROM pdf_sheets")
def pdf_page_sizes(spark, d):
    return pages.pages_of(D.pdf_files(spark, d), cut=False).select(F.col("path").cast("long").alias("page_id"), "page", "pages", "width", "height")


@query(""" SELECT page_id, CAST(k AS INTEGER) AS page, w AS sheet_width, h AS sheet_height FROM (
    SELECT page_id, w, h, unnest(CASE WHEN pages = 1 THEN [0, 1] WHEN page = 0 THEN [1] WHEN page = pages - 1 THEN [0] ELSE [] END) AS k FROM pdf_sheets)""")
def pdf_subsets(spark, d):
    """The last page and then the first of each file, as a file whose pages are measured again."""
    files = D.pdf_files(spark, d).withColumn("page_ids", F.array((F.col("path").cast("long") % 3).cast("int"), F.lit(0), F.lit(99)))
    key = F.col("path").cast("long")
    turned = key % 2 == 1
    sizes = F.when(turned, F.col("height")).otherwise(F.col("width")), F.when(turned, F.col("width")).otherwise(F.col("height"))
    return pages.pages_of(pages.subsets_of(files), cut=False).select(key.alias("page_id"), "page", sizes[0].alias("sheet_width"), sizes[1].alias("sheet_height"))


@query(""", sized_scans AS (SELECT DISTINCT page_id, CAST(page_id % 400 + 60 AS INTEGER) AS width, CAST(page_id * 7 % 900 + 40 AS INTEGER) AS height FROM blocks),
  scales AS (SELECT *, least(200 / 72.0::DOUBLE, 500.0::DOUBLE / greatest(width, height)) AS scale FROM sized_scans)
  SELECT page_id, width, height, [CAST((width - 1) % 256 AS INTEGER), CAST((height - 1) % 256 AS INTEGER), CAST((width + height - 2) % 256 AS INTEGER)] AS corner,
    CAST(ceil(width * scale - 1e-9) AS INTEGER) AS rendered_width, CAST(ceil(height * scale - 1e-9) AS INTEGER) AS rendered_height FROM scales""")
def scanned_pages(spark, d):
    """Pictures as PDF files of a page, and these pages as pictures again: at a dot a point the last pixel, and the sizes
    at 200 dots an inch with sides of 500 at most."""

    def corner(pictures: pd.Series) -> pd.Series:
        return pictures.map(lambda x: pixels.opened(x)[-1, -1].tolist())

    files = scans.as_pdf_files(D.page_pictures(spark, d).select("page_id", "image"), "image").select("page_id", "pdf")
    plain = scans.page_pictures(files, "pdf", dpi=72)
    plain = plain.select("page_id", "pdf", F.col("picture_width").alias("width"), F.col("picture_height").alias("height"), F.pandas_udf(corner, "array<int>")("picture").alias("corner"))
    large = scans.page_pictures(plain, "pdf", longest=500)
    return large.select("page_id", "width", "height", "corner", F.col("picture_width").alias("rendered_width"), F.col("picture_height").alias("rendered_height"))


@query(""", drawn AS (SELECT page_id, CAST(count(*) AS BIGINT) AS boxes FROM blocks GROUP BY page_id)
  SELECT p.page_id, CAST(coalesce(boxes, 0) AS BIGINT) AS boxes, true AS is_update, CAST(1 + p.page_id % 3 AS INTEGER) AS pages FROM pages p LEFT JOIN drawn d ON d.page_id = p.page_id""")
def pdf_overlays(spark, d):
    """Files with boxes drawn on their first pages: the old bytes are the first part of the new ones, which are read again."""
    files = D.pdf_files(spark, d).withColumn("before", F.col("content"))
    drawings = render.overlay_operators(D.blocks(spark, d)).select(F.col("page_id").cast("string").alias("path"), F.lit(0).alias("page"), "operators")
    both = render.with_overlays(files, drawings)
    new = F.expr("substring(content, length(before) + 1)").cast("string")
    boxes = F.size(F.split(new, " re f")) - 1
    read = pages.pages_of(both, cut=False).where("page = 0").select("path", "pages")
    return both.select("path", boxes.cast("long").alias("boxes"), F.expr("startswith(content, before)").alias("is_update")).join(read, "path").select(F.col("path").cast("long").alias("page_id"), "boxes", "is_update", "pages")


_PROMPT = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v.strip()}'" for k, v in PROMPTS.items()) + f" ELSE '{PROMPTS['default'].strip()}' END"


@query(f""", lines AS (SELECT page_id, idx, type, 'x' AS x, '<box:' || x0 || ' ' || y0 || ' ' || x1 || ' ' || y1 || '><label:' ||
      CASE WHEN idx % 19 = 0 THEN 'foo' WHEN idx % 5 = 0 THEN upper(type) ELSE type END || '><|rotate_' || ['up', 'right', 'down', 'left'][idx % 4 + 1] || '|>' || CASE WHEN idx % 17 = 0 THEN ' junk' ELSE '' END AS line FROM blocks),
    sizes AS (SELECT page_id, sum(strlen(line) + 1) - 1 AS size FROM lines GROUP BY page_id),
    good AS (SELECT page_id, type, CAST(row_number() OVER (PARTITION BY page_id ORDER BY idx) - 1 AS INTEGER) AS idx FROM lines WHERE idx % 17 <> 0 AND idx % 19 <> 0)
  SELECT g.page_id, g.idx, type, CASE WHEN type NOT IN ({", ".join(f"'{k}'" for k in NOT_EXTRACTED)}) THEN CAST(size AS BIGINT) || ' bytes: ' || {_PROMPT} END AS content
  FROM good g JOIN sizes s ON s.page_id = g.page_id""")
def two_step_contents(spark, d):
    """Layouts and contents of pages in two steps, both models asked once a page: the layout model answers with what the page's
    picture says, the other one with the picture's size and what it was asked."""
    read = inference.read_pages(D.layout_text(spark, d).select("page_id", F.col("output").cast("binary").alias("image")), "echo", "stub")
    return read.select("page_id", F.inline(F.arrays_zip(F.col("blocks.idx").alias("idx"), F.col("blocks.type").alias("type"), F.col("contents").alias("content"))))


@query()
def parsed_documents(spark, d):
    """Two steps with a model that knows each page's layout and answers all else with the picture's size."""
    pages = D.layout_text(spark, d).select("page_id", F.floor(F.col("page_id") / 3).alias("doc_id"), (F.col("page_id") % 3).cast("int").alias("page_idx"), F.col("output").cast("binary").alias("image"), F.lit(1000).alias("width"), F.lit(1000).alias("height"))
    return inference.parse_documents(pages, "echo")


@query(""" SELECT page_id, idx, CASE type WHEN 'equation' THEN 'interline_equation' WHEN 'image' THEN type WHEN 'table' THEN type ELSE 'text' END AS kind, [x0, y0, x1, y1] AS bbox
  FROM blocks WHERE type NOT IN ('equation_block', 'unknown', 'seal', 'char', 'list')""")
def overlay_spans(spark, d):
    return render.overlay_spans(D.blocks(spark, d))


@query(f" SELECT a.page_id, a.idx AS a_idx, b.idx AS b_idx {_PAIRS} WHERE {_MEET('a', 'b')} > 0 AND 10 * {_MEET('a', 'b')} >= 8 * {_AREA('a')}")
def mostly_inside(spark, d):
    return _pairs(spark, d).where(G.mostly_inside(G.box("a_"), G.box("b_"))).select("page_id", "a_idx", "b_idx")


@query(" SELECT page_id, idx, [3, 5, x0, y0, x1, y1, x1 - x0 + 6, y1 - y0 + 10] AS frame, [CAST(trunc(x0 * 1.7::DOUBLE) AS INTEGER), CAST(trunc(y0 * 1.7::DOUBLE) AS INTEGER), CAST(trunc(x1 * 1.7::DOUBLE) AS INTEGER), CAST(trunc(y1 * 1.7::DOUBLE) AS INTEGER)] AS scaled, (x1 - x0) * (y1 - y0) AS area FROM blocks")
def crop_frames(spark, d):
    poly = F.array(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1")))
    return D.blocks(spark, d).select("page_id", "idx", G.crop_frame(poly, 3, 5).alias("frame"), G.scaled_box(G.box(), F.lit(1.7)).alias("scaled"), G.corners(poly)["area"].alias("area"))


_COLOUR = "CASE type " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in render.COLOURS.items()) + " ELSE '#9e9e9e' END"


@query(f""", ordered AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS n FROM blocks)
  SELECT page_id, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1000 1000">' || string_agg('<rect x="' || x0 || '" y="' || y0 || '" width="' || (x1 - x0) || '" height="' || (y1 - y0) || '" style="fill:' || {_COLOUR} || ';fill-opacity:0.3"/><text x="' || x1 || '" y="' || y0 || '">' || n || '</text>', '' ORDER BY n) || '</svg>' AS svg
  FROM ordered GROUP BY page_id""")
def overlay_svg(spark, d):
    return render.overlay_svg(D.blocks(spark, d))
