"""Relations with the shape of recognised layouts, made from the test tables by integer rules, and
the same rules as SQL (common table expressions) for checking queries against."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.batches import parts
from ..functions.pdf import Name, Ref, Stream, written
from ..functions.pixels import encoded

# Types by slot, for pages by the remainder of their number.
TEMPLATES = [
    ["image", "text", "image_caption", "text", "image", "table", "table_footnote", "table", "table_caption", "text", "list", "text", "text", "ref_text", "header", "equation_block"],
    ["code_caption", "code", "text", "image_footnote", "image", "equation", "char", "seal", "algorithm", "text", "phonetic", "table", "image_footnote", "page_number", "title", "unknown"],
    ["title", "text", "table_caption", "table", "table_footnote", "text", "image", "image_caption", "image_caption", "text", "list", "text", "text", "ref_text", "header", "equation_block"],
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def doc_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("page_id"), F.split("text", "\n").alias("lines"))
    return docs.select("page_id", F.posexplode("lines").alias("idx", "content"))


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    i, p = F.col("idx").cast("long"), F.col("page_id")
    names = [F.array(*map(F.lit, t)) for t in TEMPLATES]
    kind = F.when(p % 3 == 0, F.get(names[0], (i % 16).cast("int"))).when(p % 3 == 1, F.get(names[1], ((i + p) % 16).cast("int"))).otherwise(F.get(names[2], ((i + 3 * p + (i * i) % 5) % 16).cast("int")))
    same = (F.col("type") == "image") & (p % 7 == 0)
    width = F.when(F.col("type") == "list", 299).when(same, 200).otherwise(20 + (i * 53 + p * 7) % 120)
    height = F.when(F.col("type") == "list", 299).when(same, 200).otherwise(10 + (i * 31 + p * 3) % 60)
    d = doc_lines(spark, folder).withColumn("type", kind)
    d = d.withColumns({"x0": F.when(same, 100).otherwise((i * 137 + p * 61) % 700).cast("int"), "y0": F.when(same, 100).otherwise((i * 89 + p * 17) % 700).cast("int"), "w": width.cast("int"), "h": height.cast("int")})
    marked = F.when(F.col("type").isin("code", "algorithm") & (F.col("idx") % 2 == 0), F.concat(F.lit("<_Python_>"), "content")).otherwise(F.col("content"))
    d = d.withColumn("content", marked)
    return d.select("page_id", "idx", "type", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"), ((F.col("idx") % 4) * 90).cast("int").alias("angle"), "content")


def layout_text(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("idx")
    label = F.when(i % 19 == 0, F.lit("foo")).when(i % 5 == 0, F.upper("type")).otherwise(F.col("type"))
    side = F.get(F.array(*map(F.lit, ("up", "right", "down", "left"))), i % 4)
    line = F.concat(F.format_string("<box:%d %d %d %d><label:%s><|rotate_%s|>", "x0", "y0", "x1", "y1", label, side), F.when(i % 17 == 0, F.lit(" junk")).otherwise(F.lit("")))
    rows = blocks(spark, folder).select("page_id", F.struct("idx", line.alias("line")).alias("r"))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("output"))


def otsl_tables(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    r = table(spark, folder, "lineitem").withColumn("i", F.row_number().over(w))
    row = F.concat(
        F.lit("<fcel>"), F.col("l_returnflag"),
        F.when(F.col("i") % 3 == 0, F.lit("<lcel>")).otherwise(F.concat(F.lit("<fcel>"), F.col("l_linestatus"))),
        F.when(F.col("i") % 4 == 0, F.lit("<ucel>")).otherwise(F.concat(F.lit("<fcel>"), F.col("l_linenumber").cast("string"))),
        F.lit("<nl>"),
    )
    rows = r.select("l_orderkey", F.struct("i", row.alias("row")).alias("r"))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["row"]), "").alias("otsl"))


def equations(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("p_size").cast("string")
    forms = [("\\[\\frac{1}{", "}\\]"), ("E=mc^", " (S-1)"), ("y=f(x)", None), ("\\begin{align}\\begin{bmatrix}", "&1"), ("a≤", "×b→c"), ("\\left( x + ", ""), ("a}", "{c 5%"), ("x_", " tag{S}")]
    c = None
    for k, (head, tail) in enumerate(forms):
        text = F.lit(head) if tail is None else F.concat(F.lit(head), s, F.replace(F.lit(tail), F.lit("S"), s))
        c = F.when(F.col("p_partkey") % 8 == k, text) if c is None else c.when(F.col("p_partkey") % 8 == k, text)
    return table(spark, folder, "part").select("p_partkey", c.alias("latex"))


def text_math(spark: SparkSession, folder: str) -> DataFrame:
    plain = F.translate(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), "$\\", "")
    d = table(spark, folder, "documents").select("doc_id", F.coalesce(plain, F.lit("")).alias("t"))
    content = F.concat(F.expr("substring(t, 1, 40)"), F.lit("$ x $"), F.expr("substring(t, 41)"), F.when(F.col("doc_id") % 5 == 0, F.lit("$")).otherwise(F.lit("")))
    return d.select("doc_id", content.alias("content"))


def stacked_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose first box is a table around the others, which lie below each other, some too close."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    r = table(spark, folder, "lineitem").withColumn("i", F.row_number().over(w)).select(F.col("l_orderkey").alias("page_id"), F.col("i").alias("idx"), "l_partkey")
    high = F.when(F.col("l_partkey") % 7 == 0, 110).otherwise(95)
    first, n = F.col("idx") == 1, F.count("*").over(Window.partitionBy("page_id"))
    y0 = F.when(first, 0).otherwise((F.col("idx") - 2) * 100)
    return r.select("page_id", "idx", F.lit("table").alias("type"), F.lit(0).alias("x0"), y0.alias("y0"), F.lit(200).alias("x1"), (y0 + F.when(first, n * 100).otherwise(high)).cast("int").alias("y1"))


def detections(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("type") == "table", 5).when(F.col("type") == "text", 1).when(F.col("type").endswith("_caption"), 4).otherwise(6)
    poly = F.array(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1")))
    return blocks(spark, folder).select("page_id", "idx", kind.alias("category_id"), poly.alias("poly"), (((F.col("idx") * 37 + F.col("page_id")) % 100) / 100.0).alias("score"))


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content): a PDF file for each of the pages, of one to three sheets that are as high as they are far
    behind and turned as the tree's root says; the text is what the first one holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in parts(batch, "html")):
            made = []
            for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = 1 + i % 3
                sheets = [{"Type": Name("Page"), "Parent": Ref(2), "MediaBox": [0, 0, 200 + i % 100, 300 + 10 * k]} for k in range(n)]
                sheets[0]["Contents"] = Ref(3 + n)
                root = {"Type": Name("Pages"), "Kids": [Ref(3 + k) for k in range(n)], "Count": n, "Rotate": i % 4 * 90}
                made.append(written([{"Type": Name("Catalog"), "Pages": Ref(2)}, root, *sheets, Stream({}, (text or "").encode())]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(made, pa.binary())], names=["path", "content"])

    return table(spark, folder, "pages").select("page_id", "html").mapInArrow(run, "path string, content binary")


def page_pictures(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, image, blocks): a PNG picture for each page of blocks, whose pixels say where they are (x, y and their
    sum, modulo 256), and the blocks in shares of the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i in batch.column(0).to_pylist():
                y, x = np.arange(i * 7 % 900 + 40, dtype=np.uint16).astype(np.uint8)[:, None], np.arange(i % 400 + 60, dtype=np.uint16).astype(np.uint8)
                picture = np.empty((len(y), len(x), 3), np.uint8)
                picture[:, :, 0], picture[:, :, 1], picture[:, :, 2] = x, y, y + x
                made.append(encoded(picture))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), batch.column(1)], names=["page_id", "image", "blocks"])

    shares = F.array(*(F.col(c) / F.lit(1000.0) for c in ("x0", "y0", "x1", "y1")))
    dealt = blocks(spark, folder).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id")  # small rows, large pictures: no partitions put together
    rows = dealt.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("idx", "type", shares.alias("bbox"), "angle"))).alias("blocks"))
    kind = "array<struct<idx int, type string, bbox array<double>, angle int>>"
    return rows.mapInArrow(run, f"page_id long, image binary, blocks {kind}")


def _list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


#: SQL of the relations above; queries' SQL begins with it.
SQL = f"""
WITH split_docs AS (SELECT doc_id AS page_id, string_split(text, chr(10)) AS parts FROM documents),
doc_lines AS (
  SELECT page_id, CAST(i - 1 AS INTEGER) AS idx, parts[i] AS content
  FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM split_docs)),
typed AS (
  SELECT * REPLACE (CASE WHEN type IN ('code', 'algorithm') AND idx % 2 = 0 THEN '<_Python_>' || content ELSE content END AS content) FROM (
    SELECT *, CASE page_id % 3 WHEN 0 THEN {_list(TEMPLATES[0])}[idx % 16 + 1] WHEN 1 THEN {_list(TEMPLATES[1])}[(idx + page_id) % 16 + 1]
      ELSE {_list(TEMPLATES[2])}[(idx + 3 * page_id + (idx * idx) % 5) % 16 + 1] END AS type FROM doc_lines)),
sized AS (
  SELECT *, CAST(CASE WHEN type = 'image' AND page_id % 7 = 0 THEN 100 ELSE (idx * 137 + page_id * 61) % 700 END AS INTEGER) AS x0,
    CAST(CASE WHEN type = 'image' AND page_id % 7 = 0 THEN 100 ELSE (idx * 89 + page_id * 17) % 700 END AS INTEGER) AS y0,
    CAST(CASE WHEN type = 'list' THEN 299 WHEN type = 'image' AND page_id % 7 = 0 THEN 200 ELSE 20 + (idx * 53 + page_id * 7) % 120 END AS INTEGER) AS w,
    CAST(CASE WHEN type = 'list' THEN 299 WHEN type = 'image' AND page_id % 7 = 0 THEN 200 ELSE 10 + (idx * 31 + page_id * 3) % 60 END AS INTEGER) AS h FROM typed),
pdf_sheets AS (SELECT page_id, CAST(p AS INTEGER) AS page, CAST(1 + page_id % 3 AS INTEGER) AS pages, CAST(200 + page_id % 100 AS DOUBLE) AS w, CAST(300 + 10 * p AS DOUBLE) AS h
  FROM (SELECT page_id, unnest(range(0, 1 + page_id % 3)) AS p FROM pages)),
blocks AS (SELECT page_id, idx, type, x0, y0, x0 + w AS x1, y0 + h AS y1, CAST((idx % 4) * 90 AS INTEGER) AS angle, content FROM sized),
ranked_items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem),
equations AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '\\[\\frac{{1}}{{' || p_size || '}}\\]' WHEN 1 THEN 'E=mc^' || p_size || ' (' || p_size || '-1)' WHEN 2 THEN 'y=f(x)'
  WHEN 3 THEN '\\begin{{align}}\\begin{{bmatrix}}' || p_size || '&1' WHEN 4 THEN 'a≤' || p_size || '×b→c' WHEN 5 THEN '\\left( x + ' || p_size WHEN 6 THEN 'a}}' || p_size || '{{c 5%'
  ELSE 'x_' || p_size || ' tag{{' || p_size || '}}' END AS latex FROM part),
split_math AS (SELECT doc_id, substr(t, 1, 40) AS a, substr(t, 41) AS b FROM (SELECT doc_id, translate(replace(coalesce(text, ''), chr(10), ' '), '$\', '') AS t FROM documents)),
stacked_tables AS (SELECT l_orderkey AS page_id, i AS idx, 0 AS x0, CASE WHEN i = 1 THEN 0 ELSE (i - 2) * 100 END AS y0, 200 AS x1,
  CASE WHEN i = 1 THEN count(*) OVER (PARTITION BY l_orderkey) * 100 ELSE (i - 2) * 100 + CASE WHEN l_partkey % 7 = 0 THEN 110 ELSE 95 END END AS y1 FROM ranked_items)
"""
