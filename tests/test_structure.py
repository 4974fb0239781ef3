"""Layout parsing, attachment, order and rendering on small pages, and all queries against SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quireworks.operators import assemble, inference, layout, structure, suppress
from quireworks.plans.catalog import ORACLES, QUERIES
from quireworks.sources import files
from quireworks.streaming import layouts

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def blocks(spark, *items):
    return spark.createDataFrame([(1, i, t, *b, 0, c) for i, t, b, c in items], "page_id long, idx int, type string, x0 int, y0 int, x1 int, y1 int, angle int, content string")


def test_parse_layout(spark):
    text = "\n".join([
        "<box:0 0 1000 500><label:Text><|rotate_up|>", "<box:10 10 20><label:text><up>", "<box:0 0 10 1001><label:text><up>",
        "<box:0 0 10 10><label:foo><up>", "<box:0 0 10 10><label:text><none>", "junk", "",
    ])
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "page_id long, output string")
    got = layout.parse_layout(df).orderBy("page_id", "idx").collect()
    assert [(r.idx, r.type, list(r.bbox), r.angle) for r in got] == [(0, "text", [0.0, 0.0, 0.999, 0.5], 0), (1, "text", [0.0, 0.0, 0.01, 0.01], None)]
    poly = spark.createDataFrame([(1, "<box:0 0 500 0 500 1000><label:image>")], "page_id long, output string")
    assert layout.parse_layout(poly, rectangles=True).first().bbox == [0.0, 0.0, 0.5, 0.999]


def test_equal_boxes_remove_each_other(spark):
    b = blocks(spark, (0, "image", (0, 0, 10, 10), ""), (1, "image", (0, 0, 10, 10), ""), (2, "image", (20, 20, 30, 30), ""))
    assert rows(structure.without_contained(b), "idx") == [(2,)]


def test_nearest_and_runs(spark):
    b = blocks(spark, (0, "image_caption", (0, 0, 10, 5), ""), (1, "image", (0, 6, 10, 20), ""), (2, "image_caption", (0, 21, 10, 25), ""), (4, "image_caption", (0, 30, 10, 35), ""))
    att = structure.attach(b, "image", "caption")
    assert rows(att, "obj_idx", "sub_idx") == [(0, 1), (2, 1), (4, 1)]
    kept = structure.contiguous(att.withColumnRenamed("obj_idx", "idx"), True)
    assert rows(kept, "idx", "kept") == [(0, False), (2, False), (4, True)]


def test_subtype_tie_goes_to_text(spark):
    m = spark.createDataFrame([(1, 0, 9, "ref_text"), (1, 1, 9, "text")], "page_id long, idx int, list_idx int, type string")
    assert rows(structure.list_subtypes(m), "sub_type") == [("text",)]


def test_greedy_match_and_suppress(spark):
    b = blocks(spark, (0, "image", (0, 0, 10, 10), ""), (1, "image_caption", (0, 11, 10, 15), ""), (2, "image", (100, 100, 110, 110), ""))
    got = structure.match_greedily(b.where("type = 'image'"), b.where("type = 'image_caption'"))
    assert sorted(((r.sub_idx, r.obj_idx) for r in got.collect()), key=str) == [(0, 1), (2, None)]
    d = spark.createDataFrame([(1, 0, 5, [0.0, 0.0, 10.0, 0.0, 10.0, 10.0, 0.0, 10.0], 0.9), (1, 1, 5, [0.0, 0.0, 10.0, 0.0, 10.0, 9.0, 0.0, 9.0], None)], "page_id long, idx int, category_id int, poly array<double>, score double")
    assert rows(suppress.suppress(d), "x0", "y0", "x1", "y1") == [(0.0, 0.0, 10.0, 10.0)]


def test_suppress_routes_categories():
    def left(*items):
        got = suppress.page_boxes([{"category": c, "box": list(b), "score": s} for c, b, s in items])
        return [(b["category"], *b["box"]) for b in got]

    # captions and formulas absorb nothing; text boxes do
    assert left((4, (0, 0, 10, 10), 0.9), (4, (0, 0, 5, 5), 0.1), (13, (0, 0, 9, 9), 0.9), (13, (0, 0, 5, 5), 0.1)) == [(4, 0, 0, 10, 10), (4, 0, 0, 5, 5), (13, 0, 0, 9, 9), (13, 0, 0, 5, 5)]
    assert left((1, (0, 0, 10, 10), 0.9), (1, (0, 0, 5, 5), 0.1)) == [(1, 0, 0, 10, 10)]
    # a table that holds text blocks gives way to them, or takes them in
    inner = ((1, (0, 0, 10, 4), 0.5), (1, (0, 5, 10, 11), 0.5))
    assert left((5, (0, 0, 10, 10), 0.2), *inner) == [(1, 0, 0, 10, 4), (1, 0, 5, 10, 11)]
    assert left((5, (0, 0, 10, 10), 0.9), *inner) == [(5, 0, 0, 10, 11)]
    # a table made of three others goes before it could absorb them
    parts = [(5, (0, 10 * k, 10, 10 * k + 9), 0.3) for k in range(3)]
    assert left((5, (0, 0, 10, 30), 0.9), *parts) == [(5, 0, 10 * k, 10, 10 * k + 9) for k in range(3)]
    # boxes without an area lie in nothing
    assert len(left((4, (0, 0, 10, 10), 0.2), (4, (50, 50, 50, 50), 0.9), (4, (60, 60, 60, 60), 0.9))) == 3


def test_render(spark):
    b = blocks(spark, (0, "title", (0, 0, 1, 1), "A\n b"), (1, "text", (0, 0, 1, 1), "ＡＢ"), (2, "seal", (0, 0, 1, 1), "no"), (3, "char", (0, 0, 1, 1), "12345"), (4, "char", (0, 0, 1, 1), "123456"), (5, "text", (0, 0, 1, 1), None))
    assert assemble.markdown(b).first().markdown == "# A b\n\nAB\n\n123456"
    pages = assemble.page_info(b).selectExpr("7L doc_id", "0 page_idx", "info")
    assert '"_version_name":"1.0.0"' in assemble.documents(pages).first().document


def test_models_keep_keys(spark):
    r = layout.requests(blocks(spark, (0, "text", (0, 0, 1, 1), ""), (1, "title", (0, 0, 1, 1), ""))).withColumn("image", F.lit(b"abc"))
    got = inference.recognise(r)
    assert "image" not in got.columns and rows(got, "idx")[0] == (0,)
    assert got.where("idx = 1").first().output == "3 bytes: Please output the text content from the image."


def test_files(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1.7"), ("b.png", b"\x89PNG\r\n\x1a\n...."), ("c.json", b"{}"), ("d.bin", b"??")):
        (tmp_path / name).write_bytes(data)
    good, bad = files.readable(files.scan(spark, str(tmp_path)))
    assert rows(good, "kind") == [("pdf",), ("png",)] and bad.count() == 1


def test_streams_repair_as_batches_do(spark, tmp_path):
    b = spark.createDataFrame([("equation", "a≤b"), ("text", "a$ x $b"), ("title", "t")], "type string, content string")
    b.write.parquet(str(tmp_path / "in"))
    s = layouts.repaired(layouts.arrivals(spark, str(tmp_path / "in"), "type string, content string"))
    q = s.writeStream.format("memory").queryName("repaired").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert rows(spark.table("repaired"), "type", "content") == rows(layouts.repaired(b), "type", "content")


def test_filters_reach_the_scan(spark, data):
    plan = spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey").where("l_orderkey = 1")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_orderkey), EqualTo(l_orderkey,1)]" in plan
    assert "CartesianProduct" not in QUERIES["nearest_caption"](spark, data)._jdf.queryExecution().toString()


def normal(v):
    return round(v, 9) if isinstance(v, float) else tuple(map(normal, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(map(normal, r)) for r in df.select(*cols).collect()), key=repr)
    if name in ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
        r = con.execute(ORACLES[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(normal(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
    else:
        assert got
