"""Loaders, sinks, settings and sizes on small inputs."""

import base64
import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quireworks import settings
from quireworks.functions import geometry as G
from quireworks.functions import tables as TB
from quireworks.functions import text as X
from quireworks.operators import inference, layout
from quireworks.sources import files


def test_load(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG....")
    data = base64.b64encode(b"hi!").decode()
    uris = [f"file://{tmp_path}/a.png", f"{tmp_path}/a.png", f"data:text/plain;base64,{data}", data, "https://x/y.png", f"{tmp_path}/missing.PDF", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(uris)], "i int, uri string")
    got = {r.i: r.content and bytes(r.content) for r in files.load(df, files.scan(spark, str(tmp_path))).collect()}
    assert got == {0: b"\x89PNG....", 1: b"\x89PNG....", 2: b"hi!", 3: b"hi!", 4: None, 5: None, 6: None}


def test_suffixes(spark):
    rows = [("x.pdf", b"%PDF-1"), ("x.pdf", b"\x89PNG\r\n\x1a\n"), ("x.HTML", b"<html>"), ("x", b"??"), ("dir.a/x", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, path string, content binary")
    assert [r[0] for r in df.orderBy("i").select(files.suffix_of(F.col("path"), F.col("content"))).collect()] == ["pdf", "png", "html", None, None]


def test_bucket_paths(spark):
    df = spark.createDataFrame([("s3://b/k/l.pdf",), ("/b/k",), ("b/",)], "p string")
    assert [tuple(r[0]) for r in df.select(X.bucket_and_key(F.col("p"))).collect()] == [("b", "k/l.pdf"), ("b", "k"), ("b", "")]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("a", "# A", "{}"), ("b", "", None)], "name string, markdown string, document string")
    assert sorted(map(tuple, files.write_documents(docs, str(tmp_path)).collect())) == [("a/a.md", 3), ("a/a_middle.json", 2), ("b/b.md", 0)]
    assert (tmp_path / "a/a.md").read_text() == "# A" and sorted(x.name for x in (tmp_path / "a").iterdir()) == ["a.md", "a_middle.json"]
    pictures = spark.createDataFrame([("p.jpeg", 1, b"x"), ("p.jpeg", 3, b"zz"), ("p.jpeg", 2, b"y"), ("q.jpeg", 1, None)], "path string, turn int, content binary")
    last = files.last_pictures(pictures, "turn")
    assert sorted(map(tuple, files.write_named(last, f"file://{tmp_path}/images", "path").collect())) == [("p.jpeg", 2), ("q.jpeg", 0)]
    assert (tmp_path / "images/p.jpeg").read_bytes() == b"zz"


def test_new_picture_paths(spark):
    blocks = spark.createDataFrame([(1, "image", "a"), (2, "image", None), (3, "text", "b")], "i int, type string, image_path string")
    mapping = spark.createDataFrame([("a", "x"), ("a", "y")], "old string, new string")
    assert sorted(map(tuple, files.rewrite_image_paths(blocks, mapping, ["image"]).collect())) == [(1, "image", "y"), (2, "image", None), (3, "text", "b")]
    with pytest.raises(Exception, match="no new path for b"):
        files.rewrite_image_paths(blocks, mapping, ["text"]).collect()


def test_settings(tmp_path, monkeypatch):
    own = {"flag": False, "n": 3, "x": 0.5, "s": "a", "none": None}
    assert settings.updated(["flag=Yes", "n=7", "x=1", "s=a=b"], own) == {"flag": True, "n": 7, "x": 1.0, "s": "a=b", "none": None}
    assert settings.updated(["s=None"], own)["s"] is None and settings.updated([])["MAX_MODEL_LEN"] == 16384 and own["n"] == 3
    with pytest.raises(ValueError):
        settings.updated(["n"], own)
    with pytest.raises(KeyError):
        settings.updated(["m=1"], own)
    for value, want in (("12", 12), ("0", 5), ("-1", 5), ("x", 5)):
        monkeypatch.setenv("SOME_SETTING", value)
        assert settings.positive_from_environment("SOME_SETTING", 5) == want
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert settings.config_file(str(tmp_path / "c.json")) == {"a": 1} and settings.config_file(str(tmp_path / "d.json")) is None


def test_json_values(spark):
    data = {"b": [1, {"k": "v", "a": {"k": {"k": 2}}}], "a": "ä"}
    df = spark.createDataFrame([(json.dumps(data),), (None,)], "c string")
    got = df.select(X.values_under(F.col("c"), "k").alias("v"), X.dict_md5(F.col("c")).alias("h")).collect()
    assert list(got[0].v) == ['"v"', '{"k": 2}', "2"] and got[1].v is None and got[1].h is None
    assert got[0].h == hashlib.md5(json.dumps(data, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert X.without_surrogates("a\ud800b\udfffc\ue000") == "abc\ue000"


def test_cell_text(spark):
    df = spark.createDataFrame([("t", "k", ["a"]), (None, "k", ["a"]), (None, "", ["a", "b "]), (None, None, None)], "t string, k string, p array<string>")
    assert [r[0] for r in df.select(TB.cell_text(F.col("t"), F.col("k"), F.col("p"))).collect()] == ["t", "k", "a b", ""]


def test_sizes_by_hand(spark):
    rng = random.Random(3)
    sizes = [(rng.choice([1, 5, 27, 28, 100, 3000, 9000]), rng.choice([1, 2, 28, 60, 5000, 12000])) for _ in range(80)]

    def fitted(w, h):
        scale = (64_000_000 / (w * h)) ** 0.5
        return (max(1, round(w * scale)), max(1, round(h * scale))) if w * h > 64_000_000 else (w, h)

    def padded(w, h):
        left = top = 0
        if max(w, h) / min(w, h) > 50:
            nw, nh = (w, math.ceil(w / 50)) if w > h else (math.ceil(h / 50), h)
            left, top, w, h = int((nw - w) / 2), int((nh - h) / 2), nw, nh
        if min(w, h) < 28:
            scale = 28 / min(w, h)
            w, h = math.ceil(w * scale), math.ceil(h * scale)
        return w, h, left, top

    df = spark.createDataFrame([(i, *s) for i, s in enumerate(sizes)], "i int, w int, h int").orderBy("i")
    got = df.select(G.fitted(F.col("w"), F.col("h"), 64_000_000).alias("f"), G.padded(F.col("w"), F.col("h")).alias("p")).collect()
    assert [tuple(r.f) for r in got] == [fitted(*s) for s in sizes] and [tuple(r.p) for r in got] == [padded(*s) for s in sizes]
    poly = spark.createDataFrame([([0.1, 0.2, 0.5, 0.25, 0.3, 0.9],), ([0.0, 0.0, 0.999, 0.5],)], "b array<double>")
    assert [tuple(r[0]) for r in poly.select(G.crop_rect(F.col("b"), F.lit(100), F.lit(200))).collect()] == [(10, 40, 41, 141), (0, 0, 99, 100)]


def test_settings_of_requests(spark):
    df = spark.createDataFrame([(0, 0.5, None), (1, None, 2)], "i int, temperature double, top_k int")
    got = layout.merged_params(df, {"temperature": 0.0, "top_k": 1}, ["temperature", "top_k", "top_p"]).orderBy("i").collect()
    assert [(r.temperature, r.top_k, r.top_p) for r in got] == [(0.5, 1, None), (0.0, 2, None)]


def test_two_steps(spark):
    page = "<box:0 0 500 100><label:title><|rotate_up|>\n<box:0 200 900 400><label:image><|rotate_up|>\n<box:0 400 900 450><label:image_caption><|rotate_up|>\n<box:0 950 90 999><label:header><|rotate_up|>"
    pages = spark.createDataFrame([(10, 7, 1, page.encode(), 200, 100), (11, 7, 0, b"nothing", 100, 100), (12, 8, 0, None, 100, 100), (13, 7, 2, b"<box:0 0 1 1><label:text><|rotate_up|>", 100, 100)], "page_id long, doc_id long, page_idx int, image binary, width int, height int")
    blocks = {r.idx: r for r in inference.extract(pages.where("page_id = 10"), "echo").collect()}
    assert [(blocks[i].x0, blocks[i].y0, blocks[i].x1, blocks[i].y1) for i in range(2)] == [(0, 0, 100, 10), (0, 20, 180, 40)]
    assert blocks[1].content is None and blocks[0].content.startswith(f"{len(page)} bytes:")
    assert 3 not in {r.idx for r in inference.extract(pages.where("page_id = 10"), "echo", paratext=False).collect()}
    got = inference.parse_documents(pages, "echo").collect()
    assert [r.doc_id for r in got] == [7]
    assert [p["page_idx"] for p in json.loads(got[0].document)["pdf_info"]] == [1, 2] and got[0].markdown.startswith("# ") and got[0].markdown.count("bytes:") == 4
    assert json.loads(got[0].document)["pdf_info"][0]["page_size"] == [200, 100]
