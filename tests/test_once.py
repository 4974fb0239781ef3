"""What is costly is computed once a row: plans and calls are counted."""

from pyspark.sql import functions as F

from quireworks.functions import latex
from quireworks.operators import assemble, inference, layout

_BLOCK = "page_id long, idx int, type string, x0 int, y0 int, x1 int, y1 int, angle int, content string"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_put_together_once(spark):
    rows = [(1, 0, "title", 0, 0, 9, 9, 0, "T"), (1, 1, "text", 0, 20, 9, 29, 0, "a b"), (2, 0, "seal", 0, 0, 9, 9, 0, "s"), (3, 0, "unknown", 0, 0, 9, 9, 0, "u")]
    blocks = spark.createDataFrame(rows, _BLOCK)
    made = assemble.markdown(blocks)
    assert [tuple(r) for r in made.collect()] == [(1, "# T\n\na b")]  # neither pages that show nothing nor pages without blocks
    assert sorted(r.page_id for r in assemble.page_info(blocks).collect()) == [1, 2]
    for df in (made, assemble.page_info(blocks), assemble.paragraphs(blocks), assemble.page_paragraphs(blocks)):
        assert _plan(df).count("struct(top_idx") == 1


def test_texts_that_nothing_reads_are_not_made(spark):
    """Nested documents and the places of paragraphs have no text as it is joined; both hold the same parts without it."""
    blocks = spark.createDataFrame([(1, 0, "title", 0, 0, 9, 9, 0, "T"), (1, 1, "text", 0, 20, 9, 29, 0, "a b")], _BLOCK)
    whole = assemble.pages(blocks).select("page_id", "info")
    info = assemble.page_info(blocks)
    assert info.collect() == whole.collect()
    assert "piece" in _plan(whole) and "piece" not in _plan(info)
    assert "piece" not in _plan(assemble.paragraphs(blocks, pieces=False))


def test_boxes_are_made_once(spark):
    text = spark.createDataFrame([("<box:0 10 1000 20><label:text><|rotate_up|>",)], "t string").select(layout.blocks_of(F.col("t"), rectangles=True).alias("b"))
    assert [x.bbox for x in text.collect()[0].b] == [[0.0, 0.01, 0.999, 0.02]]
    assert _plan(text).count("999") == 1


def test_python_gets_formulas_only(spark, monkeypatch, tmp_path):
    seen = str(tmp_path / "seen")

    def told(s):
        with open(seen, "a") as f:
            f.write(s + "\n")
        return s

    monkeypatch.setattr(latex, "close_environments", told)
    rows = [("equation", "x"), ("text", "plain"), ("table", "<fcel>a<nl>"), ("title", "y")]
    got = {r.type: r.content for r in inference.repaired(spark.createDataFrame(rows, "type string, content string")).collect()}
    assert got["equation"] == "$$x$$" and got["text"] == "plain" and got["title"] == "y"
    assert open(seen).read().split("\n") == ["$$x$$", ""]
