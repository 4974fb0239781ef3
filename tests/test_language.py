"""Languages by held-out texts."""

from pyspark.sql import functions as F

from quireworks.operators import language


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL AND length(text) > 0 AND lang IS NOT NULL")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = language.fit(docs.where(~held))
    assert model.languages == ["de", "en", "es", "fr"]
    got = language.detect(docs.where(held), model).groupBy("lang").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("detected")).cast("double")).alias("right")).collect()
    assert sum(r.n for r in got) > 250 and sum(r.n * r.right for r in got) / sum(r.n for r in got) >= 0.97, got


def test_odd_rows(spark):
    rows = [(1, "xx", "aaaa " * 20, "k"), (2, "yy", "bbbb " * 20, "k"), (3, None, "aaaa", "k"), (4, "xx", None, None), (5, "yy", "", "k"), (None, "yy", "日本 bbb", "k"), (1, "xx", "aaaa " * 20, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, detected string")
    model = language.fit(docs)
    assert model.languages == ["xx", "yy"]
    got = language.detect(docs, model)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.detected or "") for r in got.collect()) == [(0, "yy"), (1, "xx"), (1, "xx"), (2, "yy"), (3, "xx"), (4, ""), (5, "")]
    none = language.fit(docs.where("false"))
    assert none.languages == [] and {r.detected for r in language.detect(docs, none).collect()} == {None}
    assert language.sample(docs, size=1).count() <= 6 and language.fit(docs, size=0).languages == []
