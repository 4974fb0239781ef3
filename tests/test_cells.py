"""Cells of tables in OTSL: each table in its own row."""

from quireworks.functions import tables


def test_cells_without_sorting(spark):
    streams = [
        (1, "<fcel>a<lcel><fcel>b<nl><ucel><xcel><fcel> c <nl><fcel>d<ecel><fcel>e<nl>"), (1, "<fcel>x<nl><ucel><nl><nl><ucel><fcel>y"),
        (2, ""), (3, None), (None, "<lcel><fcel>z<lcel><lcel>"),
    ]
    got = tables.otsl_cells(spark.createDataFrame(streams, "id long, otsl string"), "id", "otsl")
    want = {
        (1, 0, 0, "a", 1 + 1, 2), (1, 0, 2, "b", 1, 1), (1, 1, 2, "c", 1, 1), (1, 2, 0, "d", 1, 1), (1, 2, 1, "", 1, 1), (1, 2, 2, "e", 1, 1),
        (1, 0, 0, "x", 3, 1), (1, 3, 1, "y", 1, 1), (None, 0, 1, "z", 1, 3),
    }
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Exchange" not in plan
