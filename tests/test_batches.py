"""Parts of batches: all rows in order, in so many bytes; what is made of files leaves in parts too."""

import pyarrow as pa

from quireworks.functions import batches
from quireworks.functions.pdf import Name, Ref, written
from quireworks.operators import render
from quireworks.sources import pages


def test_parts():
    for sizes in ([], [5], [3, None, 0, 9, 4, 4, 1], [0, 0]):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int64()), pa.array([None if n is None else b"x" * n for n in sizes], pa.binary())], names=["id", "content"])
        batches.PART_BYTES = 8
        try:
            got = list(batches.parts(batch, "content"))
        finally:
            batches.PART_BYTES = 4 << 20
        assert [i for b in got for i in b.column(0).to_pylist()] == list(range(len(sizes)))
        assert all(b.num_rows == 1 or sum(len(x or b"") for x in b.column(1).to_pylist()[:-1]) < 16 for b in got)
        assert len(got) == {0: 0, 1: 1, 7: 3, 2: 1}[len(sizes)]


class _Frame:
    """A table whose mapInArrow runs here, to see what a task sends on."""

    def __init__(self, schema, batch):
        self.schema, self.batch = schema, batch

    def select(self, *_):
        return self

    def join(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return list(run(iter([self.batch])))


def test_files_leave_in_parts(spark, monkeypatch):
    monkeypatch.setattr(batches, "PART_BYTES", 2000)
    data = written([{"Type": Name("Catalog"), "Pages": Ref(2)}, {"Type": Name("Pages"), "Kids": [Ref(3)], "Count": 1}, {"Type": Name("Page"), "Parent": Ref(2), "MediaBox": [0, 0, 9, 9]}])
    n = 50
    cols = {"path": pa.array(map(str, range(n))), "content": pa.array([data] * n, pa.binary()), "page_ids": pa.array([[0]] * n, pa.list_(pa.int32())), "_drawn": pa.array([[{"page": 0, "operators": "q Q"}]] * n)}
    schema = spark.createDataFrame([], "path string, content binary, page_ids array<int>").schema
    for made in (pages.subsets_of(_Frame(schema, pa.RecordBatch.from_pydict(cols))), render.with_overlays(_Frame(schema, pa.RecordBatch.from_pydict(cols)), spark.createDataFrame([], "path string, page int, operators string"))):
        assert sum(b.num_rows for b in made) == n and len(made) > 5
        assert {e for b in made for e in b.column(b.num_columns - 1).to_pylist()} == {None}
