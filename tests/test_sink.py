"""Commits and aborts of the sink, and reruns of its tasks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quireworks.sources import files, sink


def tree(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def rows(spark, n, start=0):
    return spark.range(start, start + n).select(F.concat(F.lit("d"), "id").alias("name"), F.lit("x").alias("digest"), F.lit("done").alias("status"), F.concat(F.lit("d"), "id", F.lit("/a.md")).alias("path"), F.encode(F.concat(F.lit("text "), "id"), "UTF-8").alias("content"))


def test_commit(spark, tmp_path):
    sink.write(rows(spark, 7).repartition(3), str(tmp_path))
    sink.write(rows(spark, 2, 6).unionByName(spark.createDataFrame([("bad", "y", "rejected", "why")], "name string, digest string, status string, reason string"), allowMissingColumns=True), f"file://{tmp_path}")
    got = tree(tmp_path)
    assert [x for x in got if not x.startswith("_")] == [f"d{i}/a.md" for i in range(8)] and sum(x.startswith("_manifest/") for x in got) == 2 and len(got) == 10
    assert (tmp_path / "d7/a.md").read_bytes() == b"text 7"
    found = sink.manifest(spark, str(tmp_path)).collect()
    assert sorted(r.name for r in found) == sorted([*(f"d{i}" for i in range(8)), "d6", "bad"])
    assert {r.name: (r.status, r.reason, r.files) for r in found}["bad"] == ("rejected", "why", [])
    assert next(r.files[0].asDict() for r in found if r.name == "d0") == {"path": "d0/a.md", "bytes": 6}
    sink.write(rows(spark, 0), str(tmp_path))
    assert tree(tmp_path) == got


def test_abort_leaves_nothing(spark, tmp_path):
    sink.write(rows(spark, 1), str(tmp_path))
    before = tree(tmp_path)
    broken = rows(spark, 40).repartition(4).withColumn("content", F.when(F.col("name") == "d33", F.raise_error(F.lit("stop"))).otherwise(F.encode(F.lit("new"), "UTF-8")))
    with pytest.raises(Exception, match="stop"):
        sink.write(broken, str(tmp_path))
    assert tree(tmp_path) == before and not (tmp_path / "_staging").exists()
    assert (tmp_path / "d0/a.md").read_bytes() == b"text 0"
    for path in ("../x", "/etc/x", "a/../../x", "_manifest/x", ""):
        with pytest.raises(Exception, match="no path below"):
            sink.write(rows(spark, 1).withColumn("path", F.lit(path)), str(tmp_path))
    assert tree(tmp_path) == before


def test_a_task_that_runs_twice(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sink.TaskContext, "get", lambda: type("T", (), {"partitionId": staticmethod(lambda: 0)}))
    writer = sink.FilesWriter(str(tmp_path))
    batch = pa.RecordBatch.from_pylist([{"name": "a", "digest": None, "status": None, "reason": None, "path": p, "content": b"1"} for p in ("a/x", "a/y", "a/x")])
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    assert len([x for x in tree(tmp_path) if x.startswith("_staging")]) == 4
    writer.commit([kept, None])
    assert [x for x in tree(tmp_path) if not x.startswith("_")] == ["a/x", "a/y"] and not (tmp_path / "_staging").exists()
    assert lost.files[0][0] != kept.files[0][0]
    other = sink.FilesWriter(str(tmp_path))
    other.write(iter([batch]))
    other.abort([None])
    assert not (tmp_path / "_staging").exists()


def test_documents_are_written_at_once(spark, tmp_path):
    docs = spark.createDataFrame([("a", "# Ä", json.dumps({"é": [1]})), ("b", "", None)], "name string, markdown string, document string")
    files.write_documents(docs, str(tmp_path))
    assert (tmp_path / "a/a_middle.json").read_text() == '{\n    "é": [\n        1\n    ]\n}' and (tmp_path / "b/b.md").read_text() == ""
