"""Sends this package to a session's executors, so that workers can import it wherever they run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Once a session; Spark's own file server brings the archive to executors, late ones too."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        root = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="quireworks-"))  # the driver serves the archive from here
        atexit.register(shutil.rmtree, target, True)
        copy = target / "src" / root.name
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(str(target / "quireworks"), "zip", copy.parent)
        spark.sparkContext.addPyFile(archive)
        _sent.add(app)
    return spark
