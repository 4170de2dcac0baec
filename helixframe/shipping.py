"""Gets the package to the executors of a session whose launcher hasn't put it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's modules to the session's Python files, once for each application.

    Workers import the functions that run there; with PYTHONPATH naming the package's root they find them already.
    Spark's own file server sends the archive, so no shared folder is needed.
    """
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in map(os.path.realpath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="helixframe-"), "helixframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(Path(__file__).resolve().parent.rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
