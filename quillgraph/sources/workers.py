"""Python code for executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, which may not find it on their own path; once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_quillgraph_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    file = os.path.join(tempfile.mkdtemp(), "quillgraph.zip")  # read by the driver, which serves it to executors
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(file)
    sc._quillgraph_shipped = True
