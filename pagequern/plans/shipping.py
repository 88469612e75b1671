"""Makes the package importable in Python workers that do not see its folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends a zip of the package to the workers, once an application, unless their path holds it."""
    root = str(PACKAGE.parent)
    seen = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if app in _shipped or root in seen or os.path.realpath(os.getcwd()) == root:
        return
    _shipped.add(app)
    path = os.path.join(tempfile.mkdtemp(), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in PACKAGE.rglob("*.py"):
            z.write(f, f.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(path)
