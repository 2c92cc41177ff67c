"""Sending the package to Python workers that have it neither installed nor on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Adds this package's modules to the session's Python files, once a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_lodestrata_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="lodestrata-")) / "lodestrata.zip"
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(PACKAGE.rglob("*.py")):
            z.write(source, f"{PACKAGE.name}/{source.relative_to(PACKAGE)}")
    context.addPyFile(str(path))
    context._lodestrata_shipped = True
