"""Executors that run Python tasks of this package need its files; Spark distributes them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Add the package to the session's Python files, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        # Code only; the driver serves the file to executors as long as it runs.
        folder = tempfile.mkdtemp(prefix="code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = Path(folder) / f"{package.name}-code.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, file.relative_to(package.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark
