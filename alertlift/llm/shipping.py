"""Executors need this package to run its tasks; Spark distributes it.

Batches sent to Python are bounded by bytes, too: long texts would make batches of ten thousand rows large, and they
are held in the executor's memory several times over (in Spark's buffers, in the pipe and in the worker).
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Set where the session has Spark's own default.
_BATCH, _DEFAULT, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session's Python files, once per application; returns the session."""
    if spark.conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        spark.conf.set(_BATCH, _BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, file.relative_to(package.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark
