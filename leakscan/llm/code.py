"""Send this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def sent(spark: SparkSession) -> SparkSession:
    """Add the package's source to the session's Python files, once an application."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        path = f"{tempfile.mkdtemp()}/{PACKAGE.name}.zip"
        with zipfile.ZipFile(path, "w") as archive:
            for file in sorted(PACKAGE.rglob("*.py")):
                archive.write(file, file.relative_to(PACKAGE.parent))
        context.addPyFile(path)
        _sent.add(context.applicationId)
    return spark
