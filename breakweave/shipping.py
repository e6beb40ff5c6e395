"""The package on the executors: Python operators there import it by name."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to all executors, once per application. Where it is installed on them, that is not needed."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="breakweave-")
    # Only the driver reads this file; Spark hands it on.
    context.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name))
    _SENT.add(context.applicationId)
