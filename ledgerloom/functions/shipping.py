"""Making this package importable on executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package's code to the Python workers of all executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        top = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="ledgerloom-")  # the driver serves it to the executors as long as it lives
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(f"{folder}/{top.name}-{uuid.uuid4().hex}", "zip", top.parent, top.name))
