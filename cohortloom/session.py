"""What a session needs before the library runs Python inside tasks."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_shipping = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once per application, for the functions that run in their Python workers.

    Trials run in threads of the driver, and a cluster refuses a second file of the same name.
    """
    context = spark.sparkContext
    with _shipping:
        if context.applicationId in _shipped:
            return
        root = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="cohortloom-"), "cohortloom.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, Path(root.name) / source.relative_to(root))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
