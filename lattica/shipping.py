"""Sends the library's modules to the executors, which unpickle functions of it by name."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_modules(spark: SparkSession) -> None:
    """Once for each application; workers need neither an installed copy nor the driver's working folder."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    name = f"{tempfile.mkdtemp(prefix='lattica-')}/{top.name}.zip"
    with zipfile.ZipFile(name, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    spark.sparkContext.addPyFile(name)  # Spark serves it from there for as long as it runs
    _SHIPPED.add(app)
