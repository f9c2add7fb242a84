"""Code for the workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once per application, however they were started."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).parents[1]
    target = Path(tempfile.mkdtemp(prefix="quillspark-")) / f"{package.name}-{sc.applicationId}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in package.rglob("*.py"):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
