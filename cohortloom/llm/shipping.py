"""Makes this package importable in Python workers, also where only the driver has it on its path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add a zip of the package to the application once; Spark hands it to every executor."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    with tempfile.NamedTemporaryFile(suffix=".zip", prefix=f"{package.name}-", delete=False) as target:
        with zipfile.ZipFile(target, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
    context.addPyFile(target.name)
    _shipped.add(context.applicationId)
