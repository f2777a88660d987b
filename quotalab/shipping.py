"""Executors get the package as a file: they need not share the driver's folders."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors the package, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        target = Path(tempfile.mkdtemp(prefix="quotalab-")) / "quotalab.zip"
        with zipfile.ZipFile(target, "w") as z:
            for path in sorted(PACKAGE.rglob("*.py")):
                z.write(path, path.relative_to(PACKAGE.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
