"""Gives the executors this package, so that functions sent to them find it wherever the driver was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application: the package's sources as an archive that Spark hands to every worker."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    if root.is_dir():  # else it runs from an archive that the workers have already
        place = Path(tempfile.mkdtemp(prefix="tessera-")) / f"{root.name}.zip"
        with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as made:
            for source in sorted(root.rglob("*.py")):
                made.write(source, source.relative_to(root.parent))
        context.addPyFile(str(place))
    _SHIPPED.add(context.applicationId)
