"""Makes the package importable on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _DONE:
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp()) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(path))
    _DONE.add(sc.applicationId)
