"""The package on executors: a session sends it along, so that Python workers can import it from any folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application, once."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="chronotile-"), "chronotile.zip").resolve()
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(path))
    _sent.add(sc.applicationId)
