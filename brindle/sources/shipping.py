"""Brings this package to the workers of clusters on which it isn't installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once, unless workers already find it by their
    PYTHONPATH. Spark itself then hands the file to every executor, late ones included."""
    context = spark.sparkContext
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT) in known or context.applicationId in _shipped:
        return
    made = os.path.join(tempfile.mkdtemp(prefix="brindle-"), "brindle.zip")
    with zipfile.ZipFile(made, "w") as z:
        for p in sorted((ROOT / "brindle").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(made)
    _shipped.add(context.applicationId)
