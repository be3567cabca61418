"""Giving executors this package, where they don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once a Spark application."""
    sc = spark.sparkContext
    if not getattr(sc, "_granary_shipped", False):
        at = os.path.join(getattr(sc, "_temp_dir", None) or tempfile.mkdtemp(), "granary_src.zip")
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted((_ROOT / "granary").rglob("*.py")):
                z.write(p, str(p.relative_to(_ROOT)))
        sc.addPyFile(at)
        sc._granary_shipped = True
    return spark
