"""Making this package known to the executors of a cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; grouped functions are looked up in it by name."""
    sc = spark.sparkContext
    if getattr(sc, "_somaframe_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):  # not when it already runs from a shipped archive
        path = os.path.join(tempfile.mkdtemp(prefix="somaframe-"), "somaframe_ship.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(path)
    sc._somaframe_shipped = True
