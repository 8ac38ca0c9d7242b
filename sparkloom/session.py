"""Makes the package importable on executors that don't have this repository."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once for each SparkContext."""
    context = spark.sparkContext
    if not getattr(context, "_sparkloom_shipped", False):
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "sparkloom.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, names in os.walk(os.path.join(top, "sparkloom")):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, top))
        context.addPyFile(target)
        context._sparkloom_shipped = True
    return spark
