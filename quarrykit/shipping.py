"""The package's own code on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once a Spark context, so that Python functions find it on any cluster."""
    context = spark.sparkContext
    if getattr(context, "_quarrykit_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quarrykit-code-"), "quarrykit.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("quarrykit", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._quarrykit_shipped = True
    return spark
