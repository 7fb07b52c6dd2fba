"""Tables that several branches of a plan read, computed once.

They are Parquet in the folder that ``spark.checkpoint.dir`` names, which all executors share; where none is set (tests on one
machine) a temporary folder stands in for it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table, read back: what is read from it later doesn't compute ``df`` again."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.quarrykit.shared", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="quarrykit-")
        spark.conf.set("spark.quarrykit.shared", folder)
    path = f"{folder.rstrip('/')}/quarrykit-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
