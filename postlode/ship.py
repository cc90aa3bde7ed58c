"""Makes this package importable in Python workers, and their batches of a size for whole texts."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_postlode_shipped", False):
        return spark
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="postlode-"), "postlode_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(here):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("postlode", os.path.relpath(full, here)))
    sc.addPyFile(archive)
    if spark.conf.get(BATCH, "10000") == "10000":  # Spark's default; a setting of the session's own stays
        spark.conf.set(BATCH, "1000")
    sc._postlode_shipped = True
    return spark
