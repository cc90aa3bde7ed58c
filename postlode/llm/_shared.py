"""Storage of intermediate tables, and helpers that the operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession


#: How written() ends the names of its folders.
MADE = re.compile(r"-[0-9a-f]{32}$")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir of the session.

    Only where that is unset, on one machine (as in tests), a folder of our own is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="postlode-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and a lost executor costs a reread only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the tables of written() that df reads, where nothing reads them any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if MADE.search(folder) and folder.removeprefix("file:").lstrip("/").startswith(root.removeprefix("file:").lstrip("/")):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


class Forest:
    """Connected groups of the numbers below n, each with its least member as root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Links i[k] and j[k] for each k."""
        while len(i):
            x, y = self.root[i], self.root[j]
            apart = x != y
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            x, y = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
            np.minimum.at(self.root, y, x)
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
