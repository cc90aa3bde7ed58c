"""Small files and folders on whatever file system a path names, through Hadoop's API."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """A folder. Paths are relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self.root, self._path, self._utils = root.rstrip("/"), jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _at(self, name: str):
        return self._path(self.path(name))

    def names(self) -> list[str]:
        root = self._path(self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root)) if self._fs.exists(root) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def age(self, name: str, now: float) -> float:
        """Seconds since a file was written."""
        return now - self._fs.getFileStatus(self._at(name)).getModificationTime() / 1000

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._at(name)).getLength()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._utils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str = "") -> bool:
        """Writes a new file; False if there is one."""
        if self.exists(name):
            return False
        try:
            stream = self._fs.create(self._at(name), False)
        except Exception:  # noqa: BLE001 - lost the race, as file systems say in ways of their own
            if self.exists(name):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    @staticmethod
    def fresh(prefix: str) -> str:
        return f"{prefix}-{uuid.uuid4().hex}"
