"""The store's relational side: its newest version, and its SQLite tables as a Spark source."""

from __future__ import annotations

import os
import re
import shutil
import sqlite3
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..errors import ArchiveError

SCHEMAS = {
    "mailboxes": "rowid long, url string, total_count long",
    "messages": "rowid long, mailbox long, deleted int, date_received long, size long, conversation_id long, read int, flagged int, subject long, sender long",
    "labels": "message_id long, mailbox_id long",
    "subjects": "rowid long, subject string",
    "addresses": "rowid long, address string, comment string",
    "recipients": "message long, address long, position long",
    "attachments": "message long, name string, position long",
}


def find_store(root: str) -> str:
    """The version folder V<number> of the highest number."""
    found = [(int(m[1]), m[0]) for m in (re.fullmatch(r"V(\d+)", n) for n in (os.listdir(root) if os.path.isdir(root) else ())) if m]
    if not found:
        raise FileNotFoundError(f"no store under {root}")
    return os.path.join(root, max(found)[1])


def snapshot(path: str, workspace: str | None = None) -> str:
    """A copy of a database with its log, so that a writer doesn't disturb reads."""
    folder = tempfile.mkdtemp(dir=workspace)
    for suffix in ("-shm", "-wal", ""):
        if os.path.isfile(path + suffix):
            shutil.copy2(path + suffix, os.path.join(folder, os.path.basename(path) + suffix))
    return os.path.join(folder, os.path.basename(path))


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.fields, self.path, self.name = schema.fieldNames(), options["path"], options["table"]
        self.parts = int(options.get("partitions", 8))
        if not re.fullmatch(r"\w+", self.name):
            raise ValueError(f"not a table: {self.name!r}")

    def _connect(self):
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        """Ranges of rowid."""
        with self._connect() as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.name}"').fetchone()
        if low is None:
            return [_Range(0, -1)]
        step = (high - low) // self.parts + 1
        return [_Range(s, min(s + step - 1, high)) for s in range(low, high + 1, step)]

    def read(self, partition):
        cols = ", ".join("rowid" if f in ("rowid", "position") else f'"{f}"' for f in self.fields)
        with self._connect() as c:
            yield from c.execute(f'SELECT {cols} FROM "{self.name}" WHERE rowid BETWEEN ? AND ? ORDER BY rowid', (partition.low, partition.high))


class SqliteSource(DataSource):
    """format("sqlite_table"), options path, table, partitions: a table of a SQLite file that every worker can open."""

    @classmethod
    def name(cls):
        return "sqlite_table"

    def schema(self):
        return SCHEMAS[self.options["table"]]

    def reader(self, schema):
        return _Reader(schema, self.options)


def tables(path: str) -> set[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        return {r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}


def open_store(spark: SparkSession, path: str, partitions: int = 8) -> dict[str, DataFrame]:
    """The store's tables that are there; a database that isn't is an error."""
    if not os.path.exists(path):
        raise ArchiveError("store_missing", f"No database at {path}.")
    from ..ship import ship

    ship(spark).dataSource.register(SqliteSource)
    return {t: spark.read.format("sqlite_table").option("path", path).option("table", t).option("partitions", partitions).load() for t in SCHEMAS if t in tables(path)}
