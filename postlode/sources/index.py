"""The index: messages, locations and postings in immutable parts, named by numbered manifests.

A manifest lists the parts that make the index; the readable one of the greatest number counts, and
a writer that finds its number taken has lost to another. A build writes one part. A change adds a
part with the new rows, and the ids whose rows in earlier parts are void: nothing else is
rewritten. Every COMPACT parts the index is written as one part again. What no manifest of the last
KEEP lists is deleted. All of it goes through Hadoop's file systems.

Messages of a built part are ordered by date within files, so that date filters skip row groups.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import ArchiveError
from ..operators import fulltext
from .files import Files

LOCK_SECONDS, DEAD_SECONDS, LOCK = 1800, 60, "SYNC.lock"
COMPACT, KEEP = 12, 3
_ID = {"messages": "id", "locations": "message", "postings": "id"}


def _name(number: int) -> str:
    return f"manifest-{number:012d}.json"


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Files(spark, path)

    # manifests

    def _numbers(self) -> list[int]:
        return sorted(int(n.split("-")[1].split(".")[0]) for n in self.files.names() if n.startswith("manifest-"))

    def _read(self, number: int) -> dict | None:
        try:
            value = json.loads(self.files.read(_name(number)))
            return value if isinstance(value, dict) and "parts" in value else None
        except Exception:  # noqa: BLE001 - half-written by a writer that died, or gone meanwhile
            return None

    def manifest(self) -> dict | None:
        return next((m for n in reversed(self._numbers()) if (m := self._read(n)) is not None), None)

    def _need(self) -> dict:
        m = self.manifest()
        if m is None:
            raise ArchiveError("index_missing", f"No index at {self.files.root}.", "Build it first.")
        return m

    def _commit(self, after: dict | None, parts: list[dict], now: float | None, batches: dict, schemas: dict) -> dict:
        """The next manifest after the one that the change is based on; if there is another by now, the new parts go and the change fails."""
        number = after["number"] + 1 if after else 0
        while self.files.exists(_name(number)) and self._read(number) is None and self.files.age(_name(number), time.time()) > DEAD_SECONDS:
            number += 1  # what a writer left that died
        m = {"number": number, "parts": parts, "last_build": time.time() if now is None else now, "batches": batches, "schemas": schemas}
        if not self.files.create(_name(number), json.dumps(m)):
            for p in parts:
                if p not in (after or {"parts": []})["parts"]:
                    self.files.delete(p["name"])
            raise ArchiveError("index_busy", "Another writer changed the index meanwhile.", "Try again.")
        self._swept()
        return m

    def _swept(self) -> None:
        numbers = self._numbers()
        kept = {p["name"] for n in numbers[-KEEP:] for p in (self._read(n) or {"parts": []})["parts"]}
        old = {p["name"] for n in numbers[:-KEEP] for p in (self._read(n) or {"parts": []})["parts"]}
        for name in old - kept:
            self.files.delete(name)
        for n in numbers[:-KEEP]:
            self.files.delete(_name(n))

    # writing

    def _written(self, messages: DataFrame, locations: DataFrame) -> tuple[dict, DataFrame]:
        """The new part, and its messages as written."""
        name = self.files.fresh("part")
        messages.write.parquet(self.files.path(f"{name}/messages"))
        locations.write.parquet(self.files.path(f"{name}/locations"))
        # postings are of what was written, so that the source is read once
        there = self.spark.read.schema(messages.schema).parquet(self.files.path(f"{name}/messages"))
        fulltext.write(fulltext.blocks(there), self.files.path(f"{name}/postings"))
        return {"name": name, "blocks": True}, there

    def _whole(self, messages: DataFrame, locations: DataFrame) -> dict:
        """A part that is the whole index; unique: whether no id is there twice."""
        part, there = self._written(self._by_date(messages), locations)
        return {**part, "unique": there.agg(F.count("id") == F.count_distinct("id")).first()[0]}

    @staticmethod
    def _by_date(messages: DataFrame) -> DataFrame:
        return messages.repartitionByRange("date_received").sortWithinPartitions("date_received") if "date_received" in messages.columns else messages

    def build(self, messages: DataFrame, locations: DataFrame, now: float | None = None) -> dict:
        """Writes the whole index; it replaces what there is."""
        schemas = {"messages": messages.schema.json(), "locations": locations.schema.json()}
        part = self._whole(messages, locations)
        return self._commit(self.manifest(), [part], now, {}, schemas)

    def apply(self, more: DataFrame, places: DataFrame, removed: DataFrame, moved: DataFrame | None = None, now: float | None = None, batch: tuple[str, int] | None = None) -> dict:
        """Adds or replaces messages (more, with all their locations in places) and removes those in removed (id).

        moved (id): held messages whose locations only are replaced by those in places. batch: a
        stream's name and number; one that is in already changes nothing.
        """
        m = self._need()
        if batch and m["batches"].get(batch[0], -1) >= batch[1]:
            return m
        schema = {k: StructType.fromJson(json.loads(v)) for k, v in m["schemas"].items()}
        own = {"messages": more, "locations": places}
        own = {k: df.select(*[F.col(f.name).cast(f.dataType) for f in schema[k]]) for k, df in own.items()}
        part, there = self._written(own["messages"], own["locations"])
        name = part["name"]
        gone = removed.select(F.col("id").cast("long").alias("id")).unionByName(there.select(F.col("id").cast("long").alias("id")))
        gone.distinct().write.parquet(self.files.path(f"{name}/gone"))
        if moved is not None:
            moved.select(F.col("id").cast("long").alias("id")).distinct().write.parquet(self.files.path(f"{name}/moved"))
        part |= {"gone": True, "moved": moved is not None}
        batches = {**m["batches"], **({batch[0]: batch[1]} if batch else {})}
        m = self._commit(m, [*m["parts"], part], now, batches, m["schemas"])
        return self.compact() if len(m["parts"]) > COMPACT else m

    def touched(self, now: float | None = None) -> dict:
        """The same index, known to be up to date."""
        m = self._need()
        return self._commit(m, m["parts"], now, m["batches"], m["schemas"])

    def compact(self) -> dict:
        """Writes the index as one part."""
        m = self._need()
        part = self._whole(self.messages(m), self.locations(m))
        return self._commit(m, [part], m["last_build"], m["batches"], m["schemas"])

    # reading

    def _blocks(self, part: dict) -> DataFrame:
        return self.spark.read.schema(fulltext.BLOCKS).parquet(self.files.path(f"{part['name']}/postings"))

    def _opened(self, part: dict, where: Column | None, positions: bool) -> DataFrame:
        """Postings of a part; those written before there were blocks have a row each."""
        rows = self._blocks(part) if part.get("blocks") else self.spark.read.schema(fulltext.SCHEMA).parquet(self.files.path(f"{part['name']}/postings"))
        rows = rows if where is None else rows.where(where)
        return fulltext.opened(rows, positions) if part.get("blocks") else rows

    def _table(self, m: dict, table: str, read: StructType | Callable[[dict], DataFrame]) -> DataFrame:
        """The rows of all parts but void ones; read: the schema, or a function of a part."""
        parts, key = m["parts"], _ID[table]
        if isinstance(schema := read, StructType):
            read = lambda p: self.spark.read.schema(schema).parquet(self.files.path(f"{p['name']}/{table}"))
        if len(parts) == 1:
            return read(parts[0])
        void = None
        for i, p in enumerate(parts):
            for kind in ("gone", "moved") if table == "locations" else ("gone",):
                if p.get(kind):
                    ids = self.spark.read.schema("id long").parquet(self.files.path(f"{p['name']}/{kind}")).select(F.col("id").alias("__void"), F.lit(i).alias("__since"))
                    void = ids if void is None else void.unionByName(ids)
        whole = None
        for i, p in enumerate(parts):
            rows = read(p).withColumn("__part", F.lit(i))
            whole = rows if whole is None else whole.unionByName(rows)
        if void is None:
            return whole.drop("__part")
        last = void.groupBy("__void").agg(F.max("__since").alias("__since"))
        return whole.join(last, (F.col(key) == F.col("__void")) & (F.col("__part") < F.col("__since")), "left_anti").drop("__part")

    def messages(self, m: dict | None = None) -> DataFrame:
        m = m or self._need()
        return self._table(m, "messages", StructType.fromJson(json.loads(m["schemas"]["messages"])))

    def locations(self, m: dict | None = None) -> DataFrame:
        m = m or self._need()
        return self._table(m, "locations", StructType.fromJson(json.loads(m["schemas"]["locations"])))

    def postings(self, m: dict | None = None, where: Column | None = None, positions: bool = True) -> DataFrame:
        """where: a condition on term and bucket, met before blocks are opened."""
        return self._table(m or self._need(), "postings", lambda p: self._opened(p, where, positions))

    def terms(self) -> DataFrame:
        """term, messages that have it, places."""
        m = self._need()
        only = m["parts"][0]
        if len(m["parts"]) == 1 and only.get("blocks") and only.get("unique"):
            return fulltext.terms_of_blocks(self._blocks(only))
        return fulltext.terms(self.postings(m))

    def find(self, query: str) -> tuple[DataFrame, str]:
        """(ids that match, query as interpreted), from the postings alone."""
        return fulltext.find(lambda where, positions: self.postings(None, where, positions), query)

    # freshness

    def age_minutes(self, now: float | None = None) -> float | None:
        m = self.manifest()
        return None if m is None else ((time.time() if now is None else now) - float(m["last_build"])) / 60

    def refresh_if_stale(self, sync: Callable[[], dict], max_age_minutes: float = 10, now: float | None = None) -> dict:
        """Runs sync when the index is older than allowed, under a lock; any failure leaves the old index, and says so."""
        age = self.age_minutes(now)
        if age is None or age <= max_age_minutes:
            return {"synced": False, "index_age_minutes": round(age or 0.0, 1)}
        if self.files.exists(LOCK) and self.files.age(LOCK, time.time()) > LOCK_SECONDS:
            self.files.delete(LOCK)
        stale = {"synced": False, "index_age_minutes": round(age, 1)}
        if not self.files.create(LOCK):
            return {**stale, "sync_note": "already running"}
        try:
            result = sync() or {}
            return {"synced": True, "index_age_minutes": 0.0, "sync_added": result.get("added", 0), "sync_removed": result.get("removed", 0)}
        except ArchiveError as e:
            return {**stale, "sync_note": f"{e.code}: {e.message}", "sync_hint": e.hint}
        except Exception as e:  # noqa: BLE001 - a search must not fail because a sync did
            return {**stale, "sync_note": f"sync_failed: {str(e)[:500]}", "sync_hint": None}
        finally:
            self.files.delete(LOCK)

    def status(self, now: float | None = None) -> dict:
        """Counts, accounts and dates of the index, its age in hours and its size in bytes."""
        from ..operators import search

        m = self._need()
        messages, locations = self.messages(m), self.locations(m)
        row = search.status_counts(messages, locations).first().asDict()
        per = {r["account"]: r["n"] for r in search.accounts(messages).collect()}
        size = sum(self.files.size(p["name"]) for p in m["parts"])
        return {"ok": True, **row, "accounts": per, "last_build": m["last_build"], "age_hours": round(self.age_minutes(now) / 60, 1), "size_bytes": size}
