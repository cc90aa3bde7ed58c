"""Keeping the index up to date from a folder of change files.

Each micro-batch is folded to one row a message (the last by ts, then seq) and added to the index as
a part. The batch's number is committed with the part, in one manifest, so a batch that is run again
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.index import Index

STREAM = "changes"


_AT = ("ts", "seq", "__h")


def _marked(batch: DataFrame) -> DataFrame:
    """__h: of all columns, so that of rows alike in ts and seq the same one is last whatever is read of it."""
    return batch.withColumn("__h", F.xxhash64(*[F.col(f"`{c}`") for c in batch.columns]))


def folded(batch: DataFrame) -> DataFrame:
    """The last row of each id."""
    marked = batch if "__h" in batch.columns else _marked(batch)
    row = F.struct(*[F.col(f"`{c}`") for c in marked.columns if c != "__h"])
    # rows meet before they are sorted, else texts would be sorted on both sides of the shuffle
    return marked.repartition("id").groupBy("id").agg(F.max_by(row, F.struct(*_AT)).alias("row")).select("row.*")


def apply_batch(index: Index, batch: DataFrame, batch_id: int, stream: str = STREAM) -> None:
    """batch: columns of messages; op (upsert or delete), ts, seq; places: array of (account, mailbox, read, flagged), all that a message has."""
    marked = _marked(batch)
    # texts go through one shuffle, for the messages alone, and not those of deletes
    kept = ("id", "op", "ts", "seq", "__h")
    texts = [F.col(f"`{c}`") if c in kept else F.when(F.col("op") == "upsert", F.col(f"`{c}`")).alias(c) for c in marked.columns if c != "places"]
    more = folded(marked.select(*texts)).where("op = 'upsert'")
    last = folded(marked.select(*kept, "places"))
    places = last.where("op = 'upsert'").select(F.col("id").alias("message"), F.explode("places").alias("p")).select("message", "p.account", "p.mailbox", "p.read", "p.flagged")
    index.apply(more, places, last.where("op = 'delete'").select("id"), batch=(stream, batch_id))


def sync_stream(spark: SparkSession, changes: str, schema: str, path: str, checkpoint: str, every: str | None = None, stream: str = STREAM):
    """A started query: all that is there and then stop, or with ``every`` (as "10 minutes") again and again."""
    index = Index(spark, path)
    rows = spark.readStream.schema(schema).parquet(changes)
    writer = rows.writeStream.foreachBatch(lambda df, n: apply_batch(index, df, n, stream)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
