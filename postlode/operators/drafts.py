"""Drafts: retention, the ledger of sends, and the log of changes folded to state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

PENDING_DAYS, SENT_DAYS, WINDOW_SECONDS, NEWEST = 7, 30, 2 * 3600, 25


def expired(files: DataFrame, now: int, pending_days: int = PENDING_DAYS, sent_days: int = SENT_DAYS) -> DataFrame:
    """Rows of files (path, mtime) that retention removes: .eml older than their folder allows, by strict comparison."""
    days = F.when(F.col("path").rlike(r"(^|/)sent/[^/]*$"), sent_days).otherwise(pending_days)
    return files.where(F.col("path").endswith(".eml") & (F.col("mtime") < F.lit(now) - days * 86400))


def recorded(ledger: DataFrame, subject: str, to: list[str], now: float, window: float = WINDOW_SECONDS) -> DataFrame:
    """The ledger (subject, to, at) within the window, and a new entry; addresses in lower case."""
    entry = ledger.sparkSession.createDataFrame([(subject, [t.lower() for t in to], float(now))], "subject string, to array<string>, at double")
    return ledger.where(F.lit(float(now)) - F.col("at") < window).select("subject", "to", "at").unionByName(entry)


def leftovers(drafts: DataFrame, ledger: DataFrame, now: float, window: float = WINDOW_SECONDS, bare: bool = True) -> DataFrame:
    """Drafts (id, subject, to, date_received) that a recent send left: the NEWEST ones of equal subject and a common address.

    bare: entries of the ledger are compared by their addresses too; False compares whole entries.
    """
    recent = ledger.where(F.lit(float(now)) - F.col("at") < window)
    sent = F.array_distinct(F.flatten(F.transform("to", X.addresses))) if bare else F.col("to")
    recent = recent.select(F.col("subject").alias("__s"), sent.alias("__to"))
    newest = drafts.orderBy(F.desc("date_received"), F.desc("id")).limit(NEWEST)
    own = newest.withColumn("__own", F.array_distinct(F.flatten(F.transform("to", X.addresses))))
    return own.join(recent, (F.col("subject") == F.col("__s")) & F.arrays_overlap("__own", "__to"), "left_semi").drop("__own")


#: What each action of the log sets.
ATTRIBUTES = {"mark_as_read": "read", "mark_as_unread": "read", "flag": "flag", "move": "mailbox", "delete": "mailbox"}


def folded_log(log: DataFrame) -> DataFrame:
    """id, attribute, value: the last change of each attribute in log (id, action, arg, ts, seq)."""
    kind = F.create_map(*[F.lit(x) for kv in ATTRIBUTES.items() for x in kv])
    value = F.when(F.col("action") == "mark_as_read", "1").when(F.col("action") == "mark_as_unread", "0").when(F.col("action") == "delete", "Trash").otherwise(F.col("arg"))
    changes = log.select("id", F.try_element_at(kind, F.col("action")).alias("attribute"), value.alias("value"), "ts", "seq").where("attribute is not null")
    return changes.groupBy("id", "attribute").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))


def changed(locations: DataFrame, log: DataFrame, trash: str = "Trash") -> DataFrame:
    """locations with the log's changes: read and flag states, and moved or deleted messages at their new place only."""
    state = folded_log(log).groupBy("id").agg(*[F.max(F.when(F.col("attribute") == a, F.struct("value"))).alias(a) for a in ("read", "flag", "mailbox")])
    state = state.select(F.col("id").alias("__id"), *[F.col(a).alias(f"__{a}") for a in ("read", "flag", "mailbox")])
    flagged = F.coalesce(F.col("__flag.value"), F.lit("")) != ""
    rows = locations.join(state, F.col("message") == F.col("__id"), "left")
    own = [
        F.coalesce(F.col("__mailbox.value"), F.col("mailbox")).alias("mailbox"),
        F.when(F.col("__read").isNotNull(), F.col("__read.value").cast("int")).otherwise(F.col("read")).alias("read"),
        F.when(F.col("__flag").isNotNull(), flagged.cast("int")).otherwise(F.col("flagged")).alias("flagged"),
    ]
    rows = rows.select("message", "account", *own, F.col("__mailbox").isNotNull().alias("__moved"))
    # a moved message has one place in an account, however many it had
    still, moved = rows.where("not __moved").drop("__moved"), rows.where("__moved").drop("__moved")
    return still.unionByName(moved.groupBy("message", "account", "mailbox").agg(F.max("read").alias("read"), F.max("flagged").alias("flagged")))
