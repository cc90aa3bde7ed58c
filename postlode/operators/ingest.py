"""From the store's tables to messages and locations; sync by difference; data checks.

Store tables: mailboxes (rowid, url, total_count), messages (rowid, mailbox, deleted,
date_received, size, conversation_id, read, flagged, subject, sender), labels (message_id,
mailbox_id), subjects (rowid, subject), addresses (rowid, address, comment), recipients (message,
address, position), attachments (message, name, position).
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArchiveError
from ..functions import text as X

BODY_LIMIT = 200_000
REQUIRED = ("messages", "mailboxes", "labels", "subjects", "addresses", "recipients", "attachments")


def parsed_mailboxes(mailboxes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """mailbox_id, account, path of mailboxes whose URL parses; names: account uuid -> display name, else the uuid."""
    m = mailboxes.select("rowid", X.mailbox_url(F.col("url")).alias("u")).where("u is not null")
    m = m.select(F.col("rowid").alias("mailbox_id"), F.col("u.account").alias("uuid"), X.nfc(F.col("u.path")).alias("path"))
    if names is None:
        return m.select("mailbox_id", F.col("uuid").alias("account"), "path")
    n = names.select(F.col("uuid").alias("__u"), "name")
    return m.join(n, F.col("uuid") == F.col("__u"), "left").select("mailbox_id", F.coalesce("name", "uuid").alias("account"), "path")


def membership(messages: DataFrame, labels: DataFrame) -> DataFrame:
    """message, mailbox_id: the primary mailbox of what isn't deleted, and every label."""
    own = messages.where("deleted = 0 and mailbox is not null").select(F.col("rowid").alias("message"), F.col("mailbox").alias("mailbox_id"))
    return own.unionByName(labels.select(F.col("message_id").alias("message"), "mailbox_id")).distinct()


def message_rows(messages: DataFrame, subjects: DataFrame, addresses: DataFrame) -> DataFrame:
    """Messages with their subject and sender, where they have one."""
    s = subjects.select(F.col("rowid").alias("__s"), F.col("subject").alias("subject_text"))
    a = addresses.select(F.col("rowid").alias("__a"), "address", "comment")
    m = messages.where("deleted = 0").join(s, F.col("subject") == F.col("__s"), "left").join(a, F.col("sender") == F.col("__a"), "left")
    sender = X.sender(F.col("comment"), F.col("address"))
    return m.select(F.col("rowid").alias("id"), F.coalesce("subject_text", F.lit("")).alias("subject"), sender.alias("sender"), "date_received", "size", "conversation_id", "read", "flagged")


def _joined(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Values of a message in order of position, one space between."""
    ordered = F.array_sort(F.collect_list(F.struct("position", F.col(value).alias("v"))))
    return rows.groupBy(key).agg(ordered.alias("l")).select(key, F.array_join(F.transform("l", lambda x: x["v"]), " ").alias(name))


def recipients_by_message(recipients: DataFrame, addresses: DataFrame) -> DataFrame:
    a = addresses.select(F.col("rowid").alias("__a"), F.concat(F.coalesce("comment", F.lit("")), F.lit(" "), F.coalesce(addresses["address"], F.lit(""))).alias("v"))
    return _joined(recipients.join(a, F.col("address") == F.col("__a")), "message", "v", "recipients")


def attachments_by_message(attachments: DataFrame) -> DataFrame:
    return _joined(attachments.where("name is not null"), "message", "name", "attachments")


def built(store: dict[str, DataFrame], files: DataFrame, parse: Callable[[DataFrame], DataFrame], held: DataFrame | None = None, names: DataFrame | None = None, now: int = 0) -> tuple[DataFrame, DataFrame]:
    """(messages, locations) of the store's messages, but for ids in held (id).

    files: id, path. parse: rows with a path -> id, rfc_id, body. Only new files are parsed; a
    message without a file keeps its metadata. Its account is that of its least known mailbox id.
    """
    rows = message_rows(store["messages"], store["subjects"], store["addresses"])
    if held is not None:
        rows = rows.join(held.select(F.col("id").alias("__h")), F.col("id") == F.col("__h"), "left_anti")
    boxes = parsed_mailboxes(store["mailboxes"], names)
    places = membership(store["messages"], store["labels"]).join(boxes, "mailbox_id")
    account = places.groupBy(F.col("message").alias("__m")).agg(F.min_by("account", "mailbox_id").alias("account"))
    bodies = parse(rows.select("id").join(files, "id")).select(F.col("id").alias("__b"), "rfc_id", "body")
    to = recipients_by_message(store["recipients"], store["addresses"]).withColumnRenamed("message", "__r")
    attached = attachments_by_message(store["attachments"]).withColumnRenamed("message", "__t")
    m = rows.join(account, F.col("id") == F.col("__m"), "left").join(bodies, F.col("id") == F.col("__b"), "left")
    m = m.join(to, F.col("id") == F.col("__r"), "left").join(attached, F.col("id") == F.col("__t"), "left")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    messages = m.select(
        "id", blank("account"), F.nullif("rfc_id", F.lit("")).alias("rfc_id"), "subject", "sender", "date_received", "size", "conversation_id",
        F.lit(now).cast("long").alias("indexed_at"), blank("recipients"), blank("attachments"), blank("body"),
    )
    flags = rows.select("id", "read", "flagged")
    locations = places.join(flags, F.col("message") == F.col("id")).groupBy("message", F.col("path").alias("mailbox"))
    # one path in two accounts is one location: that of the greater mailbox id
    last = F.max_by(F.struct("account", "read", "flagged"), "mailbox_id").alias("l")
    return messages, locations.agg(last).select("message", "l.account", "mailbox", "l.read", "l.flagged")


def gone(held: DataFrame, live: DataFrame) -> DataFrame:
    """Ids held that are no longer live; both have id."""
    return held.select("id").join(live.select(F.col("id").alias("__l")), F.col("id") == F.col("__l"), "left_anti")


def new(held: DataFrame, live: DataFrame) -> DataFrame:
    return gone(live, held)


def applied(old: DataFrame, delta: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """old without removed (id) and without the keys of delta, and delta."""
    r = removed.select(F.col("id").alias("__k")).unionByName(delta.select(F.col(key).alias("__k"))).distinct()
    return old.join(r, F.col(key) == F.col("__k"), "left_anti").unionByName(delta)


def synced(index: tuple[DataFrame, DataFrame], store: dict[str, DataFrame], files: DataFrame, parse, refresh_locations: bool = False, now: int = 0, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The next (messages, locations). Held messages are not parsed again, and keep their locations unless those are refreshed."""
    messages, locations = index
    live = store["messages"].where("deleted = 0").select(F.col("rowid").alias("id"))
    removed = gone(messages, live)
    more, places = built(store, files, parse, messages.select("id"), names, now)
    if refresh_locations:
        _, every = built(store, files.limit(0), lambda d: d.select("id", F.lit("").alias("rfc_id"), F.lit("").alias("body")), None, names, now)
        return applied(messages, more, removed, "id"), every
    return applied(messages, more, removed, "id"), applied(locations, places, removed, "message")


def sync_index(index, store: dict[str, DataFrame], files: DataFrame, parse, refresh_locations: bool = False, now: int | None = None, names: DataFrame | None = None, drafts: str | None = None) -> dict:
    """Brings an index (sources.index.Index) up to date with the store; added, removed, and the drafts that were swept.

    Held messages are not parsed again; with refresh_locations all locations are those of now. Any
    failure is an ArchiveError: permission_denied, or sync_failed. A failure to sweep drafts is none.
    """
    try:
        live = store["messages"].where("deleted = 0").select(F.col("rowid").alias("id"))
        held = index.messages().select("id")
        removed, moved = gone(held, live).select("id"), None
        added, lost = new(held, live).count(), removed.count()  # of ids alone
        more, places = built(store, files, parse, held, names, int(now or time.time()))
        if refresh_locations:
            _, places = built(store, files.limit(0), lambda d: d.select("id", F.lit("").alias("rfc_id"), F.lit("").alias("body")), None, names, 0)
            moved = held
        if added or lost or refresh_locations:
            index.apply(more, places, removed, moved, now)
        else:
            index.touched(now)
    except ArchiveError:
        raise
    except Exception as e:
        text = str(e)
        if isinstance(e, PermissionError) or "Permission denied" in text or "Operation not permitted" in text:
            raise ArchiveError("permission_denied", "The store can't be read.", "Give this process access to it; what is indexed stays searchable.") from e
        raise ArchiveError("sync_failed", text[:500]) from e
    out = {"ok": True, "added": added, "removed": lost}
    if drafts:
        from ..sources.drafts import purge_drafts

        try:
            swept = purge_drafts(files.sparkSession, drafts)
        except Exception:  # noqa: BLE001 - a sync must not fail over this
            swept = []
        if swept:
            out["purged_drafts"] = swept
    return out


def check_tables(present: set[str]) -> tuple[bool, str]:
    missing = sorted(set(REQUIRED) - set(present))
    return not missing, ", ".join(missing)


def check_membership(places: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """checked, agreeing: mailboxes of more than 100 messages, and those rebuilt to within 2 %."""
    got = places.groupBy("mailbox_id").agg(F.count("*").alias("got"))
    m = mailboxes.where("total_count > 100").join(got, F.col("rowid") == F.col("mailbox_id"), "left")
    near = F.abs(F.coalesce("got", F.lit(0)) - F.col("total_count")) / F.col("total_count") < 0.02
    return m.agg(F.count("*").alias("checked"), F.count_if(near).alias("agreeing"))


def check_file_ratio(messages: DataFrame, files: DataFrame) -> DataFrame:
    """known, total, ratio: messages that have a file."""
    f = files.select(F.col("id").alias("__f")).distinct()
    m = messages.where("deleted = 0").join(f, F.col("rowid") == F.col("__f"), "left")
    a = m.agg(F.count("__f").alias("known"), F.count("*").alias("total"))
    return a.select("known", "total", F.when(F.col("total") > 0, F.col("known") / F.col("total")).otherwise(0.0).alias("ratio"))


def check_dates(messages: DataFrame) -> DataFrame:
    a = messages.where("date_received > 0").agg(F.min("date_received").alias("oldest"), F.max("date_received").alias("newest"))
    return a.select("oldest", "newest", F.coalesce((F.col("newest") > 10**8) & (F.col("newest") < 10**10), F.lit(False)).alias("plausible"))


def sample(messages: DataFrame, files: DataFrame) -> DataFrame:
    """id, path: of the first 200 messages, the first 50 that have a file."""
    first = messages.where("deleted = 0").orderBy("rowid").limit(200).select("rowid")
    return first.join(files, F.col("rowid") == F.col("id"), "left_semi").join(files, F.col("rowid") == F.col("id")).orderBy("id").limit(50).select("id", "path")


def checks(store: dict[str, DataFrame], files: DataFrame, parse) -> DataFrame:
    """check, passed, detail: one row for each of the seven checks; only the first where a table is missing."""
    spark = files.sparkSession
    there, missing = check_tables(set(store))
    rows = [("expected tables present", there, missing)]
    if there:
        total = store["mailboxes"].count()
        ok = parsed_mailboxes(store["mailboxes"]).count()
        rows.append(("mailbox urls parse", ok == total, f"{ok}/{total}"))
        f = check_file_ratio(store["messages"], files).first()
        rows.append(("messages have files", f["ratio"] > 0.9, f"{f['known']}/{f['total']}"))
        m = check_membership(membership(store["messages"], store["labels"]), store["mailboxes"]).first()
        rows.append(("membership agrees with totals", m["checked"] > 0 and m["agreeing"] == m["checked"], f"{m['agreeing']}/{m['checked']}"))
        p = parse(sample(store["messages"], files)).agg(F.count("*").alias("n"), F.count_if(F.col("rfc_id") != "").alias("r"), F.count_if(F.col("body") != "").alias("b")).first()
        for label, k in (("message ids readable", "r"), ("bodies readable", "b")):
            rows.append((label, p[k] > 0.9 * p["n"], f"{p[k]}/{p['n']}"))
        d = check_dates(store["messages"]).first()
        rows.append(("dates are unix seconds", d["plausible"], f"{d['oldest']}..{d['newest']}"))
    return spark.createDataFrame(rows, "check string, passed boolean, detail string")


def gate(report: DataFrame, force: bool = False) -> None:
    failed = [r["check"] for r in report.where("not passed").collect()]
    if failed and not force:
        raise ArchiveError("checks_failed", "Not built: " + ", ".join(failed), "Pass force to build all the same.")
