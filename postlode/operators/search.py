"""Search, threads, locations and statistics over messages and their locations.

messages: id, account, rfc_id, date_received, size, conversation_id, and the searched columns of
TEXT (those that are missing count as empty).
locations: message, account, mailbox, read, flagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ArchiveError
from ..functions import text as X
from ..functions.match import compiled
from ..functions.values import MessageReference, clamp, timestamp
from .fulltext import TEXT

#: Mailboxes that hold nearly everything, chosen only where there is no other.
BULK = ("[Gmail]/All Mail", "[Gmail]/Important", "[Gmail]/Tous les messages")
NO_SIZE = 10**9
PREVIEWS = 20


def matching(messages: DataFrame, query: str) -> tuple[DataFrame, str]:
    """(rows that match, query as interpreted)."""
    there = [c for c in TEXT if c in messages.columns]
    _, used = compiled(query, {c: F.lit("") for c in TEXT})
    # each column is folded once a row: a lambda's variable is evaluated once, an alias in a filter at every use
    texts = F.array(F.struct(*[X.fold(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in there]))
    found = F.exists(texts, lambda t: compiled(query, {c: t[c] if c in there else F.lit("") for c in TEXT})[0])
    return messages.where(found), used


def _held(messages: DataFrame, locations: DataFrame, where: Column) -> DataFrame:
    ids = locations.where(where).select(F.col("message").alias("__held"))
    return messages.join(ids, F.col("id") == F.col("__held"), "left_semi")


def filtered(messages, locations, since=None, until=None, account=None, mailbox=None, unread_only=False, flagged_only=False, zone=None) -> DataFrame:
    """The given conditions, each on its own: different locations may satisfy account, mailbox and flags.

    Days are those of ``zone``, by default the session's. A bound on second 0 of the epoch is no bound.
    """
    zone = zone or messages.sparkSession.conf.get("spark.sql.session.timeZone")
    low, high = timestamp(since, zone=zone), timestamp(until, end_of_day=True, zone=zone)
    if low:
        messages = messages.where(F.col("date_received") >= low)
    if high:
        messages = messages.where(F.col("date_received") <= high)
    if account:
        messages = _held(messages, locations, X.ascii_lower(F.col("account")) == X.ascii_lower(F.lit(account)))
    if mailbox:
        messages = _held(messages, locations, X.ascii_lower(F.col("mailbox")) == X.ascii_lower(F.lit(mailbox)))
    if unread_only:
        messages = _held(messages, locations, F.col("read") == 0)
    if flagged_only:
        messages = _held(messages, locations, F.col("flagged") == 1)
    return messages


def newest(messages: DataFrame, limit: int, most: int = 200) -> DataFrame:
    return messages.orderBy(F.desc("date_received"), F.desc("id")).limit(clamp(limit, 1, most))


def mailbox_sizes(locations: DataFrame) -> DataFrame:
    return locations.groupBy("account", "mailbox").agg(F.count("*").alias("n"))


def picked(hits: DataFrame, locations: DataFrame, few: bool = False) -> DataFrame:
    """hits with the location chosen for each (account, mailbox, read, flagged) and also_in, the other mailboxes' names in order.

    few: hits has a limit (at most 500), so that it is sent to the locations.
    The choice: no bulk mailbox if another is there, then the smallest, then the first by name.
    Hits without a location are dropped, after any limit that hits has.
    """
    place = locations.select(F.col("message").alias("__m"), F.col("account").alias("__a"), "mailbox", "read", "flagged")
    sizes = mailbox_sizes(locations).select(F.col("account").alias("__sa"), F.col("mailbox").alias("__sm"), "n")
    one_of = hits.drop("mailbox", "read", "flagged")
    at = (F.broadcast(one_of) if few else one_of).join(place, F.col("id") == F.col("__m"))
    at = at.join(sizes, (F.col("__a") == F.col("__sa")) & (F.col("mailbox") == F.col("__sm")), "left")
    rank = F.struct(F.col("mailbox").isin(*BULK).alias("bulk"), F.coalesce("n", F.lit(NO_SIZE)).alias("n"), "mailbox", F.col("__a").alias("account"), "read", "flagged")
    own = [c for c in hits.columns if c not in ("account", "mailbox", "read", "flagged")]
    one = at.groupBy("id").agg(*[F.first(c).alias(c) for c in own if c != "id"], F.min(rank).alias("__pick"), F.array_sort(F.collect_list("mailbox")).alias("__all"))
    others = F.filter("__all", lambda m: m != F.col("__pick.mailbox"))
    return one.select(*own, *[F.col(f"__pick.{c}").alias(c) for c in ("account", "mailbox", "read", "flagged")], others.alias("also_in"))


def search_all(messages: DataFrame, locations: DataFrame, query: str, limit: int = 20, ids: DataFrame | None = None, **filters) -> DataFrame:
    """The newest matches, one chosen location each. ids: what matches, where an index has answered the query; else texts are read."""
    # dates reach the scan, texts are matched next, and only matches meet their locations
    dates = {k: filters.pop(k) for k in ("since", "until") if k in filters}
    found = filtered(messages, locations, **dates, zone=filters.get("zone"))
    if ids is None:
        found = matching(found, query)[0]
    else:
        found = found.join(ids.select(F.col("id").alias("__match")), F.col("id") == F.col("__match"), "left_semi")
    hits = newest(filtered(found, locations, **filters), limit).select("id", "subject", "sender", "date_received", "rfc_id")
    return picked(hits, locations, few=True).select(
        X.message_token(F.col("account"), F.col("mailbox"), F.col("id")).alias("message_id"),
        F.col("id").alias("mail_id"),
        F.coalesce("subject", F.lit("")).alias("subject"),
        F.coalesce("sender", F.lit("")).alias("sender"),
        X.iso(F.col("date_received")).alias("date_received"),
        "account", "mailbox", "also_in",
        (F.col("read") != 0).alias("read"),
        (F.col("flagged") != 0).alias("flagged"),
        F.coalesce("rfc_id", F.lit("")).alias("rfc_message_id"),
    )


def search_index(index, query: str, limit: int = 20, **filters) -> tuple[DataFrame, str]:
    """(search_all() of an index (sources.index.Index) by its postings, query as interpreted)."""
    ids, used = index.find(query)
    return search_all(index.messages(), index.locations(), query, limit, ids, **filters), used


def response(rows: DataFrame, query: str, used: str, indexed: int, freshness: dict | None = None) -> dict:
    """A search's whole answer as data; of bounded size, as the limit is."""
    found = rows.orderBy(F.desc("date_received"), F.desc("mail_id")).collect()
    out = {"ok": True, "query": query, "messages": [r.asDict() for r in found], "indexed_messages": indexed, "coverage": "all_indexed_mail", **(freshness or {})}
    return out | ({"interpreted_as": used} if used != query else {})


def search_response(messages: DataFrame, locations: DataFrame, query: str, freshness: dict | None = None, **options) -> dict:
    """response() over tables without an index."""
    _, used = matching(messages, query)
    return response(search_all(messages, locations, query, **options), query, used, messages.count(), freshness)


def thread(messages: DataFrame, locations: DataFrame, identifier: int, limit: int = 100) -> DataFrame:
    """The oldest messages of a message's conversation, oldest first, each at its chosen location."""
    row = messages.where(F.col("id") == identifier).select("conversation_id").first()
    if row is None:
        raise ArchiveError("not_indexed", f"Message {identifier} is not in the index.")
    if row[0] is None:
        raise ArchiveError("no_thread", f"Message {identifier} belongs to no conversation.")
    own = messages.where(F.col("conversation_id") == row[0]).select("id", "subject", "sender", "date_received")
    own = own.orderBy(F.asc("date_received"), "id").limit(clamp(limit, 1, 500))
    return picked(own, locations, few=True).select(
        X.message_token(F.col("account"), F.col("mailbox"), F.col("id")).alias("message_id"), F.col("id").alias("mail_id"), "subject", "sender",
        "date_received", "account", "mailbox", (F.col("read") != 0).alias("read"), (F.col("flagged") != 0).alias("flagged"), (F.col("id") == identifier).alias("is_requested"),
    ).orderBy("date_received", "mail_id")


def thread_of_token(messages: DataFrame, locations: DataFrame, token: str, limit: int = 100) -> DataFrame:
    return thread(messages, locations, MessageReference.decode(token).identifier, limit)


def status_counts(messages: DataFrame, locations: DataFrame) -> DataFrame:
    """messages, locations, oldest and newest date (of dates above 0), in one row."""
    dates = F.when(F.col("date_received") > 0, F.col("date_received"))
    m = messages.agg(F.count("*").alias("messages"), F.min(dates).alias("oldest"), F.max(dates).alias("newest"))
    return m.crossJoin(locations.agg(F.count("*").alias("locations"))).select("messages", "locations", "oldest", "newest")


def accounts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("account").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "account")


def list_mailboxes(locations: DataFrame, include_totals: bool = False) -> DataFrame:
    aggs = [F.count_if(F.col("read") == 0).alias("unread")] + ([F.count("*").alias("total")] if include_totals else [])
    return locations.groupBy("account", "mailbox").agg(*aggs)


def mailboxes_by_account(locations: DataFrame) -> DataFrame:
    per = list_mailboxes(locations, True)
    return per.groupBy("account").agg(F.count("*").alias("mailbox_count"), F.array_sort(F.collect_list(F.struct("mailbox", "unread", "total"))).alias("mailboxes"))


def _same(column: str, value: str) -> Column:
    return X.ascii_lower(F.col(column)) == X.ascii_lower(F.lit(value))


def count_unread(locations: DataFrame, mailbox: str | None = None, account: str | None = None, boxes: DataFrame | None = None) -> DataFrame:
    """Unread by mailbox: those with any, or the mailbox asked for even at 0. boxes (account, mailbox): all there are, with or without messages."""
    every = locations.select("account", "mailbox").distinct() if boxes is None else boxes
    for name, value in (("account", account), ("mailbox", mailbox)):
        if value:
            locations, every = locations.where(_same(name, value)), every.where(_same(name, value))
    per = list_mailboxes(locations)
    return every.join(per, ["account", "mailbox"], "left").na.fill(0, ["unread"]) if mailbox else per.where("unread > 0")


def scan_window(limit: int, unread_only: bool, scan_limit: int | None = None) -> int:
    default = max(10 * limit, 200) if unread_only else limit
    return max(limit, min(default if scan_limit is None else int(scan_limit), 2000))


def _newest_of(messages: DataFrame, here: DataFrame, limit: int, unread_only: bool, scan_limit: int | None, preview_chars: int) -> DataFrame:
    """Rows of list_messages() with their place (account, mailbox)."""
    place = here.select(F.col("message").alias("__m"), F.col("account").alias("__a"), F.col("mailbox").alias("__b"), "read", "flagged")
    rows = messages.drop("read", "flagged", "account", "mailbox").join(place, F.col("id") == F.col("__m"))
    rows = rows.select("id", "subject", "sender", "date_received", F.col("__a").alias("account"), F.col("__b").alias("mailbox"), "read", "flagged", *(["body"] if preview_chars else []))
    newest_first = [F.desc("date_received"), F.desc("id")]
    rows = rows.orderBy(*newest_first).limit(scan_window(limit, unread_only, scan_limit))
    if unread_only:
        rows = rows.where("read = 0")
    rows = rows.orderBy(*newest_first).limit(limit)
    if preview_chars:
        n = F.row_number().over(W.orderBy(*newest_first))  # at most ``limit`` rows
        rows = rows.select("*", n.alias("__n")).withColumn("preview", F.when(F.col("__n") <= PREVIEWS, X.preview(F.col("body"), preview_chars))).drop("body", "__n")
    return rows


def list_messages(messages: DataFrame, locations: DataFrame, account: str, mailbox: str, limit: int = 20, unread_only: bool = False, scan_limit: int | None = None, preview_chars: int = 0) -> DataFrame:
    """The newest messages of a mailbox: a window of them first, then the unread among it, then the limit.

    message_id: their references. preview: of the first PREVIEWS rows. window_truncated: the window
    was shorter than the mailbox.
    """
    limit = clamp(limit, 1, 200)
    here = locations.where((F.col("account") == account) & (F.col("mailbox") == mailbox))
    rows = _newest_of(messages, here, limit, unread_only, scan_limit, preview_chars)
    rows = rows.select(X.message_token(F.col("account"), F.col("mailbox"), F.col("id")).alias("message_id"), "*")
    if not unread_only:
        return rows.withColumn("window_truncated", F.lit(False))
    held = here.limit(scan_window(limit, True, scan_limit) + 1).agg((F.count("*") > scan_window(limit, True, scan_limit)).alias("window_truncated"))
    return rows.crossJoin(F.broadcast(held))  # one row


def window_of(messages: DataFrame, here: DataFrame, limit: int, unread_only: bool, scan_limit: int | None, preview_chars: int) -> tuple[list[dict], int, int]:
    """(rows of a live listing, how many messages were looked at, how many there are) at the places in here."""
    limit = clamp(limit, 1, 200)
    total = here.count()
    rows = []
    for r in _newest_of(messages, here, limit, unread_only, scan_limit, preview_chars).orderBy(F.desc("date_received"), F.desc("id")).collect():
        x = r.asDict()
        token = MessageReference(x["account"], x["mailbox"], x["id"]).encode()
        row = {"message_id": token, "mail_id": x["id"], **{k: x[k] for k in ("subject", "sender", "date_received", "mailbox", "account")}, "read": bool(x["read"]), "flagged": bool(x["flagged"])}
        rows.append({**row, "preview": x["preview"]} if x.get("preview") else row)
    return rows, min(total, scan_window(limit, unread_only, scan_limit)), total


def get_message(messages: DataFrame, locations: DataFrame, token: str, max_body_chars: int = 20_000) -> DataFrame:
    """The message at the place that the token names."""
    ref = MessageReference.decode(token)
    place = locations.where((F.col("account") == ref.account) & (F.col("mailbox") == ref.mailbox) & (F.col("message") == ref.identifier))
    place = place.select(F.col("message").alias("__m"), F.col("account").alias("__a"), "mailbox", "read", "flagged")
    row = messages.where(F.col("id") == ref.identifier).drop("mailbox", "read", "flagged").join(place, F.col("id") == F.col("__m"))
    return row.withColumn("account", F.col("__a")).withColumn("__b", X.truncated(F.coalesce("body", F.lit("")), max_body_chars)).drop("body", "__m", "__a").select("*", "__b.*").drop("__b")


#: Names by which any account's special mailboxes are asked for, in the languages that mail clients use.
ALIASES = {
    "inbox": ("INBOX", "Inbox", "Boîte de réception", "Bandeja de entrada", "Posteingang"),
    "sent": ("Sent", "Sent Messages", "[Gmail]/Sent Mail", "Messages envoyés", "Éléments envoyés", "[Gmail]/Messages envoyés", "Gesendet", "Enviados"),
    "drafts": ("Drafts", "[Gmail]/Drafts", "Brouillons", "[Gmail]/Brouillons", "Entwürfe", "Borradores"),
    "trash": ("Trash", "[Gmail]/Trash", "Deleted Messages", "Corbeille", "[Gmail]/Corbeille", "Papierkorb", "Papelera"),
    "junk": ("Junk", "Spam", "[Gmail]/Spam", "Courrier indésirable", "Werbung", "Correo no deseado"),
}


def _lower(text: str) -> str:
    """Lower case of ASCII letters alone."""
    return "".join(c.lower() if c.isascii() else c for c in text)


def _special(name: str) -> tuple[str, ...]:
    """All names of the special mailbox that name is one of."""
    wanted = _lower(name)
    return next((names for key, names in ALIASES.items() if wanted == key or wanted in map(_lower, names)), ())


def resolve_account(boxes: DataFrame, account: str) -> str:
    """The account as stored: exact, else without regard to ASCII case."""
    known = sorted(r[0] for r in boxes.where(_same("account", account)).select("account").distinct().collect())
    if not known:
        raise ArchiveError("account_not_found", f"No account {account!r}.")
    return account if account in known else known[0]


def _chosen(held: list[str], mailbox: str) -> str | None:
    """The name among held that is meant: exact, without regard to ASCII case, or another name of the same special mailbox."""
    for name in (mailbox, *_special(mailbox)):
        if name in held:
            return name
        if alike := [h for h in held if _lower(h) == _lower(name)]:
            return alike[0]
    return None


def resolve_mailbox(boxes: DataFrame, account: str, mailbox: str) -> tuple[str, str]:
    """(account, mailbox) as stored in boxes (account, mailbox); no mailbox is the inbox."""
    own = resolve_account(boxes, account)
    held = sorted(r[0] for r in boxes.where(F.col("account") == own).select("mailbox").distinct().collect())
    found = _chosen(held, mailbox or "inbox")
    if found is None:
        raise ArchiveError("mailbox_not_found", f"No mailbox {mailbox!r} in {account!r}.")
    return own, found


def resolve_anywhere(boxes: DataFrame, mailbox: str) -> list[tuple[str, str]]:
    """The places that a mailbox without an account means: a special one in every account, any other in the first that has it."""
    by: dict[str, list[str]] = {}
    for r in boxes.distinct().orderBy("account", "mailbox").collect():
        by.setdefault(r["account"], []).append(r["mailbox"])
    found = [(a, m) for a, held in by.items() if (m := _chosen(held, mailbox)) is not None]
    if not found:
        raise ArchiveError("mailbox_not_found", f"No mailbox {mailbox!r}.")
    return found if _special(mailbox) else found[:1]


def same_message(messages: DataFrame, locations: DataFrame, identifier: int, account: str, mailbox: str) -> int | None:
    """The number of the message at a place that has the rfc_id of another one; None if there is none."""
    row = messages.where(F.col("id") == identifier).select("rfc_id").first()
    if row is None or not row[0]:
        return None
    there = locations.where((F.col("account") == account) & (F.col("mailbox") == mailbox)).select(F.col("message").alias("__m"))
    found = messages.where((F.col("rfc_id") == row[0]) & (F.col("id") != identifier)).join(there, F.col("id") == F.col("__m"), "left_semi")
    return found.agg(F.max("id")).first()[0]
