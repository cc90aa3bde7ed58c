"""The archive as functions that answer with plain data: reading, search, drafts, and changes.

Every function returns a dict with ``ok``; an ArchiveError becomes one with ``error_code``. What
the functions return is bounded by their limits. Changes to messages are rows of a log beside the
index, folded over it when read; sending hands a message to ``transport``, a function of yours.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ArchiveError, guarded
from .functions import text as X
from .functions.values import MessageReference, addresses_in, clamp, confirmation, flag_colour
from .operators import drafts as log_rules
from .operators import search
from .settings import Settings
from .sources import drafts, mime
from .sources.index import Index

LOG = "id long, action string, arg string, ts long, seq long"
DRAFT_BOXES = ("Drafts", "[Gmail]/Drafts", "Brouillons", "[Gmail]/Brouillons", "Entwürfe", "Borradores")


def tool(call):
    """Errors of the archive come back as data."""

    @wraps(call)
    def run(*args, **kwargs):
        return guarded(call, *args, **kwargs)

    return run


class Archive:
    """index: where the index is. files: id, path of the message files (for bodies and headers); names: account id -> name.

    sync: brings the index up to date (see ingest.sync_index); transport(draft: dict) sends.
    """

    def __init__(self, spark: SparkSession, index: str, files: DataFrame | None = None, sync: Callable[[], dict] | None = None, transport: Callable[[dict], None] | None = None, accounts: DataFrame | None = None, settings: Settings | None = None):
        self.spark, self.index, self.files, self.sync, self.transport, self.names = spark, Index(spark, index), files, sync, transport, accounts
        self.settings = settings or Settings()

    # state

    def _log(self) -> DataFrame:
        path = self.index.files.path("log")
        return self.spark.read.schema(LOG).parquet(path) if self.index.files.exists("log") else self.spark.createDataFrame([], LOG)

    def _record(self, identifier: int, action: str, arg: str | None = None) -> None:
        now = time.time_ns()
        self.spark.createDataFrame([(identifier, action, arg, now // 10**9, now)], LOG).coalesce(1).write.mode("append").parquet(self.index.files.path("log"))

    def boxes(self) -> DataFrame:
        """account, mailbox of all mailboxes: those that hold messages, and those that were made."""
        own = self.index.locations().select("account", "mailbox")
        if self.index.files.exists("mailboxes"):
            own = own.unionByName(self.spark.read.schema("account string, mailbox string").parquet(self.index.files.path("mailboxes")))
        return own.distinct()

    def locations(self) -> DataFrame:
        """The index's locations with the log's changes over them."""
        return log_rules.changed(self.index.locations(), self._log())

    def _one(self, reference: MessageReference) -> dict:
        here = self.locations().where((F.col("account") == reference.account) & (F.col("mailbox") == reference.mailbox) & (F.col("message") == reference.identifier))
        row = here.first()
        if row is None:
            raise ArchiveError("message_not_found", f"No message {reference.identifier} in {reference.mailbox}.")
        return row.asDict()

    def _raw(self, identifier: int) -> bytes | None:
        if self.files is None:
            return None
        row = mime.contents(self.files.where(F.col("id") == identifier)).first()
        return mime.payload(bytes(row["content"])) if row else None

    # reading

    @tool
    def list_accounts(self) -> dict:
        """name, id, kind of each account that is known, or that has messages."""
        if self.names is not None:
            rows = [{"account": r["name"], "id": r["uuid"], "type": r.asDict().get("type") or ""} for r in self.names.orderBy("name", "uuid").collect()]
        else:
            rows = [{"account": r["account"], "id": r["account"], "type": ""} for r in self.index.messages().select("account").distinct().orderBy("account").collect()]
        return {"ok": True, "accounts": rows}

    @tool
    def list_mailboxes(self, include_totals: bool = False) -> dict:
        held = search.list_mailboxes(self.locations(), True)
        rows = self.boxes().join(held, ["account", "mailbox"], "left").na.fill(0).orderBy("account", "mailbox").collect()
        by: dict[str, dict] = {}
        for r in rows:
            box = {"path": r["mailbox"], "unread": r["unread"], **({"total": r["total"]} if include_totals else {})}
            by.setdefault(r["account"], {"account": r["account"], "mailboxes": []})["mailboxes"].append(box)
        return {"ok": True, "accounts": list(by.values()), "mailbox_count": len(rows)}

    @tool
    def list_messages(self, mailbox: str = "", account: str = "", limit: int = 20, unread_only: bool = False, scan_limit: int | None = None, include_preview: bool = False, preview_chars: int = 200) -> dict:
        places = [search.resolve_mailbox(self.boxes(), account, mailbox or "inbox")] if account else search.resolve_anywhere(self.boxes(), mailbox or "inbox")
        locations = self.locations()
        here = F.lit(False)
        for a, m in places:
            here |= (F.col("account") == a) & (F.col("mailbox") == m)
        rows, seen, total = search.window_of(self.index.messages(), locations.where(here), limit, unread_only, scan_limit, preview_chars if include_preview else 0)
        out = {"ok": True, "messages": rows, "total_in_mailbox": total, "scanned": seen, "window_truncated": unread_only and seen < total}
        if include_preview:
            out["previews_read"] = sum("preview" in r for r in rows)
            if len(rows) > out["previews_read"]:
                out["preview_note"] = f"Only the first {out['previews_read']} messages have a preview; get_message has the others' text."
        return out

    @tool
    def search_all(self, query: str, limit: int = 20, since: str | None = None, until: str | None = None, account: str | None = None, mailbox: str | None = None, unread_only: bool = False, flagged_only: bool = False) -> dict:
        fresh = self.index.refresh_if_stale(self.sync, self.settings.get("index_max_age_minutes")) if self.sync else {}
        ids, used = self.index.find(query)
        messages = self.index.messages()
        rows = search.search_all(messages, self.locations(), query, limit, ids, since=since, until=until, account=account, mailbox=mailbox, unread_only=unread_only, flagged_only=flagged_only)
        return search.response(rows, query, used, messages.count(), fresh)

    @tool
    def get_thread(self, message_id: str, limit: int = 100) -> dict:
        rows = [r.asDict() for r in search.thread_of_token(self.index.messages(), self.locations(), message_id, limit).collect()]
        return {"ok": True, "message_count": len(rows), "messages": rows}

    @tool
    def index_status(self) -> dict:
        return self.index.status()

    @tool
    def sync_index(self) -> dict:
        if self.sync is None:
            raise ArchiveError("sync_unavailable", "No store to sync from.")
        return self.sync()

    @tool
    def get_message(self, message_id: str, max_body_chars: int = 20_000) -> dict:
        ref = MessageReference.decode(message_id)
        self._one(ref)
        row = search.get_message(self.index.messages(), self.locations(), message_id, max_body_chars).first().asDict()
        raw = self._raw(ref.identifier)
        parts = [{"name": n, "size": s, "downloaded": True} for n, s, _, skipped in mime.attachments_of(raw) if not skipped]
        if raw is None and row.get("attachments"):
            parts = [{"name": n, "size": 0, "downloaded": False} for n in row["attachments"].split(" ")]
        kept = {k: row.get(k) for k in ("subject", "sender", "date_received", "mailbox", "account", "body", "body_truncated")}
        heads = mime.headers_of(raw)
        if raw is None:
            heads["to"] = row.get("recipients") or ""
        flags = {"read": bool(row["read"]), "flagged": bool(row["flagged"])}
        return {"ok": True, "message_id": message_id, "mail_id": ref.identifier, "rfc_message_id": row.get("rfc_id") or "", **kept, **flags, **heads, "attachments": parts}

    @tool
    def save_attachments(self, message_id: str, folder: str) -> dict:
        ref = MessageReference.decode(message_id)
        raw = self._raw(ref.identifier)
        if raw is None:
            raise ArchiveError("message_not_found", f"No stored file of message {ref.identifier}.")
        saved, skipped = mime.save_attachments(raw, folder)
        return {"ok": True, "saved": saved, "skipped": skipped}

    @tool
    def count_unread(self, mailbox: str | None = None, account: str | None = None) -> dict:
        rows = search.count_unread(self.locations(), mailbox, account, self.boxes()).orderBy("account", "mailbox").collect()
        return {"ok": True, "total_unread": sum(r["unread"] for r in rows), "mailboxes": [r.asDict() for r in rows]}

    # drafts and sending

    def _folder(self, folder: str | None) -> str:
        return folder or self.settings.get("drafts_folder")

    @tool
    def write_draft(self, to, subject: str, body: str, cc=None, bcc=None, attachments=None, sender: str | None = None, folder: str | None = None) -> dict:
        path = drafts.write_draft(self._folder(folder), to, subject, body, cc, bcc, attachments or (), sender)
        return {"ok": True, **drafts.read_draft(path)}

    @tool
    def list_drafts(self, folder: str | None = None) -> dict:
        found = drafts.list_drafts(self._folder(folder))
        return {"ok": True, "folder": self._folder(folder), "waiting": len(found), "drafts": found}

    @tool
    def read_draft_file(self, path: str) -> dict:
        return {"ok": True, **drafts.read_draft(path)}

    @tool
    def discard_draft_file(self, path: str) -> dict:
        drafts.read_draft(path)
        drafts.discard_draft(path)
        return {"ok": True, "discarded": path}

    @tool
    def purge_drafts(self, folder: str | None = None) -> dict:
        days = (self.settings.get(k) for k in ("pending_retention_days", "archive_retention_days"))
        return {"ok": True, "removed": drafts.purge_drafts(self.spark, self._folder(folder), *days)}

    def _sent(self, draft: dict) -> None:
        if self.transport is None:
            raise ArchiveError("no_transport", "This archive has nothing to send with.")
        self.transport(draft)
        drafts.record_sent(f"{self._folder(None)}/.ledger.json", draft["subject"], draft["to"], window=3600 * self.settings.get("ledger_window_hours"))

    def _preview(self, d: dict, action: str) -> dict:
        return confirmation(d["to"], d["subject"], d["body"], d["cc"], d["bcc"], d["attachments"], action)

    @tool
    def send_email(self, to, subject: str, body: str, cc=None, bcc=None, attachments=None, confirm: bool = False) -> dict:
        d = {"to": addresses_in(to), "subject": subject, "body": body, "cc": addresses_in(cc), "bcc": addresses_in(bcc), "attachments": list(attachments or ())}
        if not d["to"]:
            raise ArchiveError("no_recipient", "A message needs a recipient.")
        if not confirm:
            return self._preview(d, "send_email")
        self._sent(d)
        return {"ok": True, "sent": True, "subject": subject, "recipient_count": len(d["to"] + d["cc"] + d["bcc"])}

    @tool
    def create_draft(self, to, subject: str, body: str, cc=None, bcc=None, attachments=None) -> dict:
        return self.write_draft(to, subject, body, cc, bcc, attachments)

    @tool
    def send_draft_file(self, path: str, confirm: bool = False, keep_file: bool = False) -> dict:
        d = drafts.read_draft(path)
        if not d["to"] + d["cc"] + d["bcc"]:
            raise ArchiveError("draft_without_recipient", f"The draft {d['subject']!r} has no recipient.")
        if not confirm:
            return self._preview(d, "send_draft_file")
        self._sent(d)
        return {"ok": True, **d, "sent": True, "filed_as": path if keep_file else drafts.file_sent(path)}

    def _draft(self, message_id: str) -> dict:
        ref = MessageReference.decode(message_id)
        self._one(ref)
        if ref.mailbox not in DRAFT_BOXES:
            raise ArchiveError("not_a_draft", f"Message {ref.identifier} is in {ref.mailbox}, which holds no drafts.")
        m = self.get_message(message_id)
        return {"to": addresses_in(m["to"]), "cc": addresses_in(m["cc"]), "bcc": addresses_in(m["bcc"]), **{k: m[k] for k in ("subject", "body", "attachments")}}

    @tool
    def read_draft(self, message_id: str) -> dict:
        return {"ok": True, **self._draft(message_id)}

    @tool
    def send_draft(self, message_id: str, confirm: bool = False) -> dict:
        d = self._draft(message_id)
        if not d["to"] + d["cc"] + d["bcc"]:
            raise ArchiveError("draft_without_recipient", f"The draft {d['subject']!r} has no recipient.")
        if not confirm:
            return self._preview(d, "send_draft")
        self._sent(d)
        self._record(MessageReference.decode(message_id).identifier, "delete")
        return {"ok": True, "sent": True, "subject": d["subject"]}

    @tool
    def reply_to_message(self, message_id: str, body: str, reply_all: bool = False, confirm: bool = False, mode: str = "draft") -> dict:
        m = self.get_message(message_id)
        if not m["ok"]:
            return m
        to = addresses_in(m["reply_to"] or m["sender"])
        cc = [a for a in addresses_in(m["to"]) + addresses_in(m["cc"]) if a not in to] if reply_all else []
        subject = m["subject"] or ""
        subject = subject if subject.lower().startswith("re:") else f"Re: {subject}"
        if mode != "send":
            return {**self.write_draft(to, subject, body, cc), "mode": "draft", "sent": False, "reply_all": reply_all}
        sent = self.send_email(to, subject, body, cc, confirm=confirm)
        return {**sent, "mode": "send", "reply_all": reply_all} if sent["ok"] else sent

    # organising

    @tool
    def create_mailbox(self, name: str, parent: str | None = None, account: str | None = None) -> dict:
        if not name.strip():
            raise ArchiveError("invalid_name", "The mailbox name is empty.")
        own = search.resolve_account(self.boxes(), account) if account else self.boxes().agg(F.min("account")).first()[0]
        path = f"{search.resolve_mailbox(self.boxes(), own, parent)[1]}/{name}" if parent else name
        if self.boxes().where((F.col("account") == own) & (F.col("mailbox") == path)).isEmpty():
            self.spark.createDataFrame([(own, path)], "account string, mailbox string").coalesce(1).write.mode("append").parquet(self.index.files.path("mailboxes"))
        return {"ok": True, "account": own, "path": path}

    @tool
    def move_message(self, message_id: str, target_mailbox: str, target_account: str | None = None) -> dict:
        """A move is a row of the log. Within the account the message keeps its number; in another one it is found again by its rfc_id."""
        ref = MessageReference.decode(message_id)
        self._one(ref)
        account, box = search.resolve_mailbox(self.boxes(), target_account or ref.account, target_mailbox)
        self._record(ref.identifier, "move", box)
        out = {"ok": True, "moved_to": {"account": account, "mailbox": box}}
        if account == ref.account:
            return {**out, "message_id": MessageReference(account, box, ref.identifier).encode()}
        again = search.same_message(self.index.messages(), self.locations(), ref.identifier, account, box)
        if again is not None:
            return {**out, "message_id": MessageReference(account, box, again).encode()}
        return {**out, "note": "The message has no number there yet; the old message_id is stale. Search the mailbox once it is synced."}

    def _update(self, message_id: str, action: str, arg: str | None = None, **state) -> dict:
        ref = MessageReference.decode(message_id)
        self._one(ref)
        self._record(ref.identifier, action, arg)
        return {"ok": True, "action": action, "message_id": message_id, **state}

    @tool
    def delete_message(self, message_id: str) -> dict:
        return {**self._update(message_id, "delete"), "note": "The message is in the trash."}

    @tool
    def mark_as_read(self, message_id: str) -> dict:
        return self._update(message_id, "mark_as_read", read=True)

    @tool
    def mark_as_unread(self, message_id: str) -> dict:
        return self._update(message_id, "mark_as_unread", read=False)

    @tool
    def flag_message(self, message_id: str, flag_color: str | None = None) -> dict:
        colour = flag_colour(flag_color)
        shown = {} if colour is None else {"flag_index": colour}
        return self._update(message_id, "flag", "" if colour is None else str(colour), flagged=colour is not None, **shown)
