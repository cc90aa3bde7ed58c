"""The archive's functions, and the command line, on a small archive."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from postlode.__main__ import main
from postlode.api import Archive
from postlode.functions.values import MessageReference
from postlode.operators import search
from postlode.settings import Settings
from postlode.sources.index import Index

MAIL = b"Message-ID: <r1>\r\nTo: \"Doe, J\" <j@x>, k@x\r\nCc: l@x\r\nReply-To: r@x\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=A\r\n\r\n--A\r\nContent-Type: text/plain\r\n\r\npay now\r\n--A\r\nContent-Disposition: attachment; filename=a.txt\r\n\r\nabc\r\n--A--\r\n"


@pytest.fixture
def archive(spark, tmp_path):
    m = [(1, "Work", "r1", "Invoice", "Ada <a@x>", "pay now", 100, 7, "k@x", "a.txt"), (2, "Work", None, "Lunch", "Bob", "with Ada", 300, 7, "", ""), (3, "Home", "r3", None, None, None, None, None, "", ""), (4, "Work", "r4", "Plan", "Ada", "draft text", 200, None, "z@x, y@x", ""), (5, "Home", "r1", "Invoice", "Ada <a@x>", "pay now", 100, None, "k@x", "")]
    loc = [(1, "Work", "Bills", 1, 1), (1, "Work", "Inbox", 1, 0), (2, "Work", "Inbox", 0, 0), (3, "Home", "Posteingang", 0, 0), (4, "Work", "Brouillons", 1, 0), (5, "Home", "Archive", 1, 0)]
    messages = spark.createDataFrame(m, "id long, account string, rfc_id string, subject string, sender string, body string, date_received long, conversation_id long, recipients string, attachments string")
    locations = spark.createDataFrame(loc, "message long, account string, mailbox string, read int, flagged int")
    path = str(tmp_path / "index")
    Index(spark, path).build(messages, locations)
    stored = tmp_path / "1.emlx"
    stored.write_bytes(str(len(MAIL)).encode() + b"\n" + MAIL)
    files = spark.createDataFrame([(1, str(stored))], "id long, path string")
    sent = []
    a = Archive(spark, path, files, transport=sent.append, settings=Settings("none.json", {"POSTLODE_DRAFTS_FOLDER": str(tmp_path / "drafts")}))
    a.outbox = sent
    return a


def _token(account, mailbox, n):
    return MessageReference(account, mailbox, n).encode()


def test_reading(archive, tmp_path):
    assert [a["account"] for a in archive.list_accounts()["accounts"]] == ["Home", "Work"]
    boxes = archive.list_mailboxes(True)
    assert boxes["mailbox_count"] == 5 and boxes["accounts"][1]["mailboxes"][2] == {"path": "Inbox", "unread": 1, "total": 2}
    got = archive.list_messages("inbox", "work", include_preview=True)
    assert [(m["mail_id"], m["read"], m["preview"]) for m in got["messages"]] == [(2, False, "with Ada"), (1, True, "pay now")]
    assert (got["total_in_mailbox"], got["scanned"], got["previews_read"], got["window_truncated"]) == (2, 2, 2, False)
    assert {m["mail_id"] for m in archive.list_messages()["messages"]} == {1, 2, 3}  # every account's inbox
    assert archive.list_messages("Bills")["messages"][0]["message_id"] == _token("Work", "Bills", 1)
    found = archive.search_all("invoice /", account="work")
    assert found["interpreted_as"] == '"invoice" AND "/"' and found["messages"] == []
    found = archive.search_all("invoice", account="work")
    assert [m["mail_id"] for m in found["messages"]] == [1] and found["indexed_messages"] == 5
    assert archive.search_all(" ")["error_code"] == "empty_query"
    thread = archive.get_thread(_token("Work", "Bills", 2))
    assert thread["message_count"] == 2 and [m["is_requested"] for m in thread["messages"]] == [False, True]
    m = archive.get_message(_token("Work", "Bills", 1))
    assert (m["to"], m["cc"], m["reply_to"], m["body"], m["flagged"]) == ('"Doe, J" <j@x>, k@x', "l@x", "r@x", "pay now", True)
    assert m["attachments"] == [{"name": "a.txt", "size": 3, "downloaded": True}] and m["headers"].startswith("Message-ID: <r1>")
    assert archive.get_message(_token("Home", "Archive", 5))["to"] == "k@x"
    assert archive.get_message(_token("Work", "Inbox", 9))["error_code"] == "message_not_found" and archive.get_message("?")["error_code"] == "invalid_message_id"
    saved = archive.save_attachments(_token("Work", "Bills", 1), str(tmp_path / "out"))
    assert [os.path.basename(p) for p in saved["saved"]] == ["a.txt"] and archive.save_attachments(_token("Work", "Inbox", 2), "x")["error_code"] == "message_not_found"
    assert archive.count_unread()["total_unread"] == 2 and archive.count_unread("Bills")["mailboxes"] == [{"account": "Work", "mailbox": "Bills", "unread": 0}]
    assert archive.index_status()["messages"] == 5 and archive.sync_index()["error_code"] == "sync_unavailable"


def test_changes(archive):
    assert archive.mark_as_unread(_token("Work", "Bills", 1))["read"] is False and archive.count_unread("Bills")["total_unread"] == 1
    assert archive.mark_as_read(_token("Work", "Bills", 1))["read"] is True and archive.count_unread("Bills")["total_unread"] == 0
    assert archive.flag_message(_token("Work", "Inbox", 2), "grey")["flag_index"] == 6
    assert [m["mail_id"] for m in archive.search_all("ada", flagged_only=True)["messages"]] == [2, 1]
    assert archive.flag_message(_token("Work", "Inbox", 2), "none")["flagged"] is False
    assert archive.flag_message(_token("Work", "Inbox", 2), "pink")["error_code"] == "invalid_flag_color"
    assert archive.create_mailbox("Paid", "bills", "work") == {"ok": True, "account": "Work", "path": "Bills/Paid"}
    assert archive.create_mailbox(" ")["error_code"] == "invalid_name" and archive.count_unread("Bills/Paid")["mailboxes"][0]["unread"] == 0
    moved = archive.move_message(_token("Work", "Bills", 1), "bills/paid")
    assert moved["moved_to"] == {"account": "Work", "mailbox": "Bills/Paid"} and archive.get_message(moved["message_id"])["mailbox"] == "Bills/Paid"
    assert archive.get_message(_token("Work", "Bills", 1))["error_code"] == "message_not_found"
    assert archive.move_message(_token("Work", "Inbox", 2), "nope")["error_code"] == "mailbox_not_found"
    # to another account: found again by its rfc_id, where it is there
    assert archive.move_message(moved["message_id"], "Archive", "home")["message_id"] == _token("Home", "Archive", 5)
    assert "note" in archive.move_message(_token("Work", "Inbox", 2), "Archive", "Home")
    assert archive.delete_message(_token("Home", "Posteingang", 3))["ok"] and archive.get_message(_token("Home", "Trash", 3))["ok"]


def test_drafts(archive):
    assert archive.send_email("a@x", "S", "B")["error_code"] == "confirmation_required" and archive.outbox == []
    assert archive.send_email([], "S", "B", confirm=True)["error_code"] == "no_recipient"
    assert archive.send_email("a@x; b@x", "S", "B", confirm=True)["recipient_count"] == 2 and archive.outbox[0]["to"] == ["a@x", "b@x"]
    d = archive.write_draft("a@x", "Hello", "text")
    assert archive.list_drafts()["waiting"] == 1 and archive.read_draft_file(d["path"])["subject"] == "Hello"
    assert archive.send_draft_file(d["path"])["preview"]["action"] == "send_draft_file"
    sent = archive.send_draft_file(d["path"], confirm=True)
    assert sent["sent"] and os.path.dirname(sent["filed_as"]).endswith("sent") and archive.list_drafts()["waiting"] == 0
    assert archive.create_draft("a@x", "Again", "text")["ok"] and archive.discard_draft_file(archive.list_drafts()["drafts"][0]["path"])["ok"]
    assert archive.discard_draft_file("/none")["error_code"] == "draft_file_not_found" and archive.purge_drafts()["removed"] == []
    assert archive.read_draft(_token("Work", "Inbox", 2))["error_code"] == "not_a_draft"
    assert archive.send_draft(_token("Work", "Bills", 1))["error_code"] == "not_a_draft"
    own = _token("Work", "Brouillons", 4)
    assert archive.read_draft(own)["to"] == ["z@x", "y@x"] and archive.send_draft(own)["error_code"] == "confirmation_required"
    assert archive.send_draft(own, confirm=True)["sent"] and archive.get_message(own)["error_code"] == "message_not_found"
    reply = archive.reply_to_message(_token("Work", "Bills", 1), "thanks", reply_all=True)
    assert (reply["to"], reply["subject"], reply["mode"]) == (["r@x"], "Re: Invoice", "draft") and "l@x" in reply["cc"]
    assert archive.reply_to_message(_token("Work", "Bills", 1), "thanks", mode="send")["error_code"] == "confirmation_required"
    archive.transport = None
    assert archive.send_email("a@x", "S", "B", confirm=True)["error_code"] == "no_transport"


def test_stale_index_is_synced_and_failures_do_not_matter(archive):
    archive.settings = Settings("none.json", {"POSTLODE_INDEX_MAX_AGE_MINUTES": "-1"})
    archive.sync = lambda: {"ok": True, "added": 2, "removed": 0}
    assert archive.search_all("invoice")["sync_added"] == 2

    def fails():
        raise RuntimeError("gone")

    archive.sync = fails
    found = archive.search_all("invoice")
    assert found["ok"] and found["sync_note"] == "sync_failed: gone" and len(found["messages"]) == 2


def test_mailbox_names(spark):
    boxes = spark.createDataFrame([("A", "Boîte de réception"), ("A", "[Gmail]/Brouillons"), ("A", "ÉTÉ"), ("B", "INBOX"), ("B", "x/y")], "account string, mailbox string")
    assert search.resolve_mailbox(boxes, "a", "inbox") == ("A", "Boîte de réception") and search.resolve_mailbox(boxes, "A", "drafts")[1] == "[Gmail]/Brouillons"
    assert search.resolve_mailbox(boxes, "B", "X/Y") == ("B", "x/y") and search.resolve_mailbox(boxes, "B", "") == ("B", "INBOX")
    with pytest.raises(Exception, match="No mailbox"):
        search.resolve_mailbox(boxes, "A", "été")  # only ASCII letters are alike
    assert search.resolve_anywhere(boxes, "posteingang") == [("A", "Boîte de réception"), ("B", "INBOX")] and search.resolve_anywhere(boxes, "x/y") == [("B", "x/y")]


def test_command_line(spark, tmp_path, capsys):
    root = tmp_path / "store" / "V10"
    os.makedirs(root / "m")
    with sqlite3.connect(root / "envelope.db") as c:
        c.executescript(
            """CREATE TABLE mailboxes(url, total_count); CREATE TABLE messages(mailbox, deleted, date_received, size, conversation_id, read, flagged, subject, sender);
            CREATE TABLE labels(message_id, mailbox_id); CREATE TABLE subjects(subject); CREATE TABLE addresses(address, comment); CREATE TABLE recipients(message, address); CREATE TABLE attachments(message, name);
            INSERT INTO mailboxes VALUES ('imap://U1/INBOX', 1), ('imap://U1/All', 1); INSERT INTO messages VALUES (1, 0, 1700000000, 10, 5, 0, 1, 1, 1);
            INSERT INTO labels VALUES (1, 2); INSERT INTO subjects VALUES ('Hello'); INSERT INTO addresses VALUES ('a@x', 'Ada');"""
        )
    (root / "m" / "1.emlx").write_bytes(str(len(MAIL)).encode() + b"\n" + MAIL)
    args = ["--store", str(tmp_path / "store"), "--index", str(tmp_path / "index")]
    assert main(["--check", *args], spark) == 1 and "FAIL membership" in capsys.readouterr().out
    assert main(["--build", *args], spark) == 1 and main(["--search", "pay", *args], spark) == 1
    assert main(["--build", "--force", *args], spark) == 0 and main(["--sync", *args], spark) == 0
    assert "added 0, removed 0" in capsys.readouterr().out
    assert main(["--search", "pay AND hello", *args], spark) == 0 and "All, INBOX" in capsys.readouterr().out
    assert main(["--search", "re: pay", *args], spark) == 1  # no second reading here
    assert main(["--check", "--store", str(tmp_path / "none")], spark) == 1
    with pytest.raises(SystemExit):
        main([], spark)


def test_log_over_locations(spark, archive):
    got = archive.locations().where(F.col("message") == 1).count()
    assert got == 2
