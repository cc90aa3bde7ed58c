"""Archive operators on small tables, message files and a store."""

import os
import sqlite3
import time
from functools import partial

import pytest
from pyspark.sql import functions as F

from postlode.errors import ArchiveError, guarded
from postlode.functions import text as X
from postlode.functions import values as V
from postlode.operators import drafts as D
from postlode.operators import ingest, search
from postlode.settings import Settings
from postlode.sources import drafts as files
from postlode.sources import index, mime, store


def _one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("r")).first()["r"]


def test_reference_round_trip(spark):
    for ref in (V.MessageReference("Work", "[Gmail]/All Mail", 115250), V.MessageReference("Perso", "Crèche/Suivi", 1), V.MessageReference('A"', "B\\", 2)):
        token = ref.encode()
        assert V.MessageReference.decode(token) == ref and not set(token) & set("=/+")
        df = spark.createDataFrame([(ref.account, ref.mailbox, ref.identifier)], "a string, m string, i long")
        assert df.select(X.message_token(F.col("a"), F.col("m"), F.col("i")).alias("t")).first()["t"] == token
    for bad in ("", "not-base64", "!!!!"):
        with pytest.raises(ArchiveError, match="reference"):
            V.MessageReference.decode(bad)


def test_values():
    assert V.quoted("invoice 12/2025") == '"invoice" AND "12/2025"'
    assert V.timestamp("2026-01-31") == V.timestamp("31/01/2026") == V.timestamp("2026/01/31")
    assert V.timestamp("2026-01-31", True) - V.timestamp("2026-01-31") == 86399
    assert V.timestamp(None) is None and V.timestamp(" 2026-1-3 ") == V.timestamp("2026-01-03") and V.timestamp("1970-01-01", zone="Europe/Paris") == -3600
    for bad in ("2026-13-01", "2026-01/02", "31-01-2026", "2026-02-30", "x"):
        assert guarded(V.timestamp, bad)["error_code"] == "invalid_date"
    assert V.quoted('a """ b') == '"a" AND "" AND "b"' and V.addresses_in("a; b,,") == ["a", "b"] and V.addresses_in(["a", " "]) == ["a"]
    assert guarded(V.timestamp, "le 31 janvier")["error_code"] == "invalid_date"
    assert V.flag_colour("grey") == 6 and V.flag_colour("red") == 0 and V.flag_colour("off") is None
    assert guarded(V.flag_colour, "turquoise")["error_code"] == "invalid_flag_color"
    assert V.confirmation(["a@b.fr"], "s", "b")["error_code"] == "confirmation_required"


def test_text(spark):
    assert _one(spark, X.address_list, "a@b.fr, c@d.fr; e@f.fr,,  ,") == ["a@b.fr", "c@d.fr", "e@f.fr"]
    assert _one(spark, X.address_list, None) == []
    assert _one(spark, X.addresses, "Ada Lovelace <Ada.Lovelace@Example.com>, b@c.fr") == ["ada.lovelace@example.com", "b@c.fr"]
    for value, want in (("Décompte 03 — lot 12", "decompte-03-lot-12"), ("!!! ???", "no-subject"), ("x" * 200, "x" * 48), (None, "no-subject")):
        assert _one(spark, X.slug, value) == want
    assert files.slug("Décompte 03 — lot 12") == "decompte-03-lot-12"
    u = _one(spark, X.mailbox_url, "imap://ACCOUNT-UUID/%5BGmail%5D/a+b%20c")
    assert (u["scheme"], u["account"], u["path"]) == ("imap", "ACCOUNT-UUID", "[Gmail]/a+b c")
    assert _one(spark, X.mailbox_url, "ftp://a/b") is None and _one(spark, X.mailbox_url, "imap:///b") is None
    for bare in ("imap://uuid", "imap://uuid/"):
        assert (_one(spark, X.mailbox_url, bare)["account"], _one(spark, X.mailbox_url, bare)["path"]) == ("uuid", "")
    assert _one(spark, X.records, "a\x1fb\x1ec\x1fd\x1e") == [["a", "b"], ["c", "d"]] and _one(spark, X.records, "") == []
    assert _one(spark, X.strip_markup, "<style>x</style><p>a &amp;lt;\n b</p>") == "a &lt; b"
    assert _one(spark, X.nfc, "é") == "é"
    assert _one(spark, X.attachment_fields, "a|3|true;b|x|no") == [("a", 3, True), ("b", 0, False)]
    assert _one(spark, X.iso, 0, "long") == "1970-01-01T00:00:00+00:00"
    assert _one(spark, X.fold, "Crème ÉCOLE") == "creme ecole"
    assert _one(spark, X.clean_field, "a\x1fb\x1ec") == "a b c" and _one(spark, X.clean_field, None) == ""
    people = spark.sql("select array(named_struct('name', 'Ada', 'address', 'a@x'), named_struct('name', '', 'address', 'b@x')) as c, cast(null as array<struct<name:string,address:string>>) as n")
    assert people.select(X.join_addresses(F.col("c")), X.join_addresses(F.col("n"))).first()[:] == ("Ada <a@x>, b@x", "")


@pytest.fixture(scope="module")
def archive(spark):
    m = [(1, "Work", "r1", "Invoice", "Ada", "pay now", 100, 7), (2, "Work", None, "Lunch", "Bob", "with Ada", 300, 7), (3, "Home", "r3", None, None, None, None, None), (4, "Home", "r4", "Invoice", "Eve", "none", 200, 7)]
    loc = [(1, "Work", "[Gmail]/All Mail", 0, 0), (1, "Work", "Bills", 1, 1), (2, "Work", "[Gmail]/All Mail", 0, 0), (2, "Work", "Inbox", 0, 0), (1, "Work", "Inbox", 1, 0), (3, "Home", "Inbox", 0, 0)]
    return (
        spark.createDataFrame(m, "id long, account string, rfc_id string, subject string, sender string, body string, date_received long, conversation_id long"),
        spark.createDataFrame(loc, "message long, account string, mailbox string, read int, flagged int"),
    )


def test_search(archive):
    m, loc = archive
    got = search.search_all(m, loc, "invoice").collect()
    assert [(r["mail_id"], r["mailbox"], r["also_in"], r["read"]) for r in got] == [(1, "Bills", ["Inbox", "[Gmail]/All Mail"], True)]
    r = search.search_response(m, loc, "ada, lunch")
    assert r["interpreted_as"] == '"ada," AND "lunch"' and [x["mail_id"] for x in r["messages"]] == [2] and r["indexed_messages"] == 4
    assert guarded(search.search_all, m, loc, "  ")["error_code"] == "empty_query"
    # account and flags may hold at different locations
    ids = lambda **k: sorted(x["id"] for x in search.filtered(m, loc, **k).collect())
    assert ids(unread_only=True, flagged_only=True) == [1] and ids(account="WORK", mailbox="inbox") == [1, 2]
    assert ids(since="1970-01-01") == [1, 2, 3, 4]
    assert ids(until="1970-01-01") == [1, 2, 4]


def test_thread_and_lists(archive):
    m, loc = archive
    assert [(r["mail_id"], r["is_requested"]) for r in search.thread(m, loc, 2).collect()] == [(1, False), (2, True)]
    assert guarded(search.thread, m, loc, 3)["error_code"] == "no_thread"
    assert guarded(search.thread, m, loc, 99)["error_code"] == "not_indexed"
    assert [(r["mailbox"], r["unread"]) for r in search.count_unread(loc, "Bills").collect()] == [("Bills", 0)]
    assert search.scan_window(20, True) == 200 and search.scan_window(20, False) == 20 and search.scan_window(100, True, 5000) == 2000
    rows = search.list_messages(m, loc, "Work", "Inbox", 5, True, preview_chars=30).collect()
    assert [(r["id"], r["preview"], r["window_truncated"]) for r in rows] == [(2, "with Ada", False)]
    assert search.resolve_mailbox(loc, "work", "INBOX") == ("Work", "Inbox")
    assert guarded(search.resolve_mailbox, loc, "Work", "Nope")["error_code"] == "mailbox_not_found"
    assert guarded(search.resolve_mailbox, loc, "Nope", "Inbox")["error_code"] == "account_not_found"
    token = V.MessageReference("Work", "Bills", 1).encode()
    got = search.get_message(m, loc, token).first()
    assert (got["body"], got["body_truncated"], got["flagged"]) == ("pay now", False, 1)


def _mail(folder, n, body, name=None):
    os.makedirs(folder, exist_ok=True)
    raw = f"Message-ID: <m{n}@x>\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n{body}".encode()
    path = os.path.join(folder, name or f"{n}.emlx")
    with open(path, "wb") as f:
        f.write(str(len(raw)).encode() + b"\n" + raw + b"<plist/>")
    return path


def test_build_and_sync(spark, tmp_path):
    db = str(tmp_path / "V3" / "envelope.db")
    os.makedirs(tmp_path / "V3")
    os.makedirs(tmp_path / "V12")
    assert store.find_store(str(tmp_path)).endswith("V12")
    with sqlite3.connect(db) as c:
        c.executescript(
            """CREATE TABLE mailboxes(url, total_count); CREATE TABLE messages(mailbox, deleted, date_received, size, conversation_id, read, flagged, subject, sender);
            CREATE TABLE labels(message_id, mailbox_id); CREATE TABLE subjects(subject); CREATE TABLE addresses(address, comment); CREATE TABLE recipients(message, address); CREATE TABLE attachments(message, name);
            INSERT INTO mailboxes VALUES ('imap://U1/INBOX', 2), ('imap://U1/Work%20x', 1), ('bad', 0);
            INSERT INTO messages VALUES (1, 0, 1700000000, 10, 5, 0, 1, 1, 1), (1, 0, 1700000001, 11, NULL, 1, 0, 9, 2), (1, 1, 1700000002, 12, 6, 0, 0, 1, 1);
            INSERT INTO labels VALUES (1, 2), (3, 2); INSERT INTO subjects VALUES ('Hello'); INSERT INTO addresses VALUES ('a@x', 'Ada'), ('b@x', NULL);
            INSERT INTO recipients VALUES (1, 2), (1, 1); INSERT INTO attachments VALUES (1, 'f.pdf'), (1, 'g.pdf');"""
        )
    _mail(str(tmp_path / "V3" / "a"), 1, "whole")
    _mail(str(tmp_path / "V3" / "b"), 1, "part", "1.partial.emlx")
    _mail(str(tmp_path / "V3" / ".hidden"), 2, "no")
    assert mime.find_message_file(spark, str(tmp_path / "V3"), 1).endswith("a/1.emlx") and mime.find_message_file(spark, str(tmp_path / "V3"), 2) is None
    t = store.open_store(spark, store.snapshot(db, str(tmp_path)))
    found = mime.scan_store(spark, str(tmp_path / "V3")).cache()
    assert [(r["id"], os.path.basename(r["path"])) for r in found.collect()] == [(1, "1.emlx")]
    m, loc = ingest.built(t, found, partial(mime.parse_files, folder=str(tmp_path / "V3")), now=5)
    rows = {r["id"]: r for r in m.collect()}
    assert set(rows) == {1, 2}
    r = rows[1]
    assert (r["account"], r["rfc_id"], r["subject"], r["sender"], r["recipients"], r["attachments"], r["body"]) == ("U1", "m1@x", "Hello", "Ada <a@x>", " b@x Ada a@x", "f.pdf g.pdf", "whole")
    assert (rows[2]["rfc_id"], rows[2]["subject"], rows[2]["sender"], rows[2]["body"]) == (None, "", "b@x", "")
    assert sorted((x["message"], x["mailbox"], x["flagged"]) for x in loc.collect()) == [(1, "INBOX", 1), (1, "Work x", 1), (2, "INBOX", 0)]
    report = ingest.checks(t, found, mime.parse_files)
    assert not report.where("check = 'mailbox urls parse'").first()["passed"] and report.count() == 7
    assert guarded(ingest.gate, report)["error_code"] == "checks_failed"
    ingest.gate(report, force=True)
    i = index.Index(spark, str(tmp_path / "index"))
    assert guarded(i.messages)["error_code"] == "index_missing" and i.age_minutes() is None
    assert i.refresh_if_stale(lambda: {"n": 1}) == {"synced": False, "index_age_minutes": 0.0}
    i.build(m, loc)
    assert i.status()["messages"] == 2 and i.status()["size_bytes"] > 0 and i.age_minutes() < 5
    gone = dict(t, messages=t["messages"].where("rowid <> 2"))
    assert ingest.sync_index(i, gone, found, mime.parse_files)["removed"] == 1
    assert [r["id"] for r in i.messages().collect()] == [1] and {r["message"] for r in i.locations().collect()} == {1}
    back = ingest.sync_index(i, t, found, mime.parse_files, drafts=str(tmp_path / "none"))
    assert (back["ok"], back["added"], back["removed"]) == (True, 1, 0) and i.messages().count() == 2
    assert ingest.sync_index(i, t, found, mime.parse_files)["added"] == 0
    assert i.refresh_if_stale(lambda: {"n": 1}, 10).keys() == {"synced", "index_age_minutes"}
    assert i.refresh_if_stale(lambda: {"added": 3, "removed": 1}, -1) == {"synced": True, "index_age_minutes": 0.0, "sync_added": 3, "sync_removed": 1}
    for failure, note in ((RuntimeError("boom"), "sync_failed: boom"), (ArchiveError("permission_denied", "no"), "permission_denied: no")):

        def fails(failure=failure):
            raise failure

        assert i.refresh_if_stale(fails, -1)["sync_note"] == note
    i.files.create(index.LOCK)
    assert i.refresh_if_stale(lambda: {}, -1)["sync_note"] == "already running"
    i.files.delete(index.LOCK)
    unread = dict(t, messages=t["messages"].withColumn("read", F.lit(1)))
    ingest.sync_index(i, unread, found, mime.parse_files, refresh_locations=True)
    assert {(r["message"], r["mailbox"], r["read"]) for r in i.locations().collect()} == {(1, "INBOX", 1), (1, "Work x", 1), (2, "INBOX", 1)}
    for wrong, code in ((PermissionError("x"), "permission_denied"), (RuntimeError("Permission denied: /x"), "permission_denied"), (RuntimeError("y"), "sync_failed")):

        def parse(files, wrong=wrong):
            raise wrong

        assert guarded(ingest.sync_index, i, t, found, parse)["error_code"] == code


def _index_of(spark, path, rows):
    i = index.Index(spark, path)
    m = spark.createDataFrame(rows, "id long, account string, rfc_id string, subject string, sender string, body string, date_received long, conversation_id long")
    i.build(m, m.select(F.col("id").alias("message"), "account", F.lit("Inbox").alias("mailbox"), F.lit(0).alias("read"), F.lit(0).alias("flagged")), now=1)
    return i, m


def test_parts_of_an_index(spark, tmp_path, monkeypatch):
    row = lambda n, text, date=5: (n, "A", f"r{n}", text, "s", f"body of {text}", date, 1)
    i, m = _index_of(spark, str(tmp_path / "i"), [row(1, "one"), row(2, "two"), row(3, "three")])
    ids = lambda q: sorted(r["id"] for r in i.find(q)[0].collect())
    place = lambda df: df.select(F.col("id").alias("message"), "account", F.lit("Box").alias("mailbox"), F.lit(1).alias("read"), F.lit(0).alias("flagged"))
    more = spark.createDataFrame([row(2, "zwei"), row(4, "vier")], m.schema)
    i.apply(more, place(more), spark.createDataFrame([(1,)], "id long"), now=2, batch=("s", 7))
    check = lambda: (ids("one"), ids("two"), ids("zwei"), ids("three OR vier"), ids("bod*"), sorted((r["message"], r["mailbox"]) for r in i.locations().collect()))
    want = ([], [], [2], [3, 4], [2, 3, 4], [(2, "Box"), (3, "Inbox"), (4, "Box")])
    assert check() == want and i.manifest()["batches"] == {"s": 7}
    i.apply(more.limit(0), place(more.limit(0)), spark.createDataFrame([(3,)], "id long"), batch=("s", 7))
    assert check() == want  # the batch was in
    i.compact()
    assert check() == want and len(i.manifest()["parts"]) == 1 and i.manifest()["last_build"] == 2
    monkeypatch.setattr(index, "COMPACT", 2)
    for k in range(5, 9):
        new = spark.createDataFrame([row(k, "five")], m.schema)
        i.apply(new, place(new), spark.createDataFrame([], "id long"))
    assert ids("five") == [5, 6, 7, 8] and len(i.manifest()["parts"]) <= 2
    names = i.files.names()
    assert len([n for n in names if n.startswith("manifest-")]) == index.KEEP and len([n for n in names if n.startswith("part-")]) <= 6
    # a writer that bases its change on an older state loses, and leaves nothing behind
    stale = i.manifest()
    new = spark.createDataFrame([row(9, "nine")], m.schema)
    i.apply(new, place(new), spark.createDataFrame([], "id long"))
    monkeypatch.setattr(i, "_need", lambda: stale)
    before = i.files.names()
    assert guarded(i.apply, new, place(new), spark.createDataFrame([], "id long"))["error_code"] == "index_busy" and i.files.names() == before


def test_search_reads_the_index_only(spark, tmp_path):
    i, _ = _index_of(spark, str(tmp_path / "i"), [(n, "A", None, f"word{n} common", "s", "x", n, 1) for n in range(50)])
    found, used = search.search_index(i, "word7")
    assert [r["mail_id"] for r in found.collect()] == [7] and used == "word7"
    plan = i.find("word7")[0]._jdf.queryExecution().toString()
    scan = plan.split("== Physical Plan ==")[1]
    assert "(bucket#" in scan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(term,word7)" in scan and "ReadSchema: struct<id:bigint,c:tinyint,term:string>" in scan
    found, used = search.search_index(i, "word7, common", 5)
    r = search.response(found, "word7, common", used, 50, {"synced": False})
    assert [x["mail_id"] for x in r["messages"]] == [7] and r["interpreted_as"] == '"word7," AND "common"' and r["indexed_messages"] == 50


def test_mime():
    assert mime.payload(b"3\nabcdef") == b"abc" and mime.payload(b"x\nabc") is None and mime.payload(None) is None
    html_mail = b"Content-Type: text/html; charset=nope\r\n\r\n<p>a&eacute;</p><script>x</script>"
    assert mime.text_of(html_mail)[1] == "aé"
    assert mime.text_of(b"Content-Type: text/plain\r\n\r\n" + b"x" * 300, 100)[1] == "x" * 100
    assert mime.text_of(None) == ("", "")


MAIL = (
    b"Message-ID: <m@x>\r\nMIME-Version: 1.0\r\nTo: \"Doe, J\" <j@x.fr>, b@x.fr\r\nReply-To: r@x.fr\r\nContent-Type: multipart/mixed; boundary=A\r\n\r\n"
    b"--A\r\nContent-Type: multipart/alternative; boundary=B\r\n\r\n"
    b"--B\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\nwords \xc3\xa9\r\n"
    b"--B\r\nContent-Type: text/html\r\n\r\n<img src=\"cid:Logo\"><object data='cid:doc'>\r\n--B--\r\n"
    b"--A\r\nContent-Type: image/png; name=logo.png\r\nContent-Disposition: inline; filename=logo.png\r\nContent-ID: <Logo>\r\n\r\n\r\n"
    b"--A\r\nContent-Type: image/png; name=case.png\r\nContent-Disposition: inline; filename=case.png\r\nContent-ID: <logo>\r\n\r\nabc\r\n"
    b"--A\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=\"=?utf-8?q?d=C3=A9compte=2Epdf?=\"\r\nContent-ID: <doc>\r\n\r\nabcd\r\n"
    b"--A\r\nContent-Type: application/x\r\nContent-Disposition: attachment\r\n\r\nxy\r\n"
    b"--A\r\nContent-Type: application/x\r\nContent-Disposition: attachment; filename=\"../a/b.txt\"\r\n\r\nxyz\r\n"
    b"--A\r\nContent-Type: application/x\r\nContent-Disposition: attachment; filename=\"b.txt\"\r\n\r\nuvw\r\n--A--\r\n"
)


def test_attachments(tmp_path):
    got = mime.attachments_of(MAIL)
    # an empty image that is shown is skipped, ids keep their case, unnamed parts are numbered among all
    assert [(n, s, k) for n, s, _, k in got] == [("logo.png", 0, True), ("case.png", 3, False), ("décompte.pdf", 4, False), ("piece-7", 2, False), ("../a/b.txt", 3, False), ("b.txt", 3, False)]
    saved, left = mime.save_attachments(MAIL, str(tmp_path / "out"))
    assert [os.path.basename(p) for p in saved] == ["case.png", "décompte.pdf", "piece-7", "b.txt", "b-1.txt"] and left == ["logo.png"]
    assert all(os.path.dirname(p) == str(tmp_path / "out") for p in saved) and (tmp_path / "out" / "b-1.txt").read_text() == "uvw"
    h = mime.headers_of(MAIL)
    assert (h["to"], h["reply_to"], h["cc"]) == ('"Doe, J" <j@x.fr>, b@x.fr', "r@x.fr", "") and h["headers"].startswith("Message-ID: <m@x>") and "words" not in h["headers"]
    assert mime.text_of(MAIL) == ("m@x", "words é")
    broken = b"Message-ID: <k@x>\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=A\r\n\r\n--A\r\nContent-Type: text/plain; charset=\"idna\"\r\n\r\n" + b"\xff" * 80 + b"\r\n--A\r\nContent-Type: text/plain\r\n\r\nkept\r\n--A--"
    assert mime.text_of(broken)[0] == "k@x" and "kept" in mime.text_of(broken)[1]


def test_drafts(spark, tmp_path):
    folder = str(tmp_path / "d")
    note = tmp_path / "note.txt"
    note.write_text("hi")
    a = files.write_draft(folder, ["a@b.fr"], "Sujet é", "corps", cc=["c@d.fr"], attachments=[str(note)])
    b = files.write_draft(folder, ["a@b.fr"], "Sujet é", "corps")
    assert a != b and len(files.list_drafts(folder)) == 2
    got = files.read_draft(a)
    assert (got["to"], got["cc"], got["subject"], got["body"], got["attachments"]) == (["a@b.fr"], ["c@d.fr"], "Sujet é", "corps", [{"name": "note.txt", "size": 2}])
    assert guarded(files.read_draft, a + "x")["error_code"] == "draft_file_not_found"
    os.makedirs(os.path.join(folder, "sent"))
    for name, days in (("old.eml", 10), ("new.eml", 1), ("sent/s.eml", 10), ("sent/t.eml", 40), ("x.txt", 999)):
        p = os.path.join(folder, name)
        with open(p, "w") as f:
            f.write("x")
        os.utime(p, (time.time() - days * 86400,) * 2)
    with open(os.path.join(folder, "empty.eml"), "w"):
        pass
    os.utime(os.path.join(folder, "empty.eml"), (time.time() - 10 * 86400,) * 2)
    assert files.purge_drafts(spark, folder) == ["empty.eml", "old.eml", "sent/t.eml"]
    assert guarded(files.purge_drafts, spark, folder + "x")["error_code"] == "folder_not_found"
    assert guarded(files.write_draft, folder, [], "s", "b")["error_code"] == "no_recipient"
    assert guarded(files.write_draft, folder, " , ;", "s", "b")["error_code"] == "no_recipient"
    assert guarded(files.write_draft, folder, "a@b", "s", "b", attachments=["/nowhere"])["error_code"] == "attachment_not_found"
    c = files.write_draft(folder, '"Doe, J" <j@x.fr>, b@x.fr', "Re", "b", sender="me@x.fr")
    assert files.read_draft(c)["from"] == "me@x.fr" and files.read_draft(c)["date"]
    assert os.path.basename(files.file_sent(c)) == os.path.basename(c) and not os.path.exists(c)
    path = str(tmp_path / "ledger.json")
    files.record_sent(path, "s", ["A@Example.com"], now=0)
    files.record_sent(path, "s", ["Ada <A@Example.com>"], now=9000)
    assert files.read_ledger(path) == [{"subject": "s", "to": ["ada <a@example.com>"], "at": 9000}]
    rows = spark.createDataFrame([(1, "s", ["A@example.com"], 5), (2, "t", ["a@example.com"], 4), (3, "s", ["z@x"], 3)], "id long, subject string, to array<string>, date_received long")
    led = files.ledger(spark, path)
    assert [r["id"] for r in D.leftovers(rows, led, 9001).collect()] == [1]
    assert D.leftovers(rows, led, 9001, bare=False).count() == 0 and D.leftovers(rows, led, 99999).count() == 0
    assert D.recorded(led, "u", ["Q@x"], 9002).count() == 2


def test_log(spark):
    log = spark.createDataFrame([(1, "mark_as_read", None, 1, 1), (1, "mark_as_unread", None, 1, 2), (1, "move", "Bills", 3, 1), (2, "delete", None, 1, 1), (2, "other", None, 9, 1)], "id long, action string, arg string, ts long, seq long")
    assert sorted(tuple(r) for r in D.folded_log(log).collect()) == [(1, "mailbox", "Bills"), (1, "read", "0"), (2, "mailbox", "Trash")]


def test_settings(tmp_path):
    f = tmp_path / "c.json"
    f.write_text('{"pending_retention_days": 3, "drafts_folder": "~/Somewhere"}')
    s = Settings(str(f), {"POSTLODE_ARCHIVE_RETENTION_DAYS": "1", "POSTLODE_BODY_LIMIT": "soon"})
    assert (s.get("pending_retention_days"), s.get("archive_retention_days"), s.get("body_limit")) == (3, 1, 200_000)
    assert s.get("drafts_folder") == os.path.expanduser("~/Somewhere") and s.describe()["body_limit"]["source"] == "environment"
    f.write_text("{")
    s.reload()
    assert s.get("pending_retention_days") == 7


def test_plans(archive):
    m, loc = archive
    plan = search.search_all(m, loc, "invoice", account="Work")._jdf.queryExecution().toString()
    assert "LeftSemi" in plan and "TakeOrderedAndProject" in plan and "Python" not in plan.split("== Physical Plan ==")[1]
