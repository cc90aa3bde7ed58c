"""Message files: text, attachments and drafts out of MIME, in Arrow batches."""

from __future__ import annotations

import email
import email.policy
import html
import itertools
import os
import re
from collections.abc import Iterator
from email.message import Message

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import addresses_in
from ..ship import ship

BODY_LIMIT = 200_000
FILE_ID = r"/(\d+)(?:\.[^/]*)?\.emlx$"


def payload(content: bytes | None) -> bytes | None:
    """Message bytes of a stored file: a line with their count, they, and a trailer. None where the count is bad."""
    if content is None:
        return None
    head, line, rest = content.partition(b"\n")
    try:
        n = int(head.strip())
    except ValueError:
        return None
    return rest[:n] if line and n >= 0 else None


_HIDDEN, _TAG = re.compile(r"<(script|style).*?</\1>", re.I | re.S), re.compile("<[^>]+>")


def strip_markup(marked: str) -> str:
    bare = _TAG.sub(" ", _HIDDEN.sub(" ", marked))
    return " ".join(html.unescape(bare).split())


def _parsed(raw: bytes) -> Message | None:
    try:
        return email.message_from_bytes(raw, policy=email.policy.default)
    except Exception:  # noqa: BLE001 - mail in the wild breaks any parser
        return None


def _tried(read, otherwise):
    """What read() gives; ``otherwise`` where a part is malformed: it costs itself, not the message."""
    try:
        return read()
    except Exception:  # noqa: BLE001
        return otherwise


def _bytes(part: Message) -> bytes:
    return part.get_payload(decode=True) or b""


def _decoded(part: Message) -> str:
    data = _bytes(part)
    try:
        return data.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def _bare_id(value) -> str:
    return str(value or "").strip().strip("<>")


def text_of(raw: bytes | None, limit: int = BODY_LIMIT) -> tuple[str, str]:
    """(Message-ID, body): plain parts, else HTML parts without markup; ("", "") for what can't be read. A bad part is left out."""
    m = None if raw is None else _parsed(raw)
    if m is None:
        return "", ""
    texts: dict[str, list[str]] = {"text/plain": [], "text/html": []}
    for part in m.walk():
        kind = _tried(part.get_content_type, "")
        if kind in texts and not _tried(part.get_filename, None):
            text = _tried(lambda part=part: _decoded(part), None)
            if text is not None:
                texts[kind].append(text)
    body = "\n".join(texts["text/plain"]) if texts["text/plain"] else strip_markup("\n".join(texts["text/html"]))
    return _tried(lambda: _bare_id(m.get("Message-ID")), ""), body[:limit]


_SHOWN = re.compile(r"<img[^>]+src=[\"']?cid:([^\"'>\s]+)", re.I)


def attachment_parts(raw: bytes | None) -> list[tuple[str, bytes, str, bool]]:
    """(name, content, content id, skipped) of every attachment: skipped are images that the HTML shows inline.

    Parts without a name are numbered among all parts of the message, containers included. Empty
    parts are no attachments unless they are skipped.
    """
    m = None if raw is None else _parsed(raw)
    parts = [] if m is None else list(m.walk())
    shown: set[str] = set()
    for p in parts:
        if _tried(p.get_content_type, "") == "text/html":
            shown |= {c.strip() for c in _SHOWN.findall(_tried(lambda p=p: _decoded(p), ""))}
    out = []
    for i, p in enumerate(parts):
        name, disposition = _tried(p.get_filename, None), _tried(p.get_content_disposition, None)
        if p.get_content_maintype() == "multipart" or not name and disposition != "attachment":
            continue
        cid = _tried(lambda p=p: _bare_id(p.get("Content-ID")), "")
        skipped = disposition != "attachment" and bool(cid) and cid in shown
        data = _tried(lambda p=p: _bytes(p), b"")
        if data or skipped:
            out.append((name or f"piece-{i}", data, cid, skipped))
    return out


def attachments_of(raw: bytes | None) -> list[tuple[str, int, str, bool]]:
    """(name, size, content id, skipped) of every attachment."""
    return [(name, len(data), cid, skipped) for name, data, cid, skipped in attachment_parts(raw)]


def free_name(folder: str, name: str) -> str:
    """A path in folder that isn't taken, for a name from outside."""
    safe = re.sub(r"[/\\\0]", "_", os.path.basename(name)) or "piece"
    stem, extension = os.path.splitext(safe)
    tries = itertools.chain([safe], (f"{stem}-{n}{extension}" for n in itertools.count(1)))
    return next(p for t in tries if not os.path.exists(p := os.path.join(folder, t)))


def save_attachments(raw: bytes | None, folder: str) -> tuple[list[str], list[str]]:
    """(paths written, names skipped): attachments as files of a folder, none over another."""
    os.makedirs(folder, exist_ok=True)
    saved, left = [], []
    for name, data, _, skipped in attachment_parts(raw):
        if skipped:
            left.append(name)
            continue
        path = free_name(folder, name)
        with open(path, "xb") as f:
            f.write(data)
        saved.append(path)
    return saved, left


def _addresses(m: Message, header: str) -> list[str]:
    """A header's addresses as they would be written; commas within quoted names part none."""
    value = m.get(header)
    if value is None:
        return []
    found = _tried(lambda: [str(a) for a in value.addresses], None)
    return found if found is not None else addresses_in(str(value))


def draft_of(raw: bytes) -> dict:
    """Summary of a draft: sender, recipients, subject, first plain body, attachments, date."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    body = next((_decoded(p) for p in m.walk() if p.get_content_type() == "text/plain" and not p.get_filename()), "")
    files = [{"name": p.get_filename(), "size": len(_bytes(p))} for p in m.walk() if p.get_content_maintype() != "multipart" and p.get_filename()]
    own = {"from": str(m.get("From") or ""), **{k.lower(): _addresses(m, k) for k in ("To", "Cc", "Bcc")}}
    return {**own, "subject": str(m.get("Subject") or ""), "body": body.rstrip(), "attachments": files, "date": str(m.get("Date") or "")}


def headers_of(raw: bytes | None, most: int = 8000) -> dict:
    """A message's reply-to, to, cc, bcc (as texts) and its first ``most`` characters of headers."""
    m = None if raw is None else _parsed(raw)
    if m is None:
        return {"reply_to": "", "to": "", "cc": "", "bcc": "", "headers": ""}
    head = re.split(rb"\r?\n\r?\n", raw, maxsplit=1)[0].decode("utf-8", "replace")
    return {**{k.lower().replace("-", "_"): ", ".join(_addresses(m, k)) for k in ("Reply-To", "To", "Cc", "Bcc")}, "headers": head[:most]}


def message_files(df: DataFrame) -> DataFrame:
    """id, path of rows with a path; whole files before partial ones, then the first by path."""
    f = df.select(F.regexp_extract("path", FILE_ID, 1).alias("n"), "path").where("n <> ''").where(~F.col("path").rlike(r"/\.[^/]*/"))
    rank = F.struct(F.col("path").contains(".partial."), "path")
    return f.groupBy(F.col("n").cast("long").alias("id")).agg(F.min_by("path", rank).alias("path"))


def scan_store(spark, store: str) -> DataFrame:
    """id, path of the message files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.emlx").load(store)
    return message_files(files.select("path"))


def find_message_file(spark, store: str, identifier: int) -> str | None:
    """The file of one message, whole before partial; only files of its name are listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{int(identifier)}{{.partial,}}.emlx").load(store)
    row = message_files(files.select("path")).where(F.col("id") == identifier).first()
    return row["path"] if row else None


def parsed_text(df: DataFrame, limit: int = BODY_LIMIT) -> DataFrame:
    """id, rfc_id, body of rows with id and content (a stored file's bytes)."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [text_of(payload(c), limit) for c in b["content"]]
            yield pd.DataFrame({"id": b["id"], "rfc_id": [r[0] for r in rows], "body": [r[1] for r in rows]})

    return df.select("id", "content").mapInPandas(run, "id long, rfc_id string, body string")


def parsed_attachments(df: DataFrame) -> DataFrame:
    """id, name, size, content_id, skipped of every attachment of rows with id and content."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *a) for i, c in zip(b["id"], b["content"], strict=True) for a in attachments_of(payload(c))]
            yield pd.DataFrame(rows, columns=["id", "name", "size", "content_id", "skipped"]).astype({"id": "int64", "size": "int64", "skipped": bool})

    return df.select("id", "content").mapInPandas(run, "id long, name string, size long, content_id string, skipped boolean")


def contents(files: DataFrame) -> DataFrame:
    """id, content of a few rows with id and path (a sample, one message), whose paths the driver lists.

    For a whole store, see contents_under().
    """
    spark = files.sparkSession
    paths = [r["path"] for r in files.select("path").distinct().collect()]
    if not paths:
        return spark.createDataFrame([], "id long, content binary")
    read = spark.read.format("binaryFile").load(paths).select(_plain(F.col("path")).alias("at"), "content")
    return files.join(read, _plain(F.col("path")) == F.col("at")).select("id", "content")


def contents_under(folder: str, files: DataFrame) -> DataFrame:
    """id, content of the files (id, path) under a folder, which Spark lists and reads by itself on any file system."""
    read = files.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.emlx").load(folder)
    read = read.select(_plain(F.col("path")).alias("at"), "content")
    return files.join(read, _plain(F.col("path")) == F.col("at")).select("id", "content")


def _plain(path):
    """A path without its scheme's slashes, so that file:/a, file:///a and /a are one."""
    return F.regexp_replace(path, "^file:/*", "/")


def parse_files(files: DataFrame, limit: int = BODY_LIMIT, folder: str | None = None) -> DataFrame:
    """id, rfc_id, body of rows with id and path; a whole store's need ``folder``, as else the driver lists the paths."""
    return parsed_text(contents_under(folder, files) if folder else contents(files), limit)
