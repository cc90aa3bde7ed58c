"""Draft files and the ledger of sends, on the driver."""

from __future__ import annotations

import itertools
import json
import mimetypes
import os
import re
import time
import unicodedata
from datetime import datetime
from email.message import EmailMessage
from email.utils import format_datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArchiveError
from ..functions.text import fold_map
from ..functions.values import addresses_in
from .mime import draft_of, free_name


def slug(text: str, most: int = 48) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.translate(str.maketrans(*fold_map()))) if not unicodedata.combining(c))
    return re.sub("[^A-Za-z0-9]+", "-", plain).strip("-").lower()[:most].rstrip("-") or "no-subject"


def write_draft(folder: str, to, subject: str, body: str, cc=(), bcc=(), attachments=(), sender: str | None = None, now: datetime | None = None) -> str:
    """Path of the new file; an existing one is never replaced. Addresses are lists, or texts with commas between."""
    to, cc, bcc = (addresses_in(x) for x in (to, cc, bcc))
    if not to:
        raise ArchiveError("no_recipient", "A draft needs a recipient.")
    missing = [p for p in attachments if not os.path.isfile(p)]
    if missing:
        raise ArchiveError("attachment_not_found", f"No file {missing[0]}.")
    m = EmailMessage()
    for name, value in (("From", sender), ("To", ", ".join(to)), ("Cc", ", ".join(cc)), ("Bcc", ", ".join(bcc)), ("Subject", subject)):
        if value:
            m[name] = value
    m["Date"] = format_datetime((now or datetime.now()).astimezone())
    m.set_content(body)
    for path in attachments:
        kind = mimetypes.guess_type(path)[0] or "application/octet-stream"
        with open(path, "rb") as f:
            m.add_attachment(f.read(), *kind.split("/", 1), filename=os.path.basename(path))
    os.makedirs(folder, exist_ok=True)
    stem = f"{now or datetime.now():%Y%m%d-%H%M%S}-{slug(subject)}"
    for n in itertools.count():
        path = os.path.join(folder, f"{stem}{f'-{n}' if n else ''}.eml")
        try:
            with open(path, "xb") as f:
                f.write(bytes(m))
            return path
        except FileExistsError:
            continue
    raise AssertionError


def list_drafts(folder: str, limit: int | None = None) -> list[dict]:
    """Newest first by name; what can't be read is passed over."""
    if not os.path.isdir(folder):
        raise ArchiveError("folder_not_found", f"No folder {folder}.")
    out = []
    for name in sorted((n for n in os.listdir(folder) if n.endswith(".eml")), reverse=True)[:limit]:
        try:
            out.append(read_draft(os.path.join(folder, name)))
        except ArchiveError:
            continue
    return out


def read_draft(path: str) -> dict:
    try:
        with open(path, "rb") as f:
            return {"path": path, "file": os.path.basename(path), **draft_of(f.read()), "written_at": os.path.getmtime(path)}
    except FileNotFoundError as e:
        raise ArchiveError("draft_file_not_found", f"No draft {path}.") from e
    except (OSError, ValueError) as e:
        raise ArchiveError("draft_file_unreadable", f"{path}: {e}") from e


def discard_draft(path: str) -> None:
    try:
        os.unlink(path)
    except FileNotFoundError as e:
        raise ArchiveError("draft_file_not_found", f"No draft {path}.") from e


def draft_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, mtime (seconds) of all files under a folder; the source passes over files without content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.unix_seconds("modificationTime").alias("mtime"))


def purge_drafts(spark: SparkSession, folder: str, pending_days: int = 7, sent_days: int = 30, now: float | None = None) -> list[str]:
    """Removes expired files; their paths within the folder. What can't be removed stays."""
    from ..operators.drafts import expired

    if not os.path.isdir(folder):
        raise ArchiveError("folder_not_found", f"No folder {folder}.")
    at = int(now or time.time())
    gone = {r["path"] for r in expired(draft_files(spark, folder), at, pending_days, sent_days).collect()}
    # Spark's source passes over empty files
    for days, place in ((pending_days, folder), (sent_days, os.path.join(folder, "sent"))):
        for f in os.scandir(place) if os.path.isdir(place) else ():
            if f.name.endswith(".eml") and f.is_file() and not f.stat().st_size and f.stat().st_mtime < at - days * 86400:
                gone.add(f.path)
    removed = []
    for path in gone:
        try:
            os.unlink(path)
            removed.append(os.path.relpath(path, folder))
        except OSError:
            continue
    return sorted(removed)


def file_sent(path: str) -> str:
    """Moves a draft that was sent to the folder of sent ones beside it; its new path."""
    folder = os.path.join(os.path.dirname(path), "sent")
    os.makedirs(folder, exist_ok=True)
    target = free_name(folder, os.path.basename(path))
    os.replace(path, target)
    return target


def read_ledger(path: str) -> list[dict]:
    try:
        with open(path, encoding="utf-8") as f:
            value = json.load(f)
    except (OSError, ValueError):
        return []
    entries = value if isinstance(value, list) else []
    return [{"subject": None, "to": [], **e, "at": float(e.get("at") or 0)} for e in entries if isinstance(e, dict)]


def record_sent(path: str, subject: str, to: list[str], now: float | None = None, window: float = 2 * 3600) -> None:
    """Notes a send. A ledger that can't be written is no error: what was sent is sent."""
    now = time.time() if now is None else now
    kept = [e for e in read_ledger(path) if now - e["at"] < window]
    try:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            json.dump([*kept, {"subject": subject, "to": [t.lower() for t in to], "at": now}], f)
    except OSError:
        return


def ledger(spark: SparkSession, path: str) -> DataFrame:
    schema = "subject string, to array<string>, at double"
    rows = [(e.get("subject"), e.get("to"), float(e.get("at", 0))) for e in read_ledger(path)]
    return spark.createDataFrame(rows, schema)
