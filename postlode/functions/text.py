"""Text functions: Column in, Column out, all on the JVM side but where noted."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters of tokens: letters, numbers, private use.
WORD = r"[\p{L}\p{N}\p{Co}]"
GAP = r"[^\p{L}\p{N}\p{Co}]"
_MARKS = "".join(map(chr, range(0x300, 0x370)))


@cache
def fold_map() -> tuple[str, str]:
    """Characters of one base and one mark, and their bases."""
    src, dst = [], []
    for cp in range(0x80, 0x2000):
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) == 2 and unicodedata.combining(d[1]) and not unicodedata.combining(d[0]):
            src.append(chr(cp))
            dst.append(d[0])
    return "".join(src), "".join(dst)


def fold_text(text: str) -> str:
    src, dst = fold_map()
    return text.translate(str.maketrans(src, dst, _MARKS)).lower()


def fold(c: Column) -> Column:
    """Lower case without diacritics, as full-text terms are compared."""
    src, dst = fold_map()
    plain = F.octet_length(c) == F.length(c)  # ASCII has nothing to translate
    return F.when(plain, F.lower(c)).otherwise(F.lower(F.translate(c, src + _MARKS, dst)))  # marks have no counterpart: they go


def tokens(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(f"({WORD}+)"), 1)


def token_count(folded: Column) -> Column:
    return F.regexp_count(folded, F.lit(f"{WORD}+"))


_ASCII_UP, _ASCII_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _ASCII_UP, _ASCII_LOW)


def strip_tags(c: Column) -> Column:
    """Markup without scripts, styles and tags; entities stay."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.regexp_replace(c, r"(?s)<[^>]+>", " ")


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


#: Entities that can be replaced on the JVM side; "&amp;" must come last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def strip_markup(c: Column) -> Column:
    """Plain text of markup whose entities are all in ENTITIES."""
    c = strip_tags(c)
    for k, v in ENTITIES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return _squeeze(c)


@F.pandas_udf(StringType())
def _unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def strip_markup_general(c: Column) -> Column:
    """strip_markup() for any entity: those are resolved in Python."""
    return _squeeze(_unescape(strip_tags(c)))


def nfc(c: Column) -> Column:
    return _nfc(c)


def address_list(c: Column) -> Column:
    """Parts between commas and semicolons, trimmed, without empty ones; null has none."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[,;]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def addresses(c: Column) -> Column:
    """The set of addresses in a text, in lower case and sorted."""
    found = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+)"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def slug(c: Column, most: int = 48) -> Column:
    """A file name's stem; "no-subject" where nothing is left."""
    s = F.regexp_replace(F.translate(c, fold_map()[0] + _MARKS, fold_map()[1]), "[^A-Za-z0-9]+", "-")
    s = F.rtrim(F.substring(F.lower(F.btrim(s, F.lit("-"))), 1, most), F.lit("-"))
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("no-subject")).otherwise(s)


#: An account there must be; its path may be empty, with or without a slash.
URL = r"^(imap|ews|local|pop)://([^/]+)/?(.*)$"


def mailbox_url(c: Column, pattern: str = URL) -> Column:
    """Struct of scheme, account and percent-decoded path; null for any other text."""
    part = lambda k: F.regexp_extract(c, pattern, k)
    decoded = F.try_url_decode(F.replace(part(3), F.lit("+"), F.lit("%2B")))
    return F.when(c.rlike(pattern), F.struct(part(1).alias("scheme"), part(2).alias("account"), F.coalesce(decoded, part(3)).alias("path")))


def sender(name: Column, address: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(name, F.lit(" <"), F.coalesce(address, F.lit("")), F.lit(">"))).otherwise(F.coalesce(address, F.lit("")))


def iso(seconds: Column) -> Column:
    """ISO date and time with offset, in the session's time zone; null is the epoch."""
    return F.date_format(F.timestamp_seconds(F.coalesce(seconds, F.lit(0))), "yyyy-MM-dd'T'HH:mm:ssxxx")


def message_token(account: Column, mailbox: Column, identifier: Column) -> Column:
    """URL-safe reference to a message at a place."""
    raw = F.to_json(F.struct(account.alias("a"), mailbox.alias("m"), identifier.alias("i")))
    return F.rtrim(F.translate(F.base64(F.encode(raw, "utf-8")), "+/\r\n", "-_"), F.lit("="))


def truncated(body: Column, most: int) -> Column:
    """Struct of the body's first max(200, most) characters and whether more there was."""
    n = max(200, most)
    return F.struct(F.substring(body, 1, n).alias("body"), (F.length(body) > n).alias("body_truncated"))


def preview(body: Column, most: int) -> Column:
    return F.translate(F.substring(body, 1, max(20, most)), "\r\n", "  ")


def records(raw: Column) -> Column:
    """Array of records, each an array of fields, from text framed by \\x1e and \\x1f."""
    rows = F.filter(F.split(F.coalesce(raw, F.lit("")), "\x1e"), lambda r: r != "")
    return F.transform(rows, lambda r: F.split(r, "\x1f"))


def field(record: Column, at: int, default: str = "") -> Column:
    return F.coalesce(F.get(record, F.lit(at)), F.lit(default))


def as_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)) == "true", F.lit(False))


def as_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(F.trim(c).try_cast("long"), F.lit(default))


def clean_field(c: Column) -> Column:
    """A value as a field of a framed record: its own separators become spaces; null is empty."""
    return F.translate(F.coalesce(c.cast("string"), F.lit("")), "\x1f\x1e", "  ")


def join_addresses(people: Column) -> Column:
    """"Name <address>, ..." of an array of structs (name, address)."""
    return F.array_join(F.transform(F.coalesce(people, F.array().cast("array<struct<name:string,address:string>>")), lambda p: sender(p["name"], p["address"])), ", ")


def message_row(identifier: Column, subject: Column, from_: Column, received: Column, read: Column, flagged: Column, mailbox: Column, account: Column) -> Column:
    """The framed record of a message, as records() and field() read it."""
    fields = [identifier.cast("string"), clean_field(subject), clean_field(from_), iso(received), read.cast("boolean").cast("string"), flagged.cast("boolean").cast("string"), clean_field(mailbox), clean_field(account)]
    return F.array_join(F.array(*fields), "\x1f")


def join_list(c: Column) -> Column:
    return F.array_join(F.filter(c, lambda x: x.isNotNull() & (x != "")), "\x1f")


def attachment_fields(c: Column) -> Column:
    """Array of (name, size, downloaded) from "name|size|downloaded;..."."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: x != "")

    def one(x: Column) -> Column:
        f = F.split(x, "\\|")
        return F.struct(field(f, 0).alias("name"), as_int(field(f, 1)).alias("size"), as_bool(field(f, 2)).alias("downloaded"))

    return F.transform(parts, one)
