"""The inverted index: postings of messages, and the query language answered from them.

A posting is a term of a column of a message with its positions. Postings are stored by block of
messages: a row has a term and a column, and all messages of the block with it. So there are few
rows to sort, and none to shuffle: each task sorts and writes the blocks of its own messages. Rows
are stored by bucket (a hash of the first two characters of the term) and sorted by term, so that a
query reads the buckets and row groups of its own terms, and no text. One scan and one grouping by
message answer any query: as NOT has a left side, a message that matches has one of the query's
terms.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import match
from ..functions import text as X
from ..ship import ship

TEXT = ("subject", "sender", "recipients", "attachments", "body")
BUCKETS, BLOCK = 32, 1 << 23  # bytes of text in a block; a longer text is a block of its own
SCHEMA = "id long, c byte, term string, p array<int>, bucket int"
#: ids, numbers of their positions and positions, packed; messages that have the term (in the row of its first column, else 0); places
BLOCKS = "term string, c byte, ids binary, sizes binary, p binary, messages int, places int, bucket int"
_END, _NONE = 0x110000, 0x110001  # no characters: what stands after each text, and what goes


def bucket(term: str) -> int:
    return zlib.crc32(term[:2].encode()) % BUCKETS


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: what it is folded to, and whether that belongs to terms, as match.words() has it."""
    fold, word = np.arange(_END + 1, dtype=np.uint32), np.zeros(_END + 1, bool)
    every = [chr(cp) for cp in range(_END) if not 0xD800 <= cp < 0xE000]
    points = np.array([ord(x) for x in every])
    src, dst = X.fold_map()
    base = dict(zip(src, dst, strict=True))
    marks = set(X._MARKS)
    fold[points] = [_NONE if x in marks else ord(base.get(x, x).lower()[0]) for x in every]
    word[points] = [unicodedata.category(x)[0] in "LN" or unicodedata.category(x) == "Co" for x in every]
    return fold, word


def _terms(texts: list[str]) -> tuple[np.ndarray, pa.StringArray]:
    """(number of the text, term) of each term of the texts, in order."""
    fold, word = _characters()
    if any("Σ" in t for t in texts):  # its lower case depends on what follows
        texts = [X.fold_text(t) for t in texts]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32).copy()
    points[np.cumsum(size + 1) - 1] = _END
    points = fold[points]
    there = points != _NONE
    if not there.all():
        points = points[there]
    inside = word[points]
    edges = np.flatnonzero(np.diff(inside, prepend=False))  # the last is no term's character: starts and ends by turns
    first, last = edges[::2], edges[1::2]
    row = np.searchsorted(np.flatnonzero(points == _END), first)
    kept = points[inside]
    width = (kept >= 0x80).astype(np.int8) + (kept >= 0x800) + (kept >= 0x10000) + 1
    ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(last - first)])]
    data = kept.tobytes().decode("utf-32-le").encode()
    return row, pa.StringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where any of the keys, of one length above 0, is another than before."""
    new = keys[0][1:] != keys[0][:-1]
    for k in keys[1:]:
        new = new | (k[1:] != k[:-1])
    return np.flatnonzero(np.concatenate([[True], new]))


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of unsigned numbers, seven bits each, the last one below 128; where each number begins, and the end)."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    top = int(values.max()) if len(values) else 0
    for k in range(7, top.bit_length(), 7):
        size += values >> np.uint64(k) > 0
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.uint8)
    for k in range(int(size.max()) if len(values) else 0):
        own = size > k
        byte = (values[own] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[:-1][own] + k] = byte + np.where(size[own] > k + 1, np.uint64(128), np.uint64(0))
    return out, at


def _numbers(data: np.ndarray) -> np.ndarray:
    """Numbers of _varints() bytes, as signed ones."""
    last = np.flatnonzero(data < 128)
    begin = np.concatenate([[0], last[:-1] + 1])
    out = (data[begin] & 127).astype(np.int64)
    size = last - begin + 1
    for k in range(1, int(size.max()) if len(size) else 0):
        own = np.flatnonzero(size > k)
        out[own] |= (data[begin[own] + k] & 127).astype(np.int64) << (7 * k)
    return out


def _gaps(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Differences to the value before, but at where a list begins."""
    out = np.diff(values, prepend=values[:1])
    out[begin] = values[begin]
    return out


def _summed(gaps: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The values of _gaps()."""
    total = np.cumsum(gaps)
    return total - np.repeat(total[begin] - gaps[begin], np.diff(np.append(begin, len(gaps))))


def _packed(values: np.ndarray, begin: np.ndarray) -> pa.BinaryArray:
    """Lists of numbers as bytes, by where each begins."""
    data, at = _varints(values)
    return pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(at[np.append(begin, len(values))].astype(np.int32)), pa.py_buffer(data)])


def _unpacked(lists: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, where each list begins); no list is empty."""
    at = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
    data = np.frombuffer(lists.buffers()[2], np.uint8)[at[0] : at[-1]]
    return _numbers(data), np.concatenate([[0], np.cumsum(data < 128)])[at[:-1] - at[0]]


def _block(rows: pa.RecordBatch) -> pa.RecordBatch | None:
    """The block of some messages: id, and a text a column."""
    rows = rows.sort_by("id")
    n = rows.num_rows
    ids = rows.column(0).to_numpy()
    row, words = _terms([t or "" for c in range(1, rows.num_columns) for t in rows.column(c).to_pylist()])  # row: column * n + message
    if not len(row):
        return None
    position = np.arange(len(row)) - np.searchsorted(row, row)
    coded = words.dictionary_encode()
    known = pa.table({"bucket": np.array([bucket(t) for t in coded.dictionary.to_pylist()], np.int32), "term": coded.dictionary})
    sort = pc.sort_indices(known, sort_keys=[("bucket", "ascending"), ("term", "ascending")]).to_numpy()
    known, rank = known.take(pa.array(sort)).combine_chunks().to_batches()[0], np.empty(len(sort), np.int64)
    rank[sort] = np.arange(len(sort))
    # by bucket and term, then in order: by column, message, position
    order = np.sort(rank[coded.indices.to_numpy()] << 32 | np.arange(len(row)))
    code, order = order >> 32, order & 0xFFFFFFFF
    row, position = row[order], position[order]
    each = _starts(code, row)  # a posting
    own, at = code[each], row[each]
    group = _starts(own, at // n)  # a row: postings of one term and column
    begin = each[group]
    held = np.sort(own * n + at % n)
    messages = np.bincount(held[_starts(held)] // n)  # all codes are there
    term = own[group]
    counted = np.zeros(len(group), np.int32)
    top = _starts(term)
    counted[top] = messages[term[top]]
    step = _gaps(ids[at % n], group)
    columns = [
        known.column("term").take(pa.array(term)),
        pa.array((at[group] // n).astype(np.int8)),
        _packed((step << 1) ^ (step >> 63), group),  # the sign is the last bit
        _packed(np.diff(np.append(each, len(row))), group),
        _packed(_gaps(position, each), begin),
        pa.array(counted),
        pa.array(np.diff(np.append(begin, len(row))).astype(np.int32)),
        known.column("bucket").take(pa.array(term)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["term", "c", "ids", "sizes", "p", "messages", "places", "bucket"])


def _pieces(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows again, as many at a time as have BLOCK bytes in the columns, and one at least."""
    held, full = [], 0

    def done() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy().astype(np.int64) for c in columns)
        start = 0
        while start < batch.num_rows:
            fits = int(np.searchsorted(np.cumsum(size[start:]), BLOCK - full, "right")) or int(not held)
            if fits:
                held.append(batch.slice(start, fits))
                full += int(size[start : start + fits].sum())
                start += fits
            if start < batch.num_rows:
                yield done()
                held, full = [], 0
    if held:
        yield done()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches, list(TEXT)):
        found = _block(piece)
        if found is not None:
            yield found


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, c, term, p, bucket of rows of blocks; p is null where sizes and p are not among the columns."""
    for rows in _pieces(batches, ["ids"]):
        for piece in _pieces(iter([rows]), ["p"]) if "p" in rows.schema.names else [rows]:
            coded, group = _unpacked(piece.column("ids"))
            ids = _summed(((coded >> 1) & 0x7FFFFFFFFFFFFFFF) ^ -(coded & 1), group)
            row = pa.array(np.repeat(np.arange(len(group)), np.diff(np.append(group, len(ids)))))
            p = pa.nulls(len(ids), pa.list_(pa.int32()))
            if "p" in piece.schema.names:
                at = np.concatenate([[0], np.cumsum(_unpacked(piece.column("sizes"))[0])])
                position = _summed(_unpacked(piece.column("p"))[0], at[:-1]).astype(np.int32)
                p = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(position))
            yield pa.RecordBatch.from_arrays([pa.array(ids), piece.column("c").take(row), piece.column("term").take(row), p, piece.column("bucket").take(row)], names=["id", "c", "term", "p", "bucket"])


def blocks(messages: DataFrame) -> DataFrame:
    """The stored form of the postings of messages; columns that are missing have none."""
    ship(messages.sparkSession)
    there = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in messages.columns else F.lit("").alias(c) for c in TEXT]
    return messages.where("id is not null").select(F.col("id").cast("long").alias("id"), *there).mapInArrow(_blocks, BLOCKS)


def opened(rows: DataFrame, positions: bool = True) -> DataFrame:
    """id, c, term, p, bucket: a row a posting, of blocks; without positions these aren't read, and p is null."""
    ship(rows.sparkSession)
    return rows.select("term", "c", "bucket", "ids", *(["sizes", "p"] if positions else [])).mapInArrow(_postings, SCHEMA)


def postings(messages: DataFrame) -> DataFrame:
    """id, c (number in TEXT), term, p, bucket of messages; columns that are missing have none."""
    return opened(blocks(messages))


def terms(rows: DataFrame) -> DataFrame:
    """term, messages that have it, places: of postings."""
    return rows.groupBy("term").agg(F.count_distinct("id").alias("messages"), F.sum(F.size("p")).alias("places"))


def terms_of_blocks(rows: DataFrame) -> DataFrame:
    """terms() from the counts of blocks, where none of them holds an id of another's: positions aren't read, and only counts are shuffled."""
    return rows.groupBy("term").agg(F.sum("messages").alias("messages"), F.sum("places").alias("places"))


def write(rows: DataFrame, path: str) -> None:
    """Blocks by bucket, sorted by term, each where it is; a block's rows are in that order already."""
    rows.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def _leaves(tree) -> list[match.Near]:
    if isinstance(tree, match.Op):
        return _leaves(tree.left) + _leaves(tree.right)
    return [tree] if isinstance(tree, match.Near) else []


def _columns(leaf: match.Near) -> list[int]:
    return [i for i, c in enumerate(TEXT) if leaf.columns is None or c in leaf.columns]


def _is(term: tuple[str, bool]) -> Column:
    text, prefix = term
    return F.col("term").startswith(text) if prefix else F.col("term") == text


def _wanted(terms: list[tuple[str, bool]]) -> Column:
    """Rows of the terms; whole buckets are left out where no short prefix asks for all."""
    where = F.lit(False)
    exact = [t for t, prefix in terms if not prefix]
    if exact:
        where = F.col("term").isin(exact)
    for t, prefix in terms:
        if prefix:
            where |= F.col("term").startswith(t)
    if any(prefix and len(t) < 2 for t, prefix in terms):
        return where
    return F.col("bucket").isin(sorted({bucket(t) for t, _ in terms})) & where


def _simple(leaf: match.Near) -> bool:
    return len(leaf.phrases) == 1 and len(leaf.phrases[0].terms) == 1 and not leaf.phrases[0].first


def find(rows: DataFrame | Callable[[Column, bool], DataFrame], query: str) -> tuple[DataFrame, str]:
    """(id of every message that matches, query as interpreted), from postings, or a function of a condition and of whether positions are needed."""
    tree, used = match.interpreted(query, TEXT)
    leaves = _leaves(tree)
    terms = sorted({t for leaf in leaves for p in leaf.phrases for t in p.terms})
    read = rows if callable(rows) else lambda where, _: rows.where(where)
    if not terms:
        return read(F.lit(False), False).select("id"), used
    number = {t: k for k, t in enumerate(terms)}
    flags = [F.coalesce(F.max(_is(leaf.phrases[0].terms[0]) & F.col("c").isin(_columns(leaf))), F.lit(False)).alias(f"leaf{i}") for i, leaf in enumerate(leaves) if _simple(leaf)]
    others = [(i, leaf) for i, leaf in enumerate(leaves) if not _simple(leaf)]
    per = read(_wanted(terms), bool(others))
    if others:
        # positions are compared within a column; both groupings are of rows that were shuffled by id
        held = [F.flatten(F.collect_list(F.when(_is(terms[k]), F.col("p")))).alias(f"at{k}") for k in sorted({number[t] for _, leaf in others for p in leaf.phrases for t in p.terms})]
        per = per.repartition("id").groupBy("id", "c").agg(*flags, *held)
        flags = [F.max(f"leaf{i}").alias(f"leaf{i}") for i, leaf in enumerate(leaves) if _simple(leaf)]
        flags += [F.max(F.col("c").isin(_columns(leaf)) & _near(leaf, lambda term: F.col(f"at{number[term]}"))).alias(f"leaf{i}") for i, leaf in others]
    per = per.groupBy("id").agg(*flags)
    at = {id(leaf): i for i, leaf in enumerate(leaves)}

    def column(node) -> Column:
        if isinstance(node, match.Nothing):
            return F.lit(False)
        if isinstance(node, match.Op):
            left, right = column(node.left), column(node.right)
            return left & right if node.kind == "AND" else left | right if node.kind == "OR" else left & ~right
        return F.col(f"leaf{at[id(node)]}")

    return per.where(column(tree)).select("id"), used


def _near(leaf: match.Near, at) -> Column:
    """at: positions of a term in the column that is looked at."""

    def starts(p: match.Phrase) -> Column:
        def whole(s: Column) -> Column:
            ok = s == 0 if p.first else F.lit(True)
            for j, t in enumerate(p.terms[1:], 1):
                ok &= F.array_contains(at(t), s + j)
            return ok

        return F.filter(at(p.terms[0]), whole)

    if len(leaf.phrases) == 1:
        return F.size(starts(leaf.phrases[0])) > 0
    # what a lambda takes as its variable is evaluated once
    def clump(places: Column) -> Column:
        def last_at(m: Column) -> Column:
            ok = F.lit(True)
            for k, p in enumerate(leaf.phrases):
                ok &= _exists_between(F.get(places, F.lit(k)), m, len(p.terms) + leaf.distance)
            return ok

        return F.exists(F.flatten(places), last_at)

    return F.exists(F.array(F.array(*[starts(p) for p in leaf.phrases])), clump)


def _exists_between(places: Column, m: Column, reach: int) -> Column:
    return F.exists(places, lambda s: (s <= m) & (s >= m - F.lit(reach)))
