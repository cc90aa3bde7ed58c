"""Vectorised text work on Arrow batches: slices of bounded size, words and their hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def release() -> None:
    """Gives memory that is free back to the system, so that an idle worker holds little of it."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


def released(run):
    """A function of batches that calls release() once it has read all."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Text with null as empty, offset 0, 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer text has a range of its own."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    start, n = 0, len(ends)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield start, stop
        start = stop


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of each text and the end) of a large_string array without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


@cache
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    value = mix(np.arange(256, dtype=np.uint64), 77) | np.uint64(1)
    is_word = np.zeros(256, bool)
    for lo, hi in ((48, 57), (65, 90), (97, 122), (128, 255)):
        is_word[lo : hi + 1] = True
    return value, is_word


_POWERS: list[np.ndarray] = []
_BASE = 0x5851F42D4C957F2D


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = []
        for b in (_BASE, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0][:n], _POWERS[1][:n]


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each data[start:end]."""
    value, _ = _byte_tables()
    up, down = _powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(value[data] * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _GOLD)


#: Bytes that are hashed together; a longer text is worked on in parts.
BLOCK = 1 << 22


def blocks(whole: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK bytes that begin where ``whole`` is False, so that no run of True is parted."""
    a, n = 0, len(whole)
    while a < n:
        b = min(n, a + BLOCK)
        if b < n:
            cut = np.flatnonzero(~whole[a + 1 : b + 1])
            if len(cut):
                b = a + 1 + int(cut[-1])
            else:  # a run longer than a block stays in one
                more = np.flatnonzero(~whole[b:])
                b = b + int(more[0]) if len(more) else n
        yield a, b
        a = b


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text's row, length in bytes) of each word in order.

    A word is a run of ASCII letters, digits and bytes of non-ASCII characters, in lower case;
    white space and ASCII punctuation part words, and none spans two texts.
    """
    data, offsets = raw(pc.utf8_lower(column))
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, is_word = _byte_tables()
    inside = is_word[data]
    edges = offsets[offsets < len(data)]
    out = []
    for a, b in blocks(inside):
        own = inside[a:b]
        here = edges[np.searchsorted(edges, a) : np.searchsorted(edges, b)] - a
        before = np.empty(b - a, bool)
        before[0] = False
        before[1:] = own[:-1]
        before[here] = False
        starts = np.flatnonzero(own & ~before)
        after = np.empty(b - a, bool)
        after[-1] = False
        after[:-1] = own[1:]
        after[here[here > 0] - 1] = False
        ends = np.flatnonzero(own & ~after) + 1
        out.append((spans(data[a:b], starts, ends), np.searchsorted(offsets, starts + a, "right") - 1, ends - starts))
    return out[0] if len(out) == 1 else tuple(np.concatenate(x) for x in zip(*out, strict=True))


def shingles(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every k words in a row; a text of fewer words has its whole as one shingle."""
    n = len(h)
    if not n:
        return h, row
    s = h.copy()
    alone = np.ones(n, bool)
    for j in range(1, k):
        if n <= j:
            break
        same = row[j:] == row[:-j]
        s[:-j] = np.where(same, mix(s[:-j] * np.uint64(0xD6E8FEB86659FD93) + h[j:], j), s[:-j])
    if n >= k:
        alone[: n - k + 1] = row[k - 1 :] != row[: n - k + 1]
    begins = np.ones(n, bool)
    begins[1:] = row[1:] != row[:-1]
    keep = ~alone | begins
    return s[keep], row[keep]
