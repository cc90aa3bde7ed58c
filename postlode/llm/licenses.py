"""License scan: MinHash bands over overlapping windows, then exact shingle containment.

Templates are whole license texts, and the notices and file headers by which texts state a license
(``license_texts/``, public wording). Words of a text are cut into overlapping windows at several
lengths (each twice the stride of its level). A template belongs to the first level whose stride
holds it whole, so that wherever it stands some window covers it, and its Jaccard similarity with
that window is at least that of a template with CONTAINMENT of its shingles there. BANDS bands of
ROWS MinHash values then collide with probability at least GUARANTEE; a window that shares a band
with a template retrieves it, and the exact share of the template's shingles that the window and a
stride on either side hold decides.

Licenses are told apart by what sets them apart: of two licenses' templates that share half of
their shingles, each counts only where at least half of the shingles that the other lacks are
there (as the version or "Lesser"); of templates of different licenses at one place the one with
most shingles there is reported.

Defined cases: null and empty texts, and texts of fewer words than a shingle, have no license; a
null doc_id is left out; of several places of one license the greatest containment is reported;
templates with equally many shingles at a place are all reported; rows that repeat are reported as
often as they occur; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from . import _text

SHINGLE, CONTAINMENT = 3, 0.8
GUARANTEE = 0.9999
#: Share of a template's shingles from which another license's template is a relative, and share of
#: what sets the template apart from a relative that has to be there.
RELATED, APART = 0.5, 0.5

Templates = tuple[tuple[str, str], ...]


@cache
def templates() -> Templates:
    """(license, text) of every template; read on the driver."""
    folder, out = os.path.join(os.path.dirname(__file__), "license_texts"), []
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            if name == "notices.tsv":
                out += [tuple(line.rstrip("\n").split("\t")) for line in f]
            else:
                out.append((name.removesuffix(".txt"), f.read()))
    return tuple(out)


def band_count(similarity: float, rows: int, guarantee: float) -> int:
    """Least number of bands of so many rows that collide with probability ``guarantee`` at that similarity."""
    return math.ceil(math.log(1 - guarantee) / math.log(1 - similarity**rows))


class Index:
    """Templates by level. Stride at level l: FIRST * 2**l shingles."""

    FIRST, ROWS = 4, 1

    def __init__(self, templates: Templates):
        h, row, _ = _text.words(pa.array([t for _, t in templates], pa.large_string()))
        s, srow = _text.shingles(h, row, SHINGLE)
        self.names = [n for n, _ in templates]
        self.sets = [np.unique(s[srow == i]) for i in range(len(templates))]
        size = np.array([int((srow == i).sum()) for i in range(len(templates))])
        self.apart = []  # of each template: for each relative of another license, what the relative lacks
        for i, x in enumerate(self.sets):
            shared = [np.isin(x, y) if self.names[j] != self.names[i] else np.zeros(len(x), bool) for j, y in enumerate(self.sets)]
            self.apart.append([x[~z] for z in shared if z.mean() >= RELATED and not z.all()])
        self.level = np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) / self.FIRST))).astype(int)
        self.levels = int(self.level.max()) + 1 if templates else 0
        # the least similarity of a template that is wholly inside: its size against the window of two strides
        least = min((len(x) * CONTAINMENT / (2 * self.FIRST * 2**k) for x, k in zip(self.sets, self.level, strict=True)), default=1.0)
        self.bands = band_count(min(least, 0.99), self.ROWS, GUARANTEE)
        self.buckets = []  # of each level and band: sorted MinHash values and their templates
        for k in range(self.levels):
            own = np.flatnonzero(self.level == k)
            per = []
            for b in range(self.bands):
                v = np.array([_salted(self.sets[i], b).min() for i in own], np.uint32)
                order = np.argsort(v, kind="stable")
                per.append((v[order], own[order]))
            self.buckets.append(per)

    def maybe(self, k: int, b: int) -> np.ndarray:
        """Bit map of the low 16 bits of the band's values."""
        t = np.zeros(1 << 16, bool)
        t[self.buckets[k][b][0] & np.uint32(0xFFFF)] = True
        return t


def _salted(s: np.ndarray, b: int) -> np.ndarray:
    """32-bit hash number b of shingles."""
    return ((s * np.uint64((0x9E3779B97F4A7C15 * (2 * b + 1)) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(32)).astype(np.uint32)


@cache
def _index(templates: Templates) -> Index:
    return Index(templates)


def _levels(edge: np.ndarray, doc: np.ndarray, levels: int) -> list[tuple]:
    """Of each level: starts of strides, whether the next stride is of the same text, and how strides join in twos to the next level's."""
    out = []
    for _ in range(levels):
        n = len(doc)
        same = doc[1:] == doc[:-1]
        begin = np.ones(n, bool)
        begin[1:] = ~same
        number = np.arange(n) - np.maximum.accumulate(np.where(begin, np.arange(n), 0))
        first = np.flatnonzero(number % 2 == 0)
        nxt = np.minimum(first + 1, n - 1)
        two = (nxt > first) & (doc[nxt] == doc[first])
        out.append((edge, same, first, np.where(two, nxt, first)))
        edge, doc = edge[first], doc[first]
    return out


def _retrieved(s: np.ndarray, doc: np.ndarray, x: Index) -> set[tuple[int, int]]:
    """(first shingle of a window, template) of those that share a band."""
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    strides = -(-np.diff(np.append(begin, len(doc))) // x.FIRST)
    edge = np.repeat(begin, strides) + x.FIRST * (np.arange(strides.sum()) - np.repeat(np.cumsum(strides) - strides, strides))
    levels = _levels(edge, doc[edge], x.levels)
    pairs: set[tuple[int, int]] = set()
    for band in range(x.bands):
        low = np.minimum.reduceat(_salted(s, band), edge)
        for k, (at, same, first, nxt) in enumerate(levels):
            values, owners = x.buckets[k][band]
            if len(values):
                window = low.copy()
                np.minimum(window[:-1], low[1:], out=window[:-1], where=same)
                for i in np.flatnonzero(x.maybe(k, band)[window & np.uint32(0xFFFF)]):
                    lo, hi = np.searchsorted(values, window[i], "left"), np.searchsorted(values, window[i], "right")
                    pairs.update((int(at[i]), int(t)) for t in owners[lo:hi])
            low = np.minimum(low[first], low[nxt])
    return pairs


def _best(places: list[tuple[int, int, float, np.ndarray]], names: list[str]) -> dict[str, float]:
    """License -> containment of a text's places (shingles held, template, containment, where they stand): at a place the licenses with most shingles."""
    out: dict[str, float] = {}
    taken: list[tuple[int, str, np.ndarray]] = []
    for held, t, share, where in sorted(places, key=lambda p: (-p[0], p[1], p[3][0])):
        if not any(n > held and name != names[t] and 2 * np.isin(where, other).sum() > len(where) for n, name, other in taken):
            taken.append((held, names[t], where))
            out[names[t]] = max(out.get(names[t], 0.0), share)
    return out


def scan(texts: pa.Array, templates: Templates) -> list[tuple[int, str, float]]:
    """(text, license, containment) of every text and license that are found."""
    x = _index(templates)
    found = []
    for a, b in _text.slices(texts):
        h, row, _ = _text.words(texts.slice(a, b - a))
        s, doc = _text.shingles(h, row, SHINGLE)
        if not len(s):
            continue
        edges = np.append(np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])), len(doc))
        places: dict[int, list[tuple[int, int, float, np.ndarray]]] = {}
        for at, t in _retrieved(s, doc, x):
            stride, which = x.FIRST << int(x.level[t]), int(np.searchsorted(edges, at, "right")) - 1
            lo, hi = max(int(edges[which]), at - stride), min(int(edges[which + 1]), at + 3 * stride)
            part = s[lo:hi]
            there = np.isin(x.sets[t], part)
            share = float(there.mean())
            if share < CONTAINMENT or any(np.isin(d, part).mean() < APART for d in x.apart[t]):
                continue
            where = lo + np.flatnonzero(np.isin(part, x.sets[t]))
            places.setdefault(int(doc[at]), []).append((int(there.sum()), t, share, where))
        for i, own in sorted(places.items()):
            found += [(a + i, name, share) for name, share in sorted(_best(own, x.names).items())]
    return found


def found(docs: DataFrame, among: Templates | None = None) -> DataFrame:
    """doc_id, license, containment of every license found in every document."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(templates() if among is None else among)  # some 300 KB of texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = scan(_text.as_strings(batch.column(1)), sent.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())],
                names=["doc_id", "license", "containment"],
            )

    narrow = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return narrow.mapInArrow(_text.released(run), "doc_id long, license string, containment double")
