"""Best-fit packing with vector capacities.

A bin (training sequence) has three capacities: tokens, documents, and attention cost (the sum of
the squares of its pieces' lengths, as attention stays within a document). Pieces in order of
decreasing length go to the open bin, among those with room in every dimension, that has the
greatest weighted dot-product of the piece's size and its residual capacities (DOT), or the
smallest norm of what would be left (NORM); where none has room, a bin opens.

A text longer than a piece may be is cut into pieces of that length and a remainder; the longest
piece is what a bin holds by its tokens and by its attention cost alone, so every bin is within
all three capacities. Documents are split by
hash into groups of about GROUP pieces, which are packed independently; a group leaves at most
a few bins part-filled.

Lengths are tokens of the byte-level BPE vocabulary of op7, or the column that ``length`` names.

Defined cases: null ids and documents of no tokens are left out; rows that repeat are packed as
often as they occur; ties go to the lesser doc_id, start and bin; an empty table gives no rows;
columns other than doc_id and text (or the length) are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from ._shared import written
from .mixing import tokens

TOKENS, DOCS = 2048, 16
ATTENTION = 2048 * 2048 * 3 // 4
GROUP = 8192
GROUPS_A_TASK, MOST_TASKS = 4, 20_000
#: Rows of one document that are packed together.
COPIES = 512
WEIGHTS = (1.0, 0.1, 0.3)
DOT, NORM = "dot", "norm"


def pack(size: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = WEIGHTS, rule: str = NORM) -> np.ndarray:
    """Bin of each piece, for pieces in the order given; size: tokens of each.

    A piece opens a bin unchecked: pieces are cut to longest() before.
    """
    cap = np.array(capacity, float)
    w = np.array(weights)
    n = len(size)
    item = np.stack([size, np.ones(n), size.astype(float) ** 2], axis=1) / cap
    out = np.empty(n, np.int64)
    room = np.empty((3, 64))  # residual capacities of open bins, as shares
    names = np.empty(64, np.int64)
    count = bins = 0
    least = item.min(axis=0) if n else item
    for i in range(n):
        v = item[i]
        r = room[:, :count]
        fits = (r[0] >= v[0] - 1e-12) & (r[1] >= v[1] - 1e-12) & (r[2] >= v[2] - 1e-12)
        where = np.flatnonzero(fits)
        if len(where):
            c = r[:, where]
            if rule == DOT:
                best = where[np.argmax(w @ (c * v[:, None]))]
            else:
                best = where[np.argmin(w @ (c - v[:, None]) ** 2)]
        else:
            if count == room.shape[1]:
                room, names = np.concatenate([room, np.empty_like(room)], axis=1), np.concatenate([names, np.empty_like(names)])
            best, count = count, count + 1
            room[:, best], names[best] = 1.0, bins
            bins += 1
        out[i] = names[best]
        room[:, best] -= v
        if (room[:, best] < least - 1e-12).any():  # closed for every piece
            count -= 1
            room[:, best:count], names[best:count] = room[:, best + 1 : count + 1].copy(), names[best + 1 : count + 1].copy()
    return out


def longest(capacity: tuple[int, int, int]) -> int:
    """Tokens of the longest piece that an empty bin has room for."""
    most = min(int(capacity[0]), math.isqrt(int(capacity[2])))
    if most < 1 or capacity[1] < 1:
        raise ValueError(f"no piece fits the capacities {capacity}")
    return most


def _group(capacity, weights, rule):
    most = longest(capacity)

    def run(part: pa.Table) -> pa.Table:
        copies = part.column("copies").to_numpy()
        ids, size = (np.repeat(part.column(c).to_numpy(), copies) for c in ("id", "n"))
        pieces = -(-size // most)
        row = np.repeat(np.arange(len(ids)), pieces)
        start = most * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        length = np.minimum(size[row] - start, most)
        order = np.lexsort((start, ids[row], -length))
        row, start, length = row[order], start[order], length[order]
        bins = pack(length, capacity, weights, rule)
        slot = np.lexsort((np.arange(len(bins)), bins))
        position = np.empty(len(bins), np.int64)
        first = np.searchsorted(bins[slot], bins[slot], "left")
        position[slot] = np.arange(len(bins)) - first
        g = part.column("g")[0].as_py()
        return pa.table({"doc_id": ids[row], "start": start, "tokens": length, "bin_id": (g << 32) + bins, "position": position})

    return run


def packed(docs: DataFrame, capacity: tuple[int, int, int] = (TOKENS, DOCS, ATTENTION), weights: tuple[float, float, float] = WEIGHTS, rule: str = NORM, length: str | None = None) -> DataFrame:
    """doc_id, start (first token of the piece), tokens, bin_id, position (in the bin) of every piece."""
    ship(docs.sparkSession)
    n = F.col(f"`{length}`").cast("long") if length else tokens(F.col("text"))
    sized = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), n.alias("n"))
    sized = written(sized, "lengths").where("n > 0")  # filtered once written, so that each text is counted once
    pieces = sized.agg(F.sum(F.ceil(F.col("n") / longest(capacity)))).first()[0] or 0
    groups = max(1, math.ceil(int(pieces) / GROUP))
    # a document may have any number of rows: they go to groups by COPIES
    same = sized.groupBy("id", "n").agg(F.count("*").alias("rows"))
    parts = same.select("id", "n", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / COPIES))).alias("k"))
    grouped = parts.select("id", "n", F.least(F.lit(COPIES).cast("long"), F.col("rows") - F.col("k") * COPIES).alias("copies"), F.pmod(F.xxhash64("id", "k"), F.lit(groups)).alias("g"))
    # groups are small rows and long work: as many tasks as some groups each ask for, not as their bytes do
    grouped = grouped.repartition(min(MOST_TASKS, max(1, groups // GROUPS_A_TASK)), "g")
    return grouped.groupBy("g").applyInArrow(_group(capacity, weights, rule), "doc_id long, start long, tokens long, bin_id long, position long")
