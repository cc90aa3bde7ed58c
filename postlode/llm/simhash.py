"""SimHash near-duplicates by a self-join of binary tries.

A document's signature has 256 bits over its set of words, all of them. The first 128 are searched:
two documents are candidates within BUDGET differing bits there, and duplicates if at most
FULL_BUDGET of all 256 differ. Any pair within BUDGET spends no more than its share of errors in
one of six blocks (the shares sum to BUDGET - 5), so six tries, each with another block's bits on
top, find every pair exactly: node pairs descend together, add up the bits that differ, and end
where a share is exceeded.

Tries are cut at depth p into cells that join independently; a signature goes to each cell whose p
bits are within the share of its own. A cell of more than HOME signatures of its own, or GUESTS of
others, is cut into chunks, each two of which meet in a task of their own. A task returns no pairs
but, for each of its signatures, the number of its partners there and one signature of its
connected group there, so a group of any size gives as many rows as it has members.

Defined cases: null ids, and texts without a word (null, empty, punctuation only), belong to no
group; rows that repeat doc_id and text are one document; a doc_id whose rows hold different texts
is one document for each text; documents of equal word sets have equal signatures; the document of
the least doc_id (of one doc_id, the least hash of the text) of a group is the one kept; an empty
table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from . import _text
from ._shared import Forest, dropped, fresh, written

BUDGET, FULL_BUDGET = 19, 38
#: (first bit, bits, errors it may hold) of each block of the searched 128 bits.
BLOCKS = ((0, 22, 3), (22, 22, 3), (44, 21, 2), (65, 21, 2), (86, 21, 2), (107, 21, 2))
LANES = 240
#: Signatures of a task: of the cell's own, and of others.
HOME, GUESTS = 1 << 17, 1 << 18
#: Tries are cut at this depth at least, so that cells are as many as cores, and at most at all bits of a block.
SHALLOWEST, DEEPEST = 3, 21
SALTS = 32
#: Most documents to drop that are sent to all tasks (some 60 bytes each there); for more, texts are shuffled to meet them.
BROADCAST_ROWS = 2_000_000
BITS = ["s0", "s1", "s2", "s3"]

assert sum(e + 1 for *_, e in BLOCKS) > BUDGET


def _spread() -> np.ndarray:
    """For each byte, its 8 bits in the 8 lanes of a 64-bit word."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    return np.ascontiguousarray(bits).view(np.uint64)[:, 0]


_SPREAD = _spread()


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(4 x uint64 of each text, whether it has a signature)."""
    n = len(texts)
    out, has = np.zeros((n, 4), np.uint64), np.zeros(n, bool)
    for a, b in _text.slices(texts):
        h, row, _ = _text.words(texts.slice(a, b - a))
        if not len(h):
            continue
        own = _text.mix(h ^ _text.mix(row.astype(np.uint64), 5))
        _, first = np.unique(own, return_index=True)
        first.sort()
        h, row = h[first], row[first]
        rows, begin, count = np.unique(row, return_index=True, return_counts=True)
        # runs of at most LANES words, whose 8-bit lanes can't overflow
        runs = (count + LANES - 1) // LANES
        at = np.repeat(begin, runs) + LANES * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
        whole = np.cumsum(runs) - runs
        for j in range(4):
            planes = _text.mix(h, 11 + j).view(np.uint8).reshape(-1, 8)
            ones = np.empty((len(rows), 8, 8), np.int64)
            for k in range(8):
                lanes = np.add.reduceat(_SPREAD[planes[:, k]], at)
                ones[:, k] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), whole, axis=0)
            bit = (2 * ones >= count[:, None, None]).reshape(len(rows), 64)
            out[a + rows, j] = np.packbits(bit, axis=1).view(np.uint64)[:, 0]
        has[a + rows] = True
    return out, has


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig, has = signatures(_text.as_strings(batch.column(2)))
        cols = [pa.array(np.ascontiguousarray(sig[:, j]).view(np.int64), mask=~has) for j in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc_id", "t", *BITS])


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text) and the signature s0..s3 (null: no word) of every row with a doc_id."""
    ship(docs.sparkSession)
    narrow = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return narrow.mapInArrow(_text.released(_sign), "doc_id long, t long, s0 long, s1 long, s2 long, s3 long")


def _rotated(hi: np.ndarray, lo: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits turned left."""
    if by >= 64:
        hi, lo, by = lo, hi, by - 64
    if not by:
        return hi, lo
    u, d = np.uint64(by), np.uint64(64 - by)
    return (hi << u) | (lo >> d), (lo << u) | (hi >> d)


def _ranges(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts, (which, number within it) of each unit."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def trie_pairs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray] | None, bits: int, share: int, budget: int = BUDGET, small: int = 32, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (i of a, j of b) of the pairs within share in the first bits and budget in all 128, in portions.

    a and b: (high, low) 64 bits, each sorted by high. Without b: pairs i < j of a. A node is a
    range of the sorted signatures; at most ``most`` node pairs are taken down together.
    """
    self_join = b is None
    b = a if self_join else b
    one = np.uint64(1)

    def zeros_of(side):
        # up to[d][i]: signatures before i whose bit d is 0
        out = np.zeros((bits, len(side[0]) + 1), np.int32)
        for d in range(bits):
            np.cumsum(((side[0] >> np.uint64(63 - d)) & one) == 0, out=out[d, 1:])
        return out

    za = zeros_of(a)
    zb = za if self_join else zeros_of(b)

    def compare(al, ah, bl, bh):
        """All pairs of each two ranges, in portions."""
        n = (ah - al).astype(np.int64) * (bh - bl)
        cuts = np.searchsorted(np.cumsum(n), np.arange(1 << 20, int(n.sum()) + (1 << 20), 1 << 20), "left") + 1
        start = 0
        for stop in np.minimum(cuts, len(n)):
            if stop <= start:
                continue
            which, k = _ranges(n[start:stop])
            width = (bh - bl)[start:stop][which]
            i, j = al[start:stop][which] + k // width, bl[start:stop][which] + k % width
            if self_join:
                up = i < j
                i, j = i[up], j[up]
            x = a[0][i] ^ b[0][j]
            e = np.bitwise_count(x >> np.uint64(64 - bits))
            ok = e <= share
            i, j, x = i[ok], j[ok], x[ok]
            ok = np.bitwise_count(x).astype(np.int16) + np.bitwise_count(a[1][i] ^ b[1][j]) <= budget
            if ok.any():
                yield i[ok], j[ok]
            start = stop

    z = np.zeros(1, np.int64)
    stack = [(0, z, z + len(a[0]), z, z + len(b[0]), z.astype(np.int8))] if len(a[0]) and len(b[0]) else []
    while stack:
        d, al, ah, bl, bh, err = stack.pop()
        done = ((ah - al) * (bh - bl) <= small) | (d == bits)
        if done.any():
            yield from compare(al[done], ah[done], bl[done], bh[done])
            al, ah, bl, bh, err = (v[~done] for v in (al, ah, bl, bh, err))
        if not len(al):
            continue
        am, bm = al + za[d][ah] - za[d][al], bl + zb[d][bh] - zb[d][bl]
        parts = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1)]
        cross = slice(None) if not self_join else (al != bl)  # a node with itself: 0-1 and 1-0 are the same pairs
        parts.append(tuple(v[cross] for v in (am, ah, bl, bm, err + 1)))
        al, ah, bl, bh, err = (np.concatenate(v) for v in zip(*parts, strict=True))
        live = (err <= share) & (ah > al) & (bh > bl)
        al, ah, bl, bh, err = (v[live] for v in (al, ah, bl, bh, err))
        stack += [(d + 1, *(v[s : s + most] for v in (al, ah, bl, bh, err))) for s in range(0, len(al), most)]


def _first_block(x: np.ndarray, y: np.ndarray, r: int) -> np.ndarray:
    """Whether no block before r has the pair within its share too; x, y: differing bits."""
    first = np.ones(len(x), bool)
    for at, bits, share in BLOCKS[:r]:
        top, _ = _rotated(x, y, at)
        first &= np.bitwise_count(top >> np.uint64(64 - bits)) > share
    return first


def masks(depth: int) -> dict[int, np.ndarray]:
    """For each share of errors, the differences of the first bits that it allows; 0 first."""
    return {e: np.array([sum(1 << c for c in combo) for k in range(e + 1) for combo in combinations(range(depth), k)]) for e in {e for *_, e in BLOCKS}}


def _tops(sig: list[np.ndarray], depth: int) -> list[np.ndarray]:
    """The first bits of each block."""
    return [(_rotated(sig[0], sig[1], at)[0] >> np.uint64(64 - depth)).astype(np.int64) for at, *_ in BLOCKS]


def _sig(batch: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [batch.column(c).to_numpy().view(np.uint64) for c in BITS]


def _home_counts(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(BLOCKS), 1 << depth), np.int64)
        for batch in batches:
            for r, top in enumerate(_tops(_sig(batch), depth)):
                count[r] += np.bincount(top, minlength=1 << depth)
        r, cell = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(count[r, cell])], names=["r", "cell", "n"])

    return run


def chunks_of(home: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of own signatures, and of others, of each block and cell, from the cells' counts of own ones."""
    own, guests = np.ceil(home / HOME).astype(np.int32), np.zeros_like(home)
    cell = np.arange(1 << depth)
    for r, (*_, share) in enumerate(BLOCKS):
        for m in masks(depth)[share][1:]:
            other = cell ^ m
            guests[r] += np.where(other > cell, home[r][other], 0)
    return np.maximum(own, 1), np.ceil(guests / GUESTS).astype(np.int32)


def _tasks(depth: int, sent):
    """Each signature for the tasks that need it; a pair of cells meets in the lesser of the two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, guests = sent.value
        near = masks(depth)
        for batch in batches:
            mixed = _text.mix(batch.column(0).to_numpy().view(np.uint64), 3) >> np.uint64(1)
            for r, top in enumerate(_tops(_sig(batch), depth)):
                cell = top[:, None] ^ near[BLOCKS[r][2]]
                i, k = np.nonzero(cell <= top[:, None])
                cell, home = cell[i, k], k == 0
                h, g = own[r][cell], guests[r][cell]
                mine = (mixed[i] % np.where(home, h, np.maximum(g, 1)).astype(np.uint64)).astype(np.int64) + np.where(home, 0, h)
                # a chunk at home meets itself, the others at home, and all of guests; one of guests all at home
                which, o = _ranges(np.where(home, h + g, h))
                a, b = np.minimum(mine[which], o), np.maximum(mine[which], o)
                task = ((np.int64(r) << 21 | cell[which]) << 40) | a << 20 | b
                for s in range(0, len(which), 1 << 15):
                    w = which[s : s + (1 << 15)]
                    rows = batch.take(pa.array(i[w]))
                    yield pa.RecordBatch.from_arrays([pa.array(task[s : s + (1 << 15)]), pa.array(mine[w] == a[s : s + (1 << 15)]), *rows.columns], names=["task", "own", *rows.schema.names])

    return run


def _join(task: pa.Table) -> pa.Table:
    """node, links, root of the signatures of a task that have partners in it."""
    key = task.column("task")[0].as_py() & (2**64 - 1)
    r = key >> 61
    at, bits, share = BLOCKS[r]
    node, weight, own = (task.column(c).to_numpy() for c in ("node", "weight", "own"))
    sig = _sig(task)
    top, rest = _rotated(sig[0], sig[1], at)
    sides = []
    for part in (np.flatnonzero(own), np.flatnonzero(~own)):
        part = part[np.argsort(top[part], kind="stable")]
        sides.append((part, (top[part], rest[part])))
    (left, a), (right, b) = sides
    alone = key >> 20 & (2**20 - 1) == key & (2**20 - 1)
    links, forest = np.zeros(len(node), np.int64), Forest(len(node))
    for i, j in trie_pairs(a, None if alone else b, bits, share):
        i, j = left[i], left[j] if alone else right[j]
        x = [s[i] ^ s[j] for s in sig]
        ok = _first_block(x[0], x[1], r) & (sum(np.bitwise_count(d).astype(np.int16) for d in x) <= FULL_BUDGET)
        i, j = i[ok], j[ok]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        forest.add(i, j)
    some = links > 0
    out = pa.table({"node": node[some], "links": links[some], "root": node[forest.root[some]]})
    del sig, sides, a, b, top, rest
    _text.release()
    return out


def met(nodes: DataFrame, n: int) -> DataFrame:
    """node, links, root: partial counts of partners (by weight), and of each a member of its group, of the n distinct signatures in nodes (node, weight, s0..s3)."""
    depth = min(DEEPEST, max(SHALLOWEST, math.ceil(math.log2(max(n, 1) / HOME))))
    home = np.zeros((len(BLOCKS), 1 << depth), np.int64)
    # a row a cell, of which there are about n / HOME in each block
    for batch in nodes.select(*BITS).mapInArrow(_text.released(_home_counts(depth)), "r int, cell int, n long").groupBy("r", "cell").agg(F.sum("n").alias("n")).toArrow().to_batches():
        home[batch.column(0).to_numpy(), batch.column(1).to_numpy()] = batch.column(2).to_numpy()
    sent = nodes.sparkSession.sparkContext.broadcast(chunks_of(home, depth))  # 8 bytes a cell and block
    narrow = nodes.select("node", "weight", *BITS)
    tasks = narrow.mapInArrow(_text.released(_tasks(depth, sent)), "task long, own boolean, node long, weight long, s0 long, s1 long, s2 long, s3 long")
    return tasks.groupBy("task").applyInArrow(_join, "node long, links long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id reachable over edges (x, y), for every id that has an edge.

    Alternates large-star and small-star steps until the edges no longer change; each round's
    edges are a written table.
    """
    spark = edges.sparkSession
    now = written(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x")
        new = small.select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(low.select("x", F.col("m").alias("y"))).where("x <> y").distinct()
        new = written(new, "edges")
        dropped(now)
        now = new
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("x").alias("id"), F.col("y").alias("root")).unionByName(now.select(F.col("y").alias("id"), F.col("y").alias("root")).distinct())
        mark = seen


def grouped(items: DataFrame) -> DataFrame:
    """doc_id, t, group_id, keep, links of the documents in items (doc_id, t, s0..s3; each once) that have a near copy."""
    # documents of equal signatures are one node; salted, as a third of all may be copies of one
    salt = F.pmod(F.xxhash64("doc_id", "t"), F.lit(SALTS)).alias("salt")
    signed = items.where("s0 is not null")
    some = signed.groupBy(*BITS, salt).agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "t")).alias("least"))
    nodes = some.groupBy(*BITS).agg(F.sum("c").alias("weight"), F.min("least").alias("least"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), *BITS, "weight", "least"), "signatures")
    near = written(met(nodes, nodes.count()), "near")
    links = near.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(near.select(F.col("node").alias("x"), F.col("root").alias("y"))).withColumnRenamed("id", "node")
    found = nodes.join(links, "node", "left").join(roots, "node", "left").where("links is not null or weight > 1")
    found = found.select(*BITS, "weight", "least", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    first = found.groupBy("root").agg(F.min("least").alias("first"))
    known = found.join(first, "root").select(*BITS, "first", (F.col("links") + F.col("weight") - 1).alias("links"))
    spread = some.select(*BITS, "salt").join(known, BITS)
    out = signed.select("doc_id", "t", *BITS, salt).join(spread, [*BITS, "salt"])
    out = written(out.select("doc_id", "t", F.col("first.doc_id").alias("group_id"), (F.struct("doc_id", "t") == F.col("first")).alias("keep"), "links"), "groups")
    for x in (nodes, near):
        dropped(x)
    return out


def _items(docs: DataFrame) -> DataFrame:
    """doc_id, t, s0..s3, rows: each document once, and how many rows it has."""
    return written(sign(docs).groupBy("doc_id", "t", *BITS).agg(F.count("*").alias("rows")), "items")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, group_id (least doc_id of the group), keep (is the one kept), links (near copies that it has), for documents that have a near copy."""
    items = _items(docs)
    out = grouped(items).drop("t")
    dropped(items)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the documents whose group keeps another; of rows that repeat doc_id and text one stays, the least as JSON.

    Rows of null doc_id stay.
    """
    items = _items(docs)
    a, b = fresh(docs, "a", "b")
    own = [F.col("doc_id").cast("long"), F.xxhash64("text")]

    def among(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        few = some.count() <= BROADCAST_ROWS  # of a written table
        some = some.select(F.col("doc_id").alias(a), F.col("t").alias(b))
        some = F.broadcast(some) if few else some
        return rows.join(some, (own[0] == F.col(a)) & (own[1] == F.col(b)), how)

    left = among(docs, grouped(items).where("not keep"), "left_anti")
    repeated = items.where("rows > 1")
    if repeated.isEmpty():
        return left
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = among(left, repeated, "left_semi").groupBy(own[0].alias(a), own[1].alias(b)).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return among(left, repeated, "left_anti").unionByName(one)
