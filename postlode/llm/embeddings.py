"""Embedding near-duplicates by an exact metric range join.

Pivots partition the vectors: each is at home in the cell of its nearest pivot. A pair u, v within
radius r, u at home with pivot p and v with q, has d(v, p) <= d(u, p) + r <= d(u, q) + r <=
d(v, q) + 2r by the triangle inequality, so v is copied to each cell p with d(v, p) <= d(v, q) + 2r
and d(v, p) <= r + the radius of cell p; in Euclidean space it must also lie within r of the plane
between p and q, which copies fewer. A cell joins its own vectors with each other and with the
copies whose home is a later cell, independently of other cells, and skips blocks whose distances
to the pivot differ by more than r.

A cell of more than CHUNK_BYTES is cut into chunks, and each two chunks meet in a task of their
own, so no task holds a whole cell. A task returns no pairs but, for each of its vectors, the
number of its partners there and one vector of its connected group there: as many rows as it
read, whatever the size of a group. Sums of those are the links, and joined groups the classes.

How many pivots there are (up to MOST_PIVOTS, k-means over a sample of at most SAMPLE vectors) is
chosen by the rows that the tasks would read, estimated on the sample: where distances are all
alike, as between random vectors of many dimensions, no partition prunes, and few large cells copy
least. Pivots decide only what is copied where; the result is exact for any.

Vectors are scaled to length 1; the radius is given as the cosine that it stands for.

Defined cases: null ids, null or empty vectors, and vectors with null, NaN or infinite parts or of
length 0 are left out; vectors of different lengths are never near, and each length is searched on
its own; a row that repeats id and vector counts once, an id with several vectors has a row for each, and
those are items like any others; equal vectors have distance 0; an empty table gives no rows;
columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..ship import ship
from ._shared import Forest, dropped, written
from .simhash import components

COSINE = 0.95
CHUNK_BYTES = 12 << 20
MOST_PIVOTS, SAMPLE = 1024, 8192
BLOCK = 1024
SLACK = 1e-5
SALTS = 32


def radius(cosine: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * cosine))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)))


class Cells:
    """Pivots of the vectors of one length, and the radius of each cell (infinite: not known yet)."""

    def __init__(self, pivots: np.ndarray, r: float):
        self.pivots, self.r = pivots, r
        self.between = np.maximum(_distances(pivots, pivots), 1e-12)
        self.reach = np.full(len(pivots), np.inf)

    def of(self, x: np.ndarray, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distances to all pivots, home, whether each goes to each cell) of vectors."""
        d = _distances(x, self.pivots)
        at = np.arange(len(x))
        home = d.argmin(axis=1)
        near = d[at, home][:, None]
        plane = (d * d - near * near) / (2 * self.between[home])
        goes = (d <= near + 2 * self.r + slack) & (plane <= self.r + slack) & (d <= self.reach + self.r + slack)
        goes &= np.arange(len(self.pivots)) <= home[:, None]  # a pair meets in the earlier of its two cells
        goes[at, home] = True
        return d, home, goes


def _rows_read(own: np.ndarray, guests: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(chunks at home, chunks of guests) of cells, and the rows that all their tasks read."""
    h, g = np.ceil(own / chunk), np.ceil(guests / chunk)
    return h.astype(int), g.astype(int), float((own * (h + g) + guests * h).sum())


def _means(x: np.ndarray, count: int) -> np.ndarray:
    """Centres of k-means, from the first rows of x."""
    c = x[:count].copy()
    for _ in range(4):
        home = _distances(x, c).argmin(axis=1)
        size = np.bincount(home, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return np.unique(c, axis=0)


def planned(sample: np.ndarray, n: int, r: float, chunk: int) -> Cells:
    """The cells for n vectors that cost least, judged by a sample of them; on average at most a chunk is at home in one."""
    best, least = None, math.inf
    most = max(1, min(MOST_PIVOTS, len(sample) // 4))
    count = min(most, math.ceil(n / chunk))
    while count <= most and (best is None or count * chunk <= 64 * n):
        cells = Cells(_means(sample, count), r)
        _, home, goes = cells.of(sample)
        own = np.bincount(home, minlength=len(cells.pivots)) * (n / len(sample))
        cost = _rows_read(own, goes.sum(axis=0) * (n / len(sample)) - own, chunk)[2]
        if cost < 0.9 * least:  # more cells must pay
            best, least = cells, cost
        count *= 2
    return best


def _parts(batches, cells: dict[int, Cells]):
    """(length, batch of that length, its vectors), a few thousand rows at a time."""
    for batch in batches:
        size = np.asarray(batch.column(1).value_lengths())
        for k in np.unique(size):
            rows = batch.filter(pa.array(size == k))
            step = max(64, (1 << 21) // max(int(k), len(cells[int(k)].pivots)))
            for s in range(0, rows.num_rows, step):
                part = rows.slice(s, step)
                yield int(k), part, _matrix(part.column(1))


def _census(cells: dict[int, Cells]):
    """Vectors at home, guests and radius of each cell.

    Guests are at least as many as _assign() sends: radii are not known yet, and a vector whose home
    is a matter of rounding counts as a guest too.
    """

    def run(batches):
        seen: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, _, x in _parts(batches, cells):
            d, home, goes = cells[k].of(x, 2 * SLACK)
            own, guests, reach = seen.setdefault(k, tuple(np.zeros(len(cells[k].pivots)) for _ in range(3)))
            at = np.bincount(home, minlength=len(own))
            near = d[np.arange(len(x)), home]
            own += at
            guests += goes.sum(axis=0) - at + np.bincount(home[(d <= near[:, None] + 2 * SLACK).sum(axis=1) > 1], minlength=len(own))
            np.maximum.at(reach, home, near)
        for k, (own, guests, reach) in seen.items():
            cell = np.arange(len(own), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(own), pa.int32()), pa.array(cell), pa.array(own), pa.array(guests), pa.array(reach)], names=["k", "cell", "own", "guests", "reach"])

    return run


def _assign(cells: dict[int, Cells], chunks: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Rows for the tasks: each two chunks of a cell, of which the first is at home there, are a task."""

    def run(batches):
        for k, part, x in _parts(batches, cells):
            d, home, goes = cells[k].of(x)
            h, g = chunks[k]
            node = part.column(0).to_numpy()
            mixed = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            i, cell = np.nonzero(goes)
            own = home[i] == cell
            mine = (mixed[i] % np.where(own, h[cell], np.maximum(g[cell], 1)).astype(np.uint64)).astype(np.int64)
            # a chunk at home meets itself, the later ones at home, and all of guests; one of guests all at home
            mine = np.where(own, mine, h[cell] + mine)
            other = np.where(own, h[cell] + g[cell], h[cell])
            row = np.repeat(np.arange(len(i)), other)
            o = np.arange(len(row)) - np.repeat(np.cumsum(other) - other, other)
            a, b = np.minimum(mine[row], o), np.maximum(mine[row], o)
            for s in range(0, len(row), 8192):
                z = row[s : s + 8192]
                at = pa.array(i[z])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(z), pa.int32()), pa.array(cell[z].astype(np.int32)), pa.array(a[s : s + 8192]), pa.array(b[s : s + 8192]), pa.array(mine[z] == a[s : s + 8192]), pa.array(d[i[z], cell[z]]), part.column(0).take(at), part.column(2).take(at), part.column(1).take(at)],
                    names=["k", "cell", "a", "b", "left", "far", "node", "weight", "v"],
                )

    return run


def _join(r: float, cosine: float):
    """node, links (partners by weight), root (a node of its group) of the vectors of a task that have partners in it."""

    def run(part: pa.Table) -> pa.Table:
        left = part.column("left").to_numpy()
        far, node, weight, v = part.column("far").to_numpy(), part.column("node").to_numpy(), part.column("weight").to_numpy(), _matrix(part.column("v"))
        order = np.lexsort((far, ~left))
        left, far, node, weight, v = left[order], far[order], node[order], weight[order], v[order]
        n, own = len(node), int(left.sum())
        one = part.column("a")[0].as_py() == part.column("b")[0].as_py()
        links, forest = np.zeros(n, np.int64), Forest(n)
        for a in range(0, own, BLOCK):
            e = min(a + BLOCK, own)
            for b in range(a, own, BLOCK) if one else range(own, n, BLOCK):
                f = min(b + BLOCK, own if one else n)
                if far[b] > far[e - 1] + r + SLACK or far[f - 1] < far[a] - r - SLACK:
                    continue
                i, j = np.nonzero(v[a:e] @ v[b:f].T >= cosine)
                if one and a == b:
                    up = i < j
                    i, j = i[up], j[up]
                if len(i):
                    i, j = i + a, j + b
                    links += np.bincount(i, weight[j], n).astype(np.int64) + np.bincount(j, weight[i], n).astype(np.int64)
                    forest.add(i, j)
        some = links > 0
        return pa.table({"node": node[some], "links": links[some], "root": node[forest.root[some]]})

    return run


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector scaled to length 1, of usable rows, repeated rows once."""
    good = vectors.where("vec_id is not null and size(embedding) > 0").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    good = good.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    # parts are brought below 1 first where their squares would overflow or vanish
    most = F.array_max(F.transform("e", lambda x: F.abs(x)))
    scale = F.when((F.col("m") > 1e100) | (F.col("m") < 1e-100), F.col("m")).otherwise(1.0)
    good = good.select("id", "e", most.alias("m")).where("m > 0").select("id", F.transform("e", lambda x: x / scale).alias("e"))
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    unit = good.select("id", "e", length.alias("w")).select("id", F.transform("e", lambda x: x / F.col("w")).alias("v"))
    return unit.dropDuplicates()


def _key(v: Column) -> list[Column]:
    """128 bits that stand for a vector."""
    return [F.xxhash64(v).alias("h"), F.xxhash64(F.reverse(v), F.lit(7)).alias("g")]


def classes(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, class_id, links of every usable vector.

    links: how many other items have at least that cosine with it. class_id: the least vec_id that
    is reached from it over links.
    """
    spark = ship(vectors.sparkSession)
    unit = written(unit_vectors(vectors).select("id", "v", *_key(F.col("v"))), "vectors")
    # equal vectors are one node; salted, as one vector may be a third of all
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")
    some = unit.groupBy("h", "g", salt).agg(F.count("*").alias("c"), F.min("id").alias("least"), F.first("v").alias("v"))
    nodes = some.groupBy("h", "g").agg(F.sum("c").alias("weight"), F.min("least").alias("least"), F.first("v").alias("v"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "h", "g", "weight", "least", "v"), "nodes")
    sizes = nodes.groupBy(F.size("v").alias("k")).count().collect()  # a row a vector length
    if not sizes:
        return spark.createDataFrame([], "vec_id long, class_id long, links long")
    n = {r["k"]: r["count"] for r in sizes}
    r = radius(cosine)
    chunk = {k: max(1, CHUNK_BYTES // (8 * k)) for k in n}
    # a sample for each length: enough for its pivots, and no more than SAMPLE in all but one each
    share = max(1, SAMPLE // len(n))
    k = F.size("v").alias("k")
    numbered = nodes.select(k, "v", F.row_number().over(W.partitionBy(k).orderBy(F.xxhash64("node"), "node")).alias("i"))
    samples: dict[int, list] = {}
    for row in numbered.where(F.col("i") <= share).orderBy("k", "i").select("k", "v").toArrow().to_batches():
        size = row.column(0).to_numpy()
        for length in np.unique(size):
            samples.setdefault(int(length), []).append(_matrix(row.column(1).filter(pa.array(size == length))))
    cells = {length: planned(np.concatenate(x), n[length], r, chunk[length]) for length, x in samples.items()}
    narrow = nodes.select("node", "v", "weight")
    census = narrow.mapInArrow(_census(cells), "k int, cell int, own double, guests double, reach double")
    chunks = {length: (np.ones(len(c.pivots), int), np.ones(len(c.pivots), int)) for length, c in cells.items()}
    # a row a cell
    for x in census.groupBy("k", "cell").agg(F.sum("own").alias("own"), F.sum("guests").alias("guests"), F.max("reach").alias("reach")).collect():
        h, g, _ = _rows_read(np.array([x["own"]]), np.array([x["guests"]]), chunk[x["k"]])
        chunks[x["k"]][0][x["cell"]], chunks[x["k"]][1][x["cell"]] = max(1, h[0]), g[0]
        cells[x["k"]].reach[x["cell"]] = x["reach"]
    tasks = narrow.mapInArrow(_assign(cells, chunks), "k int, cell int, a long, b long, left boolean, far double, node long, weight long, v array<double>")
    met = written(tasks.groupBy("k", "cell", "a", "b").applyInArrow(_join(r, cosine), "node long, links long, root long"), "met")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(met.select(F.col("node").alias("x"), F.col("root").alias("y")))
    grouped = nodes.drop("v").join(groups.withColumnRenamed("id", "node"), "node", "left").join(links, "node", "left")
    grouped = grouped.select("node", "h", "g", "weight", "least", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    classes_ = grouped.groupBy("root").agg(F.min("least").alias("class_id"))
    known = grouped.join(classes_, "root").select("h", "g", "class_id", (F.col("links") + F.col("weight") - 1).alias("links"))
    # each node meets its ids once a salt, as in the count above
    spread = some.select("h", "g", "salt").join(known, ["h", "g"])
    out = written(unit.select("id", "h", "g", salt).join(spread, ["h", "g", "salt"]).select(F.col("id").alias("vec_id"), "class_id", "links"), "classes")
    for t in (unit, nodes, met):
        dropped(t)
    return out


SQL = """
WITH RECURSIVE u AS (
  SELECT row_number() OVER (ORDER BY vec_id, v) AS k, vec_id, v FROM (
    SELECT DISTINCT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0)),
near AS MATERIALIZED (SELECT a.k AS x, b.k AS y FROM u a JOIN u b ON a.k <> b.k AND list_dot_product(a.v, b.v) >= 0.95),
reached AS (SELECT k AS x, k AS y FROM u UNION SELECT r.x, n.y FROM reached r JOIN near n ON r.y = n.x),
class AS (SELECT r.x, min(u.vec_id) AS class_id FROM reached r JOIN u ON u.k = r.y GROUP BY r.x),
degree AS (SELECT x, count(*) AS links FROM near GROUP BY x)
SELECT u.vec_id, class.class_id, CAST(coalesce(degree.links, 0) AS BIGINT) AS links
FROM u JOIN class ON class.x = u.k LEFT JOIN degree ON degree.x = u.k
"""
