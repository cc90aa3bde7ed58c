"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads windows of WINDOW bytes in both directions, labels every byte position, and a
document's probabilities are the means of its positions' probabilities over the whole text (and
PRIOR positions of even odds, so that a few bytes decide little). A document is rejected where the
best language exceeds the one that it claims by more than MARGIN.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled
windows: ``train_windows`` for each language, those of least hash among all different windows of
all labelled texts, whatever their lengths; half of them are cut to lengths down to 3 bytes, as
texts may be short, and batches hold all languages alike. The sample takes one scan to count
windows by language and one to pick them (another only for a language whose windows mostly
repeat), however many languages there are.

Defined cases: a null or empty text has no positions, so its language is null and it is rejected;
a document whose ``lang`` is null is kept if the best language's probability is at least CERTAIN;
one whose ``lang`` is only on empty texts is of an unknown language; a table without labelled text
rejects all documents; an empty table gives no rows; rows that repeat are judged alike; other
columns are passed on and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from . import _text
from ._shared import fresh

WINDOW, HIDDEN, EMBED = 128, 12, 8
MARGIN, CERTAIN = 0.2, 0.5
PRIOR = 8
BATCH_BYTES = 384 << 10
TRAIN_WINDOWS = 1440


class BiGRU:
    """Parameters by name; columns of every matrix are windows: (features, windows)."""

    def __init__(self, labels: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels = labels
        w = lambda *s: (r.standard_normal(s) / np.sqrt(s[-1])).astype(np.float32)
        self.p = {"emb": (r.standard_normal((EMBED, 257)) * 0.5).astype(np.float32), "out": w(len(labels), 2 * HIDDEN + 1)}
        for d in "fb":
            self.p[f"gate_{d}"] = w(2 * HIDDEN, EMBED + HIDDEN + 1)
            self.p[f"cand_{d}"] = w(HIDDEN, EMBED + HIDDEN + 1)

    def _direction(self, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (time, HIDDEN, windows) of direction d over bytes x (time, windows); 0 at padding, so that it has no say."""
        steps, n = x.shape
        real = x < 256
        whole = real.all(axis=1)
        gate, cand, emb = self.p[f"gate_{d}"], self.p[f"cand_{d}"], self.p["emb"]
        half = gate * np.float32(0.5)  # sigmoid(a) = (tanh(a / 2) + 1) / 2
        hs, saved = np.empty((steps, HIDDEN, n), np.float32), []
        u = np.ones((EMBED + HIDDEN + 1, n), np.float32)
        h = np.zeros((HIDDEN, n), np.float32)
        a, c, t = np.empty((2 * HIDDEN, n), np.float32), np.empty((HIDDEN, n), np.float32), np.empty((HIDDEN, n), np.float32)
        for s in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(emb, x[s], axis=1, out=u[:EMBED], mode="clip")
            u[EMBED:-1] = h
            np.matmul(half, u, out=a)
            np.tanh(a, out=a)
            a += 1
            a *= 0.5
            z, r = a[:HIDDEN], a[HIDDEN:]
            if keep:
                u1, before = u.copy(), h.copy()
            np.multiply(r, h, out=u[EMBED:-1])
            np.matmul(cand, u, out=c)
            np.tanh(c, out=c)
            if keep:
                saved.append((s, u1, u.copy(), before, a.copy(), c.copy()))
            np.subtract(c, h, out=t)
            t *= z
            h = np.add(h, t, out=hs[s])
            if not whole[s]:
                h *= real[s]
        return hs, saved

    def forward(self, x: np.ndarray, keep: bool = False):
        """Probabilities (time, labels, windows) at every position; with keep, what backward() needs too."""
        (hf, sf), (hb, sb) = self._direction("f", x, keep), self._direction("b", x, keep)
        out = self.p["out"]
        y = np.matmul(out[:, :HIDDEN], hf)
        y += np.matmul(out[:, HIDDEN:-1], hb)
        y += out[:, -1:]
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        return (y, hf, hb, sf, sb) if keep else y

    def _back(self, d: str, x: np.ndarray, saved: list, dh_at: np.ndarray, g: dict) -> None:
        gate, cand = self.p[f"gate_{d}"], self.p[f"cand_{d}"]
        dh = np.zeros_like(dh_at[0])
        for s, u1, u2, h, a, c in reversed(saved):
            dh = (dh + dh_at[s]) * (x[s] < 256)
            z, r = a[:HIDDEN], a[HIDDEN:]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h) * z * (1 - z)
            g[f"cand_{d}"] += dc @ u2.T
            du2 = cand.T @ dc
            drh = du2[EMBED:-1]
            da = np.concatenate([dz, drh * h * r * (1 - r)])
            g[f"gate_{d}"] += da @ u1.T
            du1 = gate.T @ da
            np.add.at(g["emb"].T, x[s], (du1[:EMBED] + du2[:EMBED]).T)
            dh = dh * (1 - z) + drh * r + du1[EMBED:-1]

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, and its gradients by backpropagation through time."""
        y, hf, hb, sf, sb = self.forward(x, keep=True)
        steps, n = x.shape
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        real = (x < 256).astype(np.float32)
        total = real.sum()
        loss = float(-(np.log(y[:, label, np.arange(n)] + 1e-9) * real).sum() / total)
        dy = y.copy()
        dy[:, label, np.arange(n)] -= 1
        dy *= real[:, None] / total
        out = self.p["out"]
        g["out"][:, :HIDDEN] = np.einsum("tln,thn->lh", dy, hf, optimize=True)
        g["out"][:, HIDDEN:-1] = np.einsum("tln,thn->lh", dy, hb, optimize=True)
        g["out"][:, -1] = dy.sum(axis=(0, 2))
        self._back("f", x, sf, np.matmul(out[:, :HIDDEN].T, dy), g)
        self._back("b", x, sb, np.matmul(out[:, HIDDEN:-1].T, dy), g)
        return loss, g

    def fit(self, x: np.ndarray, label: np.ndarray, steps: int, batch: int = 192, rate: float = 0.012, seed: int = 3) -> float:
        """Adam over random batches of windows (columns of x); returns the last loss."""
        r, loss = np.random.default_rng(seed), 0.0
        share = 1.0 / np.bincount(label)[label]
        share /= share.sum()  # languages alike, whatever their numbers of windows
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for i in range(1, steps + 1):
            pick = r.choice(x.shape[1], batch, p=share)
            loss, g = self.gradients(x[:, pick], label[pick])
            norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
            lr = rate * min(1.0, 2 * (steps - i + 1) / steps)
            for k, w in g.items():
                w *= min(1.0, 1.0 / (norm + 1e-9))
                m[k] += 0.1 * (w - m[k])
                v[k] += 0.01 * (w * w - v[k])
                self.p[k] -= (lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-7)).astype(np.float32)
        return loss

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """(texts, labels): each text's mean over all its positions; NaN for an empty text."""
        out = np.full((len(texts), len(self.labels)), np.nan)
        for a, b in _text.slices(texts, BATCH_BYTES):
            data, offsets = _text.raw(texts.slice(a, b - a))
            if not len(data):
                continue
            total = np.zeros((b - a, len(self.labels)))
            n_win = (np.diff(offsets) + WINDOW - 1) // WINDOW
            row = np.repeat(np.arange(b - a), n_win)
            start = offsets[row] + WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(n_win) - n_win, n_win))
            stop = np.minimum(start + WINDOW, offsets[row + 1])
            most = max(1, BATCH_BYTES // WINDOW)
            for k in range(0, len(row), most):
                s, e, w = start[k : k + most], stop[k : k + most], row[k : k + most]
                at = s + np.arange(WINDOW)[:, None]
                inside = at < e
                x = np.where(inside, data[np.minimum(at, len(data) - 1)].astype(np.int16), np.int16(256))
                y = self.forward(x)
                pooled = np.einsum("tln,tn->nl", y, inside.astype(np.float32))
                np.add.at(total, w, pooled)
            size = np.diff(offsets)
            some = size > 0
            out[a:b][some] = (total[some] + PRIOR / len(self.labels)) / (size[some, None] + PRIOR)
        return out


def windows(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, text, start, end) of the windows of whole texts, with starts and ends in raw(texts)'s bytes; some MB at a time."""
    data, offsets = _text.raw(texts)
    size = np.diff(offsets)
    count = (size + WINDOW - 1) // WINDOW
    row = np.repeat(np.arange(len(size)), count)
    start = offsets[row] + WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    end = np.minimum(start + WINDOW, offsets[row + 1])
    step = (1 << 20) // WINDOW
    for k in range(0, len(row), step):
        s, e, w = start[k : k + step], end[k : k + step], row[k : k + step]
        part = data[s[0] : e[-1]]
        yield _text.spans(part, s - s[0], e - s[0]), w, s, e


def _picked(edges: dict[str, int]):
    """lang, h, w: the different windows whose hashes are at most their language's edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(list(edges), pa.string())
        most = np.array([*edges.values(), -(2**63)], np.int64)
        for batch in batches:
            texts, langs = _text.as_strings(batch.column(1)), batch.column(0)
            at = pc.fill_null(pc.index_in(langs, names), len(edges)).to_numpy(zero_copy_only=False)
            data, _ = _text.raw(texts)
            for h, row, start, end in windows(texts):
                h = h.view(np.int64)
                some = np.flatnonzero(h <= most[at[row]])
                some = some[np.unique(h[some], return_index=True)[1]]  # one text is in one language, and so are its windows
                cut = [data[s:e].tobytes() for s, e in zip(start[some], end[some], strict=True)]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(row[some])), pa.array(h[some]), pa.array(cut, pa.binary())], names=["lang", "h", "w"])

    return run


def training_windows(docs: DataFrame, most: int = TRAIN_WINDOWS) -> dict[str, list[bytes]]:
    """Windows by language: up to ``most`` different ones of each, least hash first. Only they reach the driver."""
    ship(docs.sparkSession)
    labelled = docs.where("lang is not null and text <> ''").select(F.col("lang").cast("string").alias("lang"), "text")
    size = F.ceil(F.octet_length("text") / WINDOW)
    count = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.sum(size).alias("n")).collect()}  # a row a language
    chosen: dict[str, list[bytes]] = {}
    share = {k: (4 * most + 200) / n for k, n in count.items()}
    while share:
        edges = {k: min(2**63 - 1, int(-(2**63) + v * 2**64)) for k, v in share.items()}
        rows = labelled.where(F.col("lang").isin(list(edges))) if len(edges) < len(count) else labelled
        some = rows.mapInArrow(_text.released(_picked(edges)), "lang string, h long, w binary").dropDuplicates(["lang", "h"])
        first = F.row_number().over(W.partitionBy("lang").orderBy("h"))
        found: dict[str, list[bytes]] = {k: [] for k in edges}
        for r in some.withColumn("i", first).where(F.col("i") <= most).orderBy("lang", "h").select("lang", "w").collect():
            found[r["lang"]].append(bytes(r["w"]))
        # a language whose windows repeat has fewer different ones below its edge
        short = {k for k in found if len(found[k]) < most and share[k] < 1}
        chosen |= {k: v for k, v in found.items() if k not in short}
        share = {k: 64 * share[k] for k in short}
    return {k: chosen[k] for k in sorted(chosen)}


def _columns(cut: list[bytes], seed: int = 1) -> np.ndarray:
    """(WINDOW, windows); every other one is cut, for short texts."""
    r = np.random.default_rng(seed)
    x = np.full((WINDOW, len(cut)), 256)
    for i, w in enumerate(cut):
        part = np.frombuffer(w, np.uint8)[: int(3 * (WINDOW / 3) ** r.random()) if i % 2 else WINDOW]
        x[: len(part), i] = part
    return x


def train(docs: DataFrame, train_windows: int = TRAIN_WINDOWS, steps: int = 360) -> BiGRU | None:
    """A network for the languages in docs; None if nothing is labelled."""
    rows = training_windows(docs, train_windows)
    if not rows:
        return None
    net = BiGRU(list(rows))
    xs = [_columns(w) for w in rows.values()]
    net.fit(np.concatenate(xs, axis=1), np.repeat(np.arange(len(xs)), [x.shape[1] for x in xs]), steps)
    return net


SCORE = T.StructType([T.StructField(n, k) for n, k in (("language", T.StringType()), ("probability", T.DoubleType()), ("claimed", T.DoubleType()))])


def scorer(net: BiGRU):
    """Column function: text, lang -> (language, its probability, that of lang), null for an empty text.

    ``claimed`` is 0 for a lang that the network doesn't know, and null for null.
    """
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        names = np.array(net.labels, object)
        for texts, langs in batches:
            p = net.probabilities(_text.as_strings(texts))
            blank = np.isnan(p[:, 0])
            best = np.where(blank, 0, np.nan_to_num(p).argmax(axis=1))
            at = pc.index_in(langs, pa.array(net.labels, langs.type))
            none = blank | at.is_null().to_numpy(zero_copy_only=False) & langs.is_null().to_numpy(zero_copy_only=False)
            at = pc.fill_null(at, len(names)).to_numpy(zero_copy_only=False)
            claimed = np.concatenate([p, np.zeros((len(p), 1))], axis=1)[np.arange(len(p)), at]
            yield pa.StructArray.from_arrays(
                [pa.array(names[best], pa.string(), mask=blank), pa.array(p[np.arange(len(p)), best], pa.float64(), mask=blank), pa.array(claimed, pa.float64(), mask=none)],
                names=SCORE.fieldNames(),
            )

    return F.arrow_udf(_text.released(score), SCORE).asNondeterministic()  # evaluated once, below the filter


def identified(docs: DataFrame, net: BiGRU | None = None) -> DataFrame:
    """doc_id, lang, language, probability, claimed (probability of lang) of every document."""
    ship(docs.sparkSession)
    net = net or train(docs)
    narrow = docs.select("doc_id", "lang", "text")
    score = scorer(net)("text", "lang") if net else F.lit(None).cast(SCORE)
    return narrow.select("doc_id", "lang", score.alias("s")).select("doc_id", "lang", "s.*")


def _accepted(score: Column, margin: float) -> Column:
    return F.coalesce(score["claimed"] >= score["probability"] - margin, score["probability"] >= CERTAIN, F.lit(False))


def accepted(docs: DataFrame, margin: float = MARGIN, net: BiGRU | None = None) -> DataFrame:
    """identified() for the documents kept: where a language is claimed, no other exceeds it by more than ``margin``; else the best reaches CERTAIN."""
    i = identified(docs, net)
    return i.where(_accepted(F.struct("probability", "claimed"), margin))


def filtered(docs: DataFrame, margin: float = MARGIN, net: BiGRU | None = None) -> DataFrame:
    """The documents kept, with all their columns."""
    ship(docs.sparkSession)
    net = net or train(docs)
    if net is None:
        return docs.where(F.lit(False))
    (name,) = fresh(docs, "score")
    scored = docs.select("*", scorer(net)("text", "lang").alias(name))
    return scored.where(_accepted(F.col(name), margin)).drop(name)
