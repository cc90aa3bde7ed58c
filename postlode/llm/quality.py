"""Quality classifier learned from positive and unlabelled documents.

Trusted positives are documents that ``labels`` calls good (quality 1, toxic 0); all others are
unlabelled web text. A linear model over character-class statistics minimises the non-negative
unbiased PU risk  pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1))  with the sigmoid loss; the class
prior pi is estimated from the two samples (best bin: least ratio of the unlabelled to the
positive share above a score, with a confidence margin). It is fitted on bounded samples of
different texts (``positives``, ``unlabelled``: documented limits, least hash of the text first; a
text is positive if any of its documents is). Their features, not their texts, come to the driver;
every document is scored over its whole text.

Defined cases: a null or empty text has no score and is rejected; without trusted positives, or
without unlabelled text, nothing can be learned and every non-empty document is kept with a null
score; one text counts once in a sample, however many documents hold it; rows that repeat are judged alike; an empty table gives no rows; labels with null or
unknown ids are ignored; other columns are passed on and never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from . import _text
from ._shared import dropped, fresh, written

CLASSES = 16
FEATURES = CLASSES * CLASSES + 12
SLACK = 2.0


def _classes() -> np.ndarray:
    t = np.full(256, 15, np.uint8)  # other bytes
    t[97:123] = 0
    for c in b"aeiou":
        t[c] = 1
    t[65:91] = 2
    t[48:58] = 3
    t[32], t[10], t[9] = 4, 5, 4
    for k, group in enumerate((b".", b",;:", b"!?", b"'\"", b"|", b"#$%&*@^~", b"-_/\\=+", b"()[]{}<>"), 6):
        for c in group:
            t[c] = k
    t[128:192], t[192:] = 14, 14
    return t


_CLASS = _classes()


def features(texts: pa.Array) -> np.ndarray:
    """(texts, FEATURES) float32; zero for an empty text."""
    n = len(texts)
    out = np.zeros((n, FEATURES), np.float32)
    for a, b in _text.slices(texts):
        part = texts.slice(a, b - a)
        data, offsets = _text.raw(part)
        if not len(data):
            continue
        size = np.diff(offsets)
        row = np.repeat(np.arange(b - a, dtype=np.int32), size)
        pair, one = np.zeros((b - a) * CLASSES * CLASSES, np.int64), np.zeros((b - a) * CLASSES, np.int64)
        for s in range(0, len(data), _text.BLOCK):
            r, c = row[s : s + _text.BLOCK + 1], _CLASS[data[s : s + _text.BLOCK + 1]]
            code = (r[:-1].astype(np.int64) * CLASSES + c[:-1]) * CLASSES + c[1:]
            pair += np.bincount(code[r[1:] == r[:-1]], minlength=len(pair))
            r, c = r[: _text.BLOCK], c[: _text.BLOCK]
            one += np.bincount(r.astype(np.int64) * CLASSES + c, minlength=len(one))
        x = out[a:b]
        x[:, : CLASSES * CLASSES] = np.sqrt(pair.reshape(b - a, -1) / np.maximum(size - 1, 1)[:, None])
        one = one.reshape(b - a, -1) / np.maximum(size, 1)[:, None]
        h, wrow, length = _text.words(part)
        words = np.bincount(wrow, minlength=b - a)
        own = np.unique(_text.mix(h ^ _text.mix(wrow.astype(np.uint64), 5)), return_index=True)[1]
        kinds = np.bincount(wrow[own], minlength=b - a)
        lh, lrow = _lines(data, offsets, row)
        lines = np.bincount(lrow, minlength=b - a)
        lkinds = np.bincount(lrow[np.unique(_text.mix(lh ^ _text.mix(lrow.astype(np.uint64), 6)), return_index=True)[1]], minlength=b - a)
        k = CLASSES * CLASSES
        x[:, k] = np.log1p(words) / 10
        x[:, k + 1] = np.bincount(wrow, length, b - a) / np.maximum(words, 1) / 10
        x[:, k + 2] = kinds / np.sqrt(np.maximum(words, 1)) / 20
        x[:, k + 3] = 1 - kinds / np.maximum(words, 1)
        x[:, k + 4] = 1 - lkinds / np.maximum(lines, 1)
        x[:, k + 5] = one[:, 11]
        x[:, k + 6] = one[:, 2]
        x[:, k + 7] = one[:, 3]
        x[:, k + 8] = one[:, 10]
        x[:, k + 9] = one[:, 8]
        x[:, k + 10] = one[:, 0] + one[:, 1] + one[:, 14]
        x[:, k + 11] = one[:, 4]
        x[size == 0] = 0
    return out


def _lines(data: np.ndarray, offsets: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each non-empty line."""
    edges, out = offsets[offsets < len(data)], []
    for a, b in _text.blocks(data != 10):
        cut = a + np.flatnonzero(data[a:b] == 10)
        starts = np.unique(np.concatenate([[a], edges[np.searchsorted(edges, a) : np.searchsorted(edges, b)], cut + 1]))
        starts = starts[starts < b]
        ends = np.append(cut, b)[np.searchsorted(cut, starts)]
        ends = np.minimum(ends, offsets[row[starts] + 1])
        some = ends > starts
        starts, ends = starts[some], ends[some]
        out.append((_text.spans(data[a:b], starts - a, ends - a), row[starts].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class PU:
    """Scaled linear model: score(x) > 0 means good."""

    def __init__(self, mean, scale, weights, bias, prior, edge):
        self.mean, self.scale, self.weights, self.bias, self.prior, self.edge = mean, scale, weights, bias, prior, edge

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Best-bin estimate of the share of positives in the unlabelled, from scores of held-out samples."""
    p, u = np.sort(positive)[::-1], np.sort(unlabelled)[::-1]
    margin = np.sqrt(np.log(4 / delta) / (2 * len(u))) + np.sqrt(np.log(4 / delta) / (2 * len(p)))
    at = np.arange(max(1, len(p) // 20), len(p) + 1)
    qp = at / len(p)
    qu = np.searchsorted(-u, -p[at - 1], "right") / len(u)
    best = np.argmin((qu + margin) / qp)
    return float(np.clip(qu[best] / qp[best], 0.05, 0.99))


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * v))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk of positives as such, risk of negatives) with the sigmoid loss; the non-negative risk is a + max(0, b)."""
    sp, su = _sigmoid(p @ w[:-1] + w[-1]), _sigmoid(u @ w[:-1] + w[-1])
    return float(prior * (1 - sp).mean()), float(su.mean() - prior * sp.mean())


def gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float | None) -> np.ndarray:
    """Of a + b of risk(); where b is below zero, of -b: a step back from it. Without a prior: of the logistic loss of p against u."""
    sp, su = _sigmoid(p @ w[:-1] + w[-1]), _sigmoid(u @ w[:-1] + w[-1])
    if prior is None:
        gp, gu = (sp - 1) / len(p), su / len(u)
    else:
        # l(+1) = 1 - s, l(-1) = s; the derivative of s in the margin is s (1 - s)
        dp, du = sp * (1 - sp) / len(p), su * (1 - su) / len(u)
        gp, gu = (-2 * prior * dp, du) if su.mean() >= prior * sp.mean() else (prior * dp, -du)
    return np.append(gp @ p + gu @ u, gp.sum() + gu.sum())


def _descend(xp, xu, prior, steps, rate, seed, l2=1e-4):
    """Minimises the nnPU risk (or, with prior None, plain positive against unlabelled) by Adam on mini-batches."""
    r = np.random.default_rng(seed)
    w = np.zeros(xp.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, steps + 1):
        p = xp[r.integers(0, len(xp), min(256, len(xp)))]
        u = xu[r.integers(0, len(xu), min(512, len(xu)))]
        g = gradient(w, p, u, prior)
        g[:-1] += l2 * w[:-1]
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w -= rate * min(1.0, 2 * (steps - i + 1) / steps) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
    return w


def fit(xp: np.ndarray, xu: np.ndarray, steps: int = 1500, keep: float = 0.995, seed: int = 5) -> PU:
    """The model, its class prior, and the score that a share ``keep`` of held-out positives reaches (from -SLACK to 0)."""
    both = np.concatenate([xp, xu])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    zp, zu = (np.clip((x - mean) / scale, -6, 6) for x in (xp, xu))
    hp, hu = np.arange(len(zp)) % 4 == 0, np.arange(len(zu)) % 4 == 0
    if hp.all() or hu.all():
        hp[:], hu[:] = False, False
    tp, tu = zp[~hp], zu[~hu]
    vp, vu = (zp[hp], zu[hu]) if hp.any() else (zp, zu)
    w = _descend(tp, tu, None, steps // 2, 0.01, seed)
    prior = class_prior(vp @ w[:-1] + w[-1], vu @ w[:-1] + w[-1])
    w = _descend(tp, tu, prior, steps, 0.01, seed)
    edge = float(np.clip(np.quantile(vp @ w[:-1] + w[-1], 1 - keep), -SLACK, 0.0))
    return PU(mean, scale, w[:-1], w[-1], prior, edge)


def sampled(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of the positive and of the unlabelled sample."""
    spark = ship(docs.sparkSession)
    rows = docs.where("doc_id is not null and length(text) > 0").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"), "text")
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good")).distinct()
    known = rows.select("id", "t").join(good, F.col("id") == F.col("good"), "left")
    texts = written(known.groupBy("t").agg(F.max(F.col("good").isNotNull()).alias("positive")), "texts")
    h = F.xxhash64("t", F.lit(29))
    some = [texts.where("positive" if p else "not positive").orderBy(h, "t").limit(most) for p, most in ((True, positives), (False, unlabelled))]
    chosen = some[0].unionByName(some[1]).toArrow().to_pylist()  # at most positives + unlabelled hashes
    dropped(texts)
    if not chosen:
        return np.zeros((0, FEATURES), np.float32), np.zeros((0, FEATURES), np.float32)
    small = spark.createDataFrame([(x["t"], x["positive"]) for x in chosen], "c long, positive boolean")
    picked = rows.join(F.broadcast(small), F.col("t") == F.col("c")).select("t", "positive", "text")
    measured = picked.select("t", "positive", F.arrow_udf(_vectors, "array<float>")("text").alias("x"))
    got = measured.groupBy("t").agg(F.first("positive").alias("positive"), F.first("x").alias("x")).orderBy(h, "t").select("positive", "x").toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, FEATURES)
    p = got.column("positive").to_numpy()
    return x[p], x[~p]


def _vectors(texts: pa.Array) -> pa.Array:
    x = features(_text.as_strings(texts))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel()))


def train(docs: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 6000) -> PU | None:
    """A model from at most so many positive and unlabelled texts; None where either is missing."""
    xp, xu = sampled(docs, labels, positives, unlabelled)
    return fit(xp, xu) if len(xp) and len(xu) else None


def scorer(model: PU):
    """Column function: text -> score, null for a null or empty text. Not of batches' iterators, which no other function joins in a worker."""

    def score(texts: pa.Array) -> pa.Array:
        texts = _text.as_strings(texts)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        out = pa.array(model.score(features(texts)), pa.float64(), mask=empty)
        _text.release()
        return out

    return F.arrow_udf(score, "double")


def _once(model: PU):
    """scorer() that a filter on it doesn't evaluate again."""
    return scorer(model).asNondeterministic()


def weight(model: PU | None):
    """Column function: text -> the score between 0 and 1, 0 for an empty text; 1 without a model."""
    if model is None:
        return lambda text: F.lit(1.0)
    score = scorer(model)
    return lambda text: F.coalesce(1 / (1 + F.exp(-score(text))), F.lit(0.0))


def _kept(score: Column, model: PU | None, text: Column) -> Column:
    return F.coalesce(score >= model.edge, F.lit(False)) if model else F.coalesce(F.length(text) > 0, F.lit(False))


def accepted(docs: DataFrame, labels: DataFrame, model: PU | None = None) -> DataFrame:
    """doc_id and score of the documents kept."""
    ship(docs.sparkSession)
    model = model or train(docs, labels)
    if model is None:
        return docs.where(_kept(None, None, F.col("text"))).select("doc_id", F.lit(None).cast("double").alias("score"))
    scored = docs.select("doc_id", _once(model)("text").alias("score"))
    return scored.where(_kept(F.col("score"), model, None))


def filtered(docs: DataFrame, labels: DataFrame, model: PU | None = None) -> DataFrame:
    """The documents kept, with all their columns."""
    ship(docs.sparkSession)
    model = model or train(docs, labels)
    if model is None:
        return docs.where(_kept(None, None, F.col("text")))
    (name,) = fresh(docs, "score")
    scored = docs.select("*", _once(model)("text").alias(name))
    return scored.where(_kept(F.col(name), model, None)).drop(name)
