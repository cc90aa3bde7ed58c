"""Perplexity rules: a modified Kneser-Ney model of byte n-grams for each language.

Spark counts the n-grams of order ORDER of every text; continuation counts, discounts and
interpolated probabilities of all orders follow by aggregations and joins over that table, so
what is gathered grows with the input. The model is kept as sorted hash arrays: for each language
the hashes of its n-grams in order, with log-probabilities and back-off weights beside them and
an index of the leading hash bits.

Texts fall into two halves by a hash, each language has a model of either, and a text is scored
under that of the other half, so no text is predicted from its own n-grams or those of its exact
copies. A document's perplexity is that of all its bytes and an end mark; each language has a band
of log-perplexities, fences beyond the quartiles of its different texts, outside of which (above or
below) documents are rejected; a text of n bytes has SLACK / sqrt(n) besides.

A model of up to BROADCAST_ENTRIES entries is sent to the workers as arrays, which back off as they
look up. For a larger one the same probabilities, back-off included, are joined level by level to
the distinct n-grams of the documents, and those to the documents' own counts.

Symbols are the bytes of the text in lower case; digits are alike, white space and control
characters are one space and collapse. Texts start after ORDER - 1 start marks, which count as
bytes of a context.

Defined cases: a null or empty text has no perplexity and is rejected; a null language is a
language of its own; a language without text in the other half has the even perplexity 256; a band
is never narrower than FLOOR on either side, so that few or equal documents are all kept; rows
that repeat count as often as they occur; an empty table gives no rows; columns other than doc_id,
lang and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..ship import ship
from . import _text
from ._shared import dropped, written

ORDER, BITS = 5, 8
FENCE, FLOOR, SLACK = 2.5, 0.08, 3.0
BROADCAST_ENTRIES = 6_000_000
UNKNOWN = 1.0 / 256
MOST_HELD = 3_000_000
PORTION = 1 << 20

_START, _END, _SPACE = 2, 3, 32
_MASK = [(1 << (BITS * k)) - 1 for k in range(ORDER + 1)]


def _classes() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[:33] = _SPACE
    t[127] = _SPACE
    t[48:58] = 48
    return t


_CLASS = _classes()


def ngrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(packed n-gram ending at each byte and at the end mark, text's number), PORTION at a time; texts are in lower case."""
    data, offsets = _text.raw(texts)
    n, pad = len(texts), ORDER - 1
    c = np.full(len(data) + n * ORDER, _START, np.uint8)
    size = np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int32), size)
    c[np.arange(len(data)) + row * ORDER + pad] = _CLASS[data]
    c[offsets[1:] + np.arange(n) * ORDER + pad] = _END
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != _SPACE) | (c[:-1] != _SPACE)
    c = c[keep]
    before = 0  # texts that ended before
    for s in range(0, len(c), PORTION):
        part = c[max(0, s - pad) : s + PORTION].astype(np.int64)
        lead = s - max(0, s - pad)
        key = part[lead:].copy()
        for k in range(1, ORDER):
            # the first bytes of all are start marks, which end no n-gram
            earlier = part[lead - k : len(part) - k] if lead >= k else np.concatenate([np.full(k - lead, _START), part[: len(part) - k]])
            key |= earlier << (BITS * k)
        own = part[lead:]
        real = own != _START
        end = own == _END
        number = before + np.cumsum(end) - end
        before += int(end.sum())
        yield key[real], number[real]


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _group(lang: Column, text: Column) -> Column:
    """The half of a text and its language: "0=en"; "1-" for null."""
    half = F.pmod(F.xxhash64(text), F.lit(2)).cast("string")
    return F.concat(half, F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit("-")))


def other(group: str) -> str:
    """The group by which the texts of a group are judged."""
    return ("1" if group[0] == "0" else "0") + group[1:]


def _by_group(groups: pa.Array, texts: pa.Array, a: int, b: int) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """(group, its non-empty texts of rows a to b in lower case, their rows)."""
    groups, texts = groups.slice(a, b - a), texts.slice(a, b - a)
    some = pc.greater(pc.binary_length(texts), 0)
    for group in groups.unique().to_pylist():
        rows = np.flatnonzero(pc.and_(pc.equal(groups, group), some).to_numpy(zero_copy_only=False))
        if len(rows):
            yield group, pc.utf8_lower(texts.take(pa.array(rows))), rows + a


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each n-gram over what a task reads, handed on when MOST_HELD entries are held."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def out():
        for lang, parts in held.items():
            k, n = _merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            for s in range(0, len(k), 1 << 16):
                e = k[s : s + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(e), pa.string()), pa.array(e), pa.array(n[s : s + (1 << 16)])], names=["lang", "key", "n"])

    for batch in batches:
        texts = _text.as_strings(batch.column(1))
        for a, b in _text.slices(texts):
            for lang, part, _ in _by_group(batch.column(0), texts, a, b):
                for key, _ in ngrams(part):
                    key = np.sort(key)
                    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                    held.setdefault(lang, []).append((key[first], np.diff(np.append(first, len(key)))))
                    size += len(first)
            if size > MOST_HELD:
                for lang, parts in held.items():
                    held[lang] = [_merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
                size = sum(len(p[0][0]) for p in held.values())
                if size > MOST_HELD // 2:
                    yield from out()
                    held, size = {}, 0
    yield from out()


def counted(docs: DataFrame) -> DataFrame:
    """lang (half and language), key, n: the n-grams of order ORDER of all texts."""
    ship(docs.sparkSession)
    part = docs.select(_group(F.col("lang"), F.col("text")).alias("lang"), "text").mapInArrow(_text.released(_count), "lang string, key long, n long")
    return part.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _discounts(c: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 of modified Kneser-Ney from the counts of counts."""
    t = c.groupBy("lang").agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"t{k}") for k in (1, 2, 3, 4)])
    y = F.when(F.col("t1") + 2 * F.col("t2") > 0, F.col("t1") / (F.col("t1") + 2 * F.col("t2")))

    def d(k: int, other: float) -> Column:
        raw = k - (k + 1) * y * F.col(f"t{k + 1}") / F.when(F.col(f"t{k}") > 0, F.col(f"t{k}"))
        return F.least(F.greatest(F.coalesce(raw, F.lit(other)), F.lit(0.05 * k)), F.lit(k - 0.02))

    return t.select("lang", d(1, 0.5).alias("d1"), d(2, 1.0).alias("d2"), d(3, 1.5).alias("d3"))


def levels_of(counts: DataFrame) -> dict[int, DataFrame]:
    """lang, key, n by order: counts of order ORDER (a written table), continuation counts below."""
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        below = levels[k + 1].groupBy("lang", F.col("key").bitwiseAND(F.lit(_MASK[k])).alias("key")).agg(F.count("*").alias("n"))
        levels[k] = written(below, f"level{k}")
    return levels


def model(levels: dict[int, DataFrame]) -> DataFrame:
    """lang, level, key, value: log-probability of each n-gram of order ``level``; log back-off weight of each context of ``-level`` bytes."""
    lower, parts, made = None, [], []
    for k in range(1, ORDER + 1):
        d123 = _discounts(levels[k]).withColumnRenamed("lang", "dl")
        c = levels[k].join(d123, F.col("lang") == F.col("dl"))
        ctx = W.partitionBy("lang", "ctx")
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        c = c.withColumn("ctx", F.shiftright("key", BITS)).withColumn("d", d)
        c = c.select("lang", "key", "ctx", "n", "d", F.sum("n").over(ctx).alias("total"), F.sum("d").over(ctx).alias("cut"))
        own, gamma = (F.col("n") - F.col("d")) / F.col("total"), F.col("cut") / F.col("total")
        if lower is None:
            p = c.select("lang", "key", "ctx", (own + gamma * UNKNOWN).alias("p"), gamma.alias("g"))
        else:
            low = lower.select(F.col("lang").alias("l"), F.col("key").alias("suffix"), F.col("p").alias("q"))
            p = c.join(low, (F.col("lang") == F.col("l")) & (F.col("key").bitwiseAND(F.lit(_MASK[k - 1])) == F.col("suffix")))
            p = p.select("lang", "key", "ctx", (own + gamma * F.col("q")).alias("p"), gamma.alias("g"))
        lower = p = written(p, f"kn{k}")
        made.append(p)
        parts.append(p.select("lang", F.lit(k).alias("level"), "key", F.log("p").cast("float").alias("value")))
        parts.append(p.groupBy("lang", "ctx").agg(F.first("g").alias("g")).select("lang", F.lit(1 - k).alias("level"), F.col("ctx").alias("key"), F.log("g").cast("float").alias("value")))
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    whole = written(whole, "kn")
    for p in made:
        dropped(p)
    return whole


class HashArray:
    """Values by 64-bit hash: sorted hashes, and where each leading bit pattern starts."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = _text.mix(keys.view(np.uint64))
        order = np.argsort(h)
        self.h, self.v = h[order], values[order].astype(np.float32)
        self.bits = max(1, int(len(h)).bit_length())
        self.start = np.searchsorted(self.h >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.start).max()) if len(h) else 0

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values; NaN where there is none."""
        h = _text.mix(keys.view(np.uint64))
        out = np.full(len(h), np.nan, np.float32)
        if not len(self.h):
            return out
        b = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.start[b], self.start[b + 1]
        live = np.arange(len(h))
        for _ in range(self.longest):
            ok = at < stop
            if not ok.all():
                live, at, stop, h = live[ok], at[ok], stop[ok], h[ok]
            if not len(live):
                break
            hit = self.h[at] == h
            out[live[hit]] = self.v[at[hit]]
            miss = ~hit
            live, at, stop, h = live[miss], at[miss] + 1, stop[miss], h[miss]
        return out


class Model:
    """The arrays of each half of a language, and level; log-probabilities with back-off."""

    def __init__(self, rows: pa.Table):
        self.arrays: dict[tuple[str, int], HashArray] = {}
        lang, level = rows.column("lang").combine_chunks(), rows.column("level").combine_chunks()
        for name in lang.unique().to_pylist():
            for k in range(1 - ORDER, ORDER + 1):
                part = rows.filter(pc.and_(pc.equal(lang, name), pc.equal(level, k)))
                self.arrays[name, k] = HashArray(part.column("key").to_numpy(), part.column("value").to_numpy())

    def logp(self, lang: str, key: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Natural log-probability of the last character of each n-gram of order k."""
        if k == 0:
            return np.full(len(key), np.log(UNKNOWN), np.float32)
        if (lang, k) not in self.arrays:
            return self.logp(lang, key, 0)
        out = self.arrays[lang, k].get(key)
        miss = np.flatnonzero(np.isnan(out))
        if len(miss):
            m = key[miss]
            weight = self.arrays[lang, 1 - k].get(m >> BITS)
            out[miss] = np.nan_to_num(weight, nan=0.0) + self.logp(lang, m & _MASK[k - 1], k - 1)
        return out


_SCORES = "doc_id long, lang string, t long, n long, logp double"


def _score_batches(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _text.as_strings(batch.column(4))
        n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for a, b in _text.slices(texts):
            for group, part, rows in _by_group(batch.column(3), texts, a, b):
                for key, row in ngrams(part):
                    n[rows] += np.bincount(row, minlength=len(rows))
                    total[rows] += np.bincount(row, model.logp(other(group), key), minlength=len(rows))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n), pa.array(total)], names=["doc_id", "lang", "t", "n", "logp"])


def _doc_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's own n-grams and their counts; a row number tells repeated ids apart."""
    for batch in batches:
        texts = _text.as_strings(batch.column(5))
        for a, b in _text.slices(texts):
            for group, part, rows in _by_group(batch.column(4), texts, a, b):
                for key, row in ngrams(part):
                    order = np.lexsort((key, row))
                    key, row = key[order], row[order]
                    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])) if len(key) else np.zeros(0, np.int64)
                    count = np.diff(np.append(first, len(key)))
                    at = pa.array(rows[row[first]])
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(at) for c in range(4)), pa.array([group] * len(first), pa.string()), pa.array(key[first]), pa.array(count)],
                        names=["part", "doc_id", "lang", "t", "g", "key", "c"],
                    )


def looked_up(levels: dict[int, DataFrame], kn: DataFrame) -> DataFrame:
    """g, key, value: log-probability of each n-gram of order ORDER of a group under the model of the other, with back-off."""
    flipped = F.concat(F.when(F.substring("lang", 1, 1) == "0", F.lit("1")).otherwise(F.lit("0")), F.substring("lang", 2, 1 << 30))
    found = None
    for k in range(1, ORDER + 1):
        own = levels[k].select(F.col("lang").alias("g"), flipped.alias("f"), "key", F.shiftright("key", BITS).alias("ctx"), F.col("key").bitwiseAND(F.lit(_MASK[k - 1])).alias("suffix"))
        top = kn.where(F.col("level") == k).select(F.col("lang").alias("f"), "key", F.col("value").alias("p"))
        back = kn.where(F.col("level") == 1 - k).select(F.col("lang").alias("f"), F.col("key").alias("ctx"), F.col("value").alias("w"))
        own = own.join(top, ["f", "key"], "left").join(back, ["f", "ctx"], "left")
        if found is None:
            below = F.lit(float(np.float32(np.log(UNKNOWN))))
        else:
            own = own.join(found.select("g", F.col("key").alias("suffix"), F.col("value").alias("below")), ["g", "suffix"])
            below = F.col("below")
        last, found = found, written(own.select("g", "key", F.coalesce(F.col("p"), F.coalesce("w", F.lit(0.0)) + below).cast("double").alias("value")), f"found{k}")
        if last is not None:
            dropped(last)
    return found


def scored(docs: DataFrame, levels: dict[int, DataFrame], kn: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """doc_id, lang, t (hash of the text), n (bytes and the end mark; 0 for an empty text), logp (their sum) under the other half's model.

    levels and kn: levels_of() and model() of the same documents.
    """
    ship(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.xxhash64("text").alias("t"), _group(F.col("lang"), F.col("text")).alias("g"), "text")
    if kn.count() <= broadcast_entries:
        sent = docs.sparkSession.sparkContext.broadcast(Model(kn.toArrow()))
        return narrow.mapInArrow(_text.released(lambda batches: _score_batches(sent.value, batches)), _SCORES)
    own = narrow.select(F.monotonically_increasing_id().alias("part"), "*")
    grams = own.mapInArrow(_text.released(_doc_counts), "part long, doc_id long, lang string, t long, g string, key long, c long")
    sums = grams.join(looked_up(levels, kn), ["g", "key"]).groupBy("part", "doc_id", "lang", "t").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("value")).alias("logp"))
    blank = narrow.where("text is null or text = ''").select("doc_id", "lang", "t", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("logp"))
    return sums.select("doc_id", "lang", "t", "n", "logp").unionByName(blank)


def bands(scores: DataFrame, fence: float = FENCE, floor: float = FLOOR) -> DataFrame:
    """band (a language), low, high: the log-perplexities x that each language accepts, from its different texts t."""
    q = scores.groupBy("lang", "t").agg(F.first("x").alias("x")).groupBy("lang").agg(F.percentile_approx("x", [0.25, 0.75], 10000).alias("q"))
    reach = F.greatest(F.lit(fence) * (F.col("q")[1] - F.col("q")[0]), F.lit(floor))
    return q.select(F.col("lang").alias("band"), (F.col("q")[0] - reach).alias("low"), (F.col("q")[1] + reach).alias("high"))


def accepted(docs: DataFrame, fence: float = FENCE, floor: float = FLOOR, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """doc_id, lang, perplexity of the documents within their language's band; bands and model come from docs."""
    levels = levels_of(written(counted(docs), "ngrams"))
    kn = model(levels)
    s = scored(docs, levels, kn, broadcast_entries).where("n > 0").select("doc_id", "lang", "t", "n", (-F.col("logp") / F.col("n")).alias("x"))
    s = written(s, "perplexity")
    for x in (*levels.values(), kn):
        dropped(x)
    slack = SLACK / F.sqrt("n")
    band = bands(s, fence, floor)
    return s.join(band, F.col("lang").eqNullSafe(F.col("band"))).where(F.col("x").between(F.col("low") - slack, F.col("high") + slack)).select("doc_id", "lang", F.exp("x").alias("perplexity"))
