"""Mixing of sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a token budget from the target weights. A document's key is exponential with the
rate of its quality weight, -ln(u) / w, where u comes from a hash of doc_id and the seed; within a
source, documents in order of key are a weighted sample without replacement of any size. A budget
of at least the source's tokens first takes whole epochs (every document once each); the rest is
a fraction: documents in order of key whose running token sum stays within it.

The running sum has two levels: buckets of the keys (more the more documents a source has) are
summed and prefix-summed, then documents within their bucket, so no task holds a whole source.
What comes out for each source is its epochs and the last key taken, one row a source.

Tokens are those of the byte-level BPE vocabulary of op7, or another count of the text. The quality
weight is any function of the text (the corpus pipeline gives op8's score); unless told otherwise
it is the share of words among a text's pre-tokens. Op6 itself counts pre-tokens (words, digits,
signs), as its SQL does.

Defined cases: a null source is a source of its own, apart from ''; null ids and texts of no tokens
(null, empty; white space only has BPE tokens) are left out; equal keys (rows that repeat) are
taken together, whole or not at all; null, NaN, zero or negative weights count as LEAST_WEIGHT; a
source that target doesn't name gets nothing; an empty table gives no rows; extra columns are
passed on by mixed() whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..ship import ship
from . import rollup
from ._shared import dropped, fresh, written

SEED = "mix-1"
TEMPERATURE = 0.7
LEAST_WEIGHT = 0.05
BUCKET_ROWS = 20_000
BROADCAST_SOURCES = 100_000
TOKEN = r"\p{L}+|\p{N}|[^ \t\r\n\p{L}\p{N}]"
WORD = r"\p{L}+"


def tokens(text: Column) -> Column:
    """Tokens of a text in the byte-level BPE vocabulary."""
    return rollup.counter()(text)


def pre_tokens(text: Column) -> Column:
    """Pre-tokens of a text: each word, each digit and each sign."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from 52 bits of md5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", doc_id.cast("string"), F.lit(seed))), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def word_share(text: Column) -> Column:
    """Share of words among a text's pre-tokens."""
    return F.try_divide(F.regexp_count(text, F.lit(WORD)).cast("double"), pre_tokens(text))


def _source(source: Column) -> Column:
    """A name for each source: "=src1"; "-" for null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def _named(source: str | None) -> str:
    return "-" if source is None else "=" + source


def _key(doc_id: Column, weight: Column, seed: str) -> Column:
    w = weight.cast("double")
    return -F.log(uniform(doc_id, seed)) / F.when(w >= LEAST_WEIGHT, F.when(F.isnan(w), LEAST_WEIGHT).otherwise(w)).otherwise(LEAST_WEIGHT)


def _usable(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text <> ''")


def keyed(docs: DataFrame, seed: str = SEED, count: Callable[[Column], Column] = tokens, weight: Callable[[Column], Column] = word_share) -> DataFrame:
    """doc_id, source, src (never null), tokens, key of the documents that count."""
    ship(docs.sparkSession)
    text = F.col("text")
    t = _usable(docs).select("doc_id", "source", _source(F.col("source")).alias("src"), count(text).alias("tokens"), weight(text).alias("w"))
    return t.select("doc_id", "source", "src", "tokens", _key(F.col("doc_id"), F.col("w"), seed).alias("key"))


def budgets(totals: DataFrame, target: dict[str | None, float] | None, total_budget: float | None, temperature: float = TEMPERATURE) -> DataFrame:
    """src, total, n, mean, epochs, rest of each source in totals (src, total, n, mean).

    target: share of each source (None for null); None: shares by total ** temperature.
    total_budget: tokens of the whole mixture; None: as many as there are.
    """
    power = F.pow("total", F.lit(temperature))
    every = totals.agg(F.sum("total").alias("total"), F.sum(power).alias("power")).first()
    if target is None:
        share = power / F.lit(every["power"])
    else:
        scale = sum(target.values()) or 1.0
        pairs = [x for k, v in target.items() for x in (F.lit(_named(k)), F.lit(v / scale))]
        share = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("src")), F.lit(0.0)) if pairs else F.lit(0.0)
    whole = F.lit(float(every["total"] or 0) if total_budget is None else float(total_budget))
    b = totals.select("*", F.floor(share * whole + 1e-6).cast("long").alias("budget"))
    epochs = F.floor(F.col("budget") / F.col("total")).cast("long")
    return b.select("src", "total", "n", "mean", epochs.alias("epochs"), (F.col("budget") - epochs * F.col("total")).alias("rest"))


def cutoffs(keys: DataFrame, target: dict[str | None, float] | None = None, total_budget: float | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """src, epochs, edge: of each source the whole epochs and the greatest key in the fraction (null: none); keys is a written table."""
    totals = written(keys.groupBy("src").agg(F.sum("tokens").alias("total"), F.count("*").alias("n"), F.avg("key").alias("mean")), "mix-totals")
    plan = written(budgets(totals, target, total_budget, temperature), "mix-plan")
    # the keys' distribution is near exponential: its quantiles make buckets of like size; any monotone bucket is right
    at = F.floor((1 - F.exp(-F.col("key") / F.col("mean"))) * F.ceil(F.col("n") / BUCKET_ROWS)).cast("long")
    k = keys.join(plan.where("rest > 0"), "src").select("src", "key", "tokens", "rest", at.alias("bucket"))
    # equal keys share one row
    k = k.groupBy("src", "bucket", "key").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    sums = k.groupBy("src", "bucket").agg(F.sum("t").alias("s"), F.first("rest").alias("limit"))
    up = W.partitionBy("src").orderBy("bucket")
    sums = sums.select("src", "bucket", "limit", "s", (F.sum("s").over(up) - F.col("s")).alias("base"))
    # only the bucket in which the budget ends needs its documents in order
    last = sums.where("base <= limit and base + s > limit")
    inside = k.join(last.select("src", "bucket", "base"), ["src", "bucket"])
    run = F.col("base") + F.sum("t").over(W.partitionBy("src", "bucket").orderBy("key"))
    inside = inside.select("src", "key", "rest", run.alias("run")).where("run <= rest").groupBy("src").agg(F.max("key").alias("edge"))
    whole = sums.where("base + s <= limit").groupBy("src").agg(F.max("bucket").alias("bucket"))
    before = k.join(whole, ["src", "bucket"]).groupBy("src").agg(F.max("key").alias("before"))
    edge = before.join(inside, "src", "full").select("src", F.greatest("before", "edge").alias("edge"))
    out = written(plan.join(edge, "src", "left").select("src", "epochs", "edge"), "mix-cutoffs")
    dropped(totals)
    dropped(plan)
    return out


def _sized(cut: DataFrame) -> DataFrame:
    """A row a source: sent to all where that is little; else joined as any table is."""
    return F.broadcast(cut) if cut.count() <= BROADCAST_SOURCES else cut


def decided(docs: DataFrame, target: dict[str | None, float] | None = None, total_budget: float | None = None, seed: str = SEED, count: Callable[[Column], Column] = tokens, weight: Callable[[Column], Column] = word_share) -> DataFrame:
    """doc_id, source, tokens, copies (at least 1) of the documents in the mixture."""
    keys = written(keyed(docs, seed, count, weight), "mix-keys").where("tokens > 0")
    cut = cutoffs(keys, target, total_budget)
    copies = F.col("epochs") + F.coalesce(F.col("key") <= F.col("edge"), F.lit(False)).cast("long")
    return keys.join(_sized(cut), "src").select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")


def mixed(docs: DataFrame, target: dict[str | None, float] | None = None, total_budget: float | None = None, seed: str = SEED, count: Callable[[Column], Column] = tokens, weight: Callable[[Column], Column] = word_share) -> DataFrame:
    """The mixture with all columns of docs, a document as many times as it is taken."""
    ship(docs.sparkSession)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    src, n, w, epochs, edge, copy = fresh(docs, "src", "tokens", "w", "epochs", "edge", "copy")
    text = F.col("text")
    # written with the texts, so that each is measured and weighed once
    rows = written(_usable(docs).select("*", _source(F.col("source")).alias(src), count(text).alias(n), weight(text).alias(w)), "mix-rows").where(F.col(n) > 0)
    key = _key(F.col("doc_id"), F.col(w), seed)
    keys = written(rows.select(F.col(src).alias("src"), F.col(n).alias("tokens"), key.alias("key")), "mix-keys")
    cut = cutoffs(keys, target, total_budget)
    dropped(keys)
    copies = F.col(epochs) + F.coalesce(key <= F.col(edge), F.lit(False)).cast("long")
    return rows.join(_sized(cut).toDF(src, epochs, edge), src).select(*columns, F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias(copy)).drop(copy)


SQL = r"""
WITH t AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS src,
         CAST(len(regexp_extract_all(text, '\p{L}+|\p{N}|[^ \t\r\n\p{L}\p{N}]')) AS BIGINT) AS tokens,
         CAST(len(regexp_extract_all(text, '\p{L}+')) AS DOUBLE) AS words
  FROM documents WHERE doc_id IS NOT NULL),
k AS (
  SELECT *, -ln((CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':mix-1'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
            / greatest(words / tokens, 0.05) AS key
  FROM t WHERE tokens > 0),
totals AS (SELECT src, CAST(sum(tokens) AS BIGINT) AS total FROM k GROUP BY src),
shares AS (SELECT src, total, floor(pow(total, 0.7) / sum(pow(total, 0.7)) OVER () * sum(total) OVER () + 1e-6) AS budget FROM totals),
plan AS (SELECT src, CAST(floor(budget / total) AS BIGINT) AS epochs, budget - floor(budget / total) * total AS rest FROM shares),
r AS (
  SELECT k.*, epochs, rest, sum(tokens) OVER (PARTITION BY src ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM k JOIN plan USING (src))
SELECT doc_id, source, tokens, CAST(epochs + CASE WHEN run <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM r WHERE epochs + CASE WHEN run <= rest THEN 1 ELSE 0 END > 0
"""
