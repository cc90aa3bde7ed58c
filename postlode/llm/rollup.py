"""Token counts as delta-maintained rollups.

A store keeps totals of documents, tokens and characters by source, language and tokenizer
version. It changes by batches of signed rows: an insert adds a document's counts, a delete
takes them away, a revision does both (the old counts negative, the new positive). A batch is
summed first and committed as one small table; totals are the sum over all batches, folded
together now and then. A batch has an id: it is written beside the store and moved into place in
one rename, so a batch that is sent again, or run twice after a failure, counts once.

A fold is a table of totals and one of the ids of all batches in it. It takes the place of the
fold before by its number; of two that are made at once only one gets the number, and the other is
thrown away. What a fold has replaced is deleted by the next one, never before the fold stands. So
a reader sums the newest fold and the batches that aren't in it, at any moment: a batch that comes
during a fold stays beside it, and a fold that fails leaves all as it was.

Tokens are those of a public byte-level BPE vocabulary, whose file is a parameter; only the
driver reads it.

Defined cases: a null source or language is a key of its own; null and empty texts are documents
of 0 tokens; rows that repeat count as often as they occur; an empty batch is a commit that adds
nothing; totals of 0 documents, tokens and characters are left out; columns other than doc_id,
source, lang and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from . import _text
from ._shared import dropped, shared_dir, written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEY = ["source", "lang", "tokenizer"]
FOLD = 32


@cache
def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@cache
def _built(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encoding(path: str):
    return _built(_read(path))


@cache
def version(path: str = VOCABULARY) -> str:
    """Name of a tokenizer: its file's name and digest."""
    return f"{path.rsplit('/', 1)[-1]}@{hashlib.sha256(_read(path)).hexdigest()[:12]}"


#: Longer texts are cut for the encoder between a word and the white space before the next, which changes no token.
LONG = 1 << 20


def count_tokens(texts: list[str], vocabulary: bytes | None = None) -> np.ndarray:
    encode = _built(_read(VOCABULARY) if vocabulary is None else vocabulary).encode_ordinary
    out = np.zeros(len(texts), np.int64)
    first: dict[str, int] = {}
    for i, t in enumerate(texts):
        same = first.setdefault(t, i)
        if same != i:  # a mixture holds copies side by side
            out[i] = out[same]
            continue
        start = 0
        while len(t) - start > LONG:
            cut = t.rfind(" ", start + 1, start + LONG)
            while cut > start and (t[cut - 1].isspace() or not t[cut + 1 : cut + 2].isalpha()):
                cut = t.rfind(" ", start + 1, cut)
            if cut <= start:
                break
            out[i] += len(encode(t[start:cut]))
            start = cut
        out[i] += len(encode(t[start:]))
    return out


def counter(path: str = VOCABULARY):
    """Column function: text -> tokens. The vocabulary's file (some MB at most) is sent to the workers."""
    sent = SparkSession.active().sparkContext.broadcast(_read(path))

    def count(texts: pa.Array) -> pa.Array:
        texts = _text.as_strings(texts)
        n = [count_tokens(texts.slice(a, b - a).to_pylist(), sent.value) for a, b in _text.slices(texts)]
        _text.release()
        return pa.array(np.concatenate(n or [np.zeros(0, np.int64)]))

    return F.arrow_udf(count, "long")


def measured(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens, chars of every document."""
    ship(docs.sparkSession)
    return docs.select(
        "doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), F.lit(version(path)).alias("tokenizer"),
        counter(path)("text").alias("tokens"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"),
    )


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Rows of measured() as inserts (1) or deletes (-1)."""
    s = F.lit(sign).cast("long")
    return rows.select(*KEY, s.alias("documents"), (s * F.col("tokens")).alias("tokens"), (s * F.col("chars")).alias("chars"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that replace documents: old as they were counted, new as they are now."""
    return signed(old, -1).unionByName(signed(new, 1))


def _totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("documents", "tokens", "chars")])


class Store:
    """Totals in a folder that all executors see; every batch in a folder of its id."""

    schema = "source string, lang string, tokenizer string, documents long, tokens long, chars long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def _names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)))

    @staticmethod
    def _folder(batch: str) -> str:
        return "batch-" + hashlib.sha256(batch.encode()).hexdigest()[:32]

    def _moved(self, tmp: str, name: str) -> bool:
        """Moves tmp into place as ``name``; False, and tmp is gone, if another is there already."""
        mark, place = f"by-{uuid.uuid4().hex}", f"{self.path}/{name}"
        self._fs.create(self._path(f"{tmp}/_{mark}")).close()
        self._fs.rename(self._path(tmp), self._path(place))
        if self._fs.exists(self._path(f"{place}/_{mark}")):
            return True
        # some file systems refuse, others move into the folder that is there
        for left in (tmp, f"{place}/{tmp.rsplit('/', 1)[1]}"):
            if self._fs.exists(self._path(left)):
                self._fs.delete(self._path(left), True)
        return False

    def _newest(self, names: list[str]) -> str | None:
        return max((n for n in names if n.startswith("fold-")), default=None)

    def _members(self, fold: str | None) -> DataFrame:
        """m: the batches in a fold."""
        if fold is None:
            return self.spark.createDataFrame([], "m string")
        return self.spark.read.schema("m string").parquet(f"{self.path}/{fold}/members")

    def _apart(self, names: list[str]) -> tuple[str | None, list[str]]:
        """(the newest fold, the batches in names that aren't in it): at most those that came in two folds' time."""
        fold, batches = self._newest(names), [n for n in names if n.startswith("batch-")]
        if fold and batches:
            inside = {r[0] for r in self._members(fold).where(F.col("m").isin(batches)).collect()}
            batches = [n for n in batches if n not in inside]
        return fold, batches

    def _summed(self, fold: str | None, batches: list[str]) -> DataFrame:
        paths = [f"{self.path}/{n}" for n in batches] + ([f"{self.path}/{fold}/totals"] if fold else [])
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return _totals(rows).where("documents <> 0 or tokens <> 0 or chars <> 0")

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Adds signed rows once; False if the batch is in already."""
        names, folder = self._names(), self._folder(batch)
        if folder in names or not self._members(self._newest(names)).where(F.col("m") == folder).isEmpty():
            return False
        tmp = f"{self.path}/.tmp-{uuid.uuid4().hex}"
        _totals(rows).write.parquet(tmp)
        if not self._moved(tmp, folder):
            return False  # another run of the batch was first
        if len(self._apart(self._names())[1]) >= FOLD:
            self.fold()
        return True

    def totals(self) -> DataFrame:
        return self._summed(*self._apart(self._names()))

    def fold(self) -> bool:
        """Sums all batches into one table; False if another fold took its number, or the move failed: then nothing has changed."""
        names = self._names()
        old, batches = self._apart(names)
        number = int(old.split("-")[1]) + 1 if old else 0
        tmp = f"{self.path}/.tmp-{uuid.uuid4().hex}"
        # totals and members are of the same names, whatever is committed meanwhile
        self._summed(old, batches).coalesce(1).write.parquet(f"{tmp}/totals")
        new = self.spark.createDataFrame([(n,) for n in batches], "m string")
        self._members(old).unionByName(new).write.parquet(f"{tmp}/members")
        if not self._moved(tmp, f"fold-{number:09d}"):
            return False
        # a reader may still be at the fold before: only what that had replaced goes
        gone = [n for n in names if n.startswith("fold-") and n != old]
        gone += [n for n in names if n.startswith("batch-") and n not in batches]
        for n in gone:
            self._fs.delete(self._path(f"{self.path}/{n}"), True)
        return True


def corpus_totals(docs: DataFrame, deleted: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """A new store's totals after the load of docs and the delete of the doc_ids in ``deleted``."""
    spark = docs.sparkSession
    counts = written(measured(docs, path), "token-counts")
    store = Store(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    store.commit("load", signed(counts, 1))
    ids = deleted.where("doc_id is not null").select(F.col("doc_id").alias("gone")).distinct()
    store.commit("delete", signed(counts.join(ids, F.col("doc_id") == F.col("gone"), "left_semi"), -1))
    out = written(store.totals(), "rollup-totals")
    dropped(counts)
    store._fs.delete(store._path(store.path), True)
    return out
