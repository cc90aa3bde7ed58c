"""Documents to packed training sequences, in five stages.

Each stage reads the whole result of the one before, written as Parquet; all but the last return
the columns of documents, whatever further ones there are and however they are named.

Defined cases, stage by stage (an empty table gives no rows in each):

* language_id drops null and empty texts; a null language stays if the network is certain; rows
  that repeat are judged alike.
* quality_classifier drops null and empty texts; without positives or without unlabelled texts it
  keeps all others; rows that repeat are judged alike.
* simhash_dedup keeps rows of null doc_id and texts without words; of rows that repeat doc_id and
  text one stays, the least as JSON; ties go to the least doc_id.
* mix_sources drops null doc_ids and texts of no tokens; a null source is a source of its own; equal
  keys are taken together; a document may come out several times.
* best_fit_packing leaves out null doc_ids and texts of no tokens, cuts long texts into pieces, and
  packs a document as often as it has rows; ties go to the lesser doc_id, start and bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postlode.llm import langid, mixing, packing, quality, simhash
from postlode.llm._shared import dropped, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.filtered(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Weights are the quality classifier's scores, fitted on what has come this far."""
    return mixing.mixed(docs, weight=quality.weight(quality.train(docs, table(spark, sf_dir, "labels"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: The trained stages and the trie join are beyond SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; a stage's result is deleted when the next one's is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        result, before = stage(spark, docs, sf_dir), last
        docs = written(result, name)
        dropped(result)  # tables of the stage's own, as the one that holds mix_sources' weights and texts
        if before is not None:
            dropped(before)
        last = docs
    return docs
