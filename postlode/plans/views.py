"""The driver's tables as a message archive, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1706745600  # all ages count from here


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("account"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("@fixture")).alias("rfc_id"),
        F.substring("text", 1, 70).alias("subject"), F.col("source").alias("sender"), F.col("text").alias("body"), F.col("n_chars").alias("size"),
        (F.lit(1704067200) + (F.col("doc_id") * 7919) % 2592000).alias("date_received"),
        F.when(F.col("doc_id") % 11 != 0, F.col("doc_id") % 97).alias("conversation_id"),
    )


def locations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("message"), F.col("lang").alias("account"), "source")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("__d"), F.coalesce("quality", F.lit(0)).alias("read"), F.coalesce("toxic", F.lit(0)).alias("flagged"))
    own = docs.join(labels, F.col("message") == F.col("__d"))
    all_mail = docs.join(labels, F.col("message") == F.col("__d"), "left").select("message", "account", F.lit("[Gmail]/All Mail").alias("mailbox"), F.coalesce("read", F.lit(0)).alias("read"), F.coalesce("flagged", F.lit(0)).alias("flagged"))
    return all_mail.unionByName(own.select("message", "account", F.col("source").alias("mailbox"), "read", "flagged"))


MESSAGES = """messages_v AS (
  SELECT doc_id AS id, lang AS account, 'doc-' || doc_id || '@fixture' AS rfc_id, substring(text, 1, 70) AS subject,
         source AS sender, text AS body, n_chars AS size, 1704067200 + (doc_id * 7919) % 2592000 AS date_received,
         CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 97 END AS conversation_id,
         lower(strip_accents(substring(text, 1, 70))) AS fsubject, lower(strip_accents(source)) AS fsender, lower(strip_accents(text)) AS fbody
  FROM documents)"""

LOCATIONS = """locations_v AS (
  SELECT d.doc_id AS message, d.lang AS account, '[Gmail]/All Mail' AS mailbox, coalesce(quality, 0) AS read, coalesce(toxic, 0) AS flagged
  FROM documents d LEFT JOIN labels USING (doc_id)
  UNION ALL
  SELECT d.doc_id, d.lang, d.source, coalesce(quality, 0), coalesce(toxic, 0) FROM documents d JOIN labels USING (doc_id))"""
