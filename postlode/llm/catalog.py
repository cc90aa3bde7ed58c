"""The registered queries of this package, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, embeddings, langid, licenses, mixing, packing, perplexity, quality, rollup, simhash
from ._shared import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_perplexity": lambda s, d: perplexity.accepted(table(s, d, "documents")),
        "op2_language_id": lambda s, d: langid.accepted(table(s, d, "documents")),
        "op3_packing": lambda s, d: packing.packed(table(s, d, "documents")),
        "op4_simhash": lambda s, d: simhash.groups(table(s, d, "documents")),
        "op5_licenses": lambda s, d: licenses.found(table(s, d, "documents")),
        "op6_mixing": lambda s, d: mixing.decided(table(s, d, "documents"), count=mixing.pre_tokens),
        "op7_token_rollup": lambda s, d: rollup.corpus_totals(table(s, d, "documents"), table(s, d, "labels").where("toxic = 1")),
        "op8_quality": lambda s, d: quality.accepted(table(s, d, "documents"), table(s, d, "labels")),
        "op9_chat": lambda s, d: chat.formatted(table(s, d, "conversations")),
        "op10_embeddings": lambda s, d: embeddings.classes(table(s, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.SQL, "op9_chat": chat.SQL, "op10_embeddings": embeddings.SQL}
