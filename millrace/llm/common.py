"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import released, shared_dir, shared_path, staged, store_of, swept

__all__ = ["WORD_GAP", "documents", "never_sent", "released", "shared_dir", "shared_path", "staged", "store_of", "swept", "text_or_empty", "tokenizer_path", "worker_state"]

#: ASCII white space that separates words: \x20 and \x09-\x0D.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def never_sent(df: DataFrame) -> DataFrame:
    """*df* for a join without broadcast.

    Its files or shuffled blocks may be small enough for one by the session's threshold, and
    the hash tables of several that are built at once still too large for the driver.
    """
    return df.hint("merge")


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker process.

    Functions travel by value, so their module's globals are new in every task;
    what is costly to load (vocabularies, word caches) is kept here instead.
    """
    import sys
    import types

    return sys.modules.setdefault("_millrace_worker_state", types.ModuleType("_millrace_worker_state")).__dict__
