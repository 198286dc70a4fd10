"""Exact deduplication by progressive refinement (native expressions only).

Level 1 counts byte lengths, level 2 counts prefix hashes among the lengths that
occur twice, level 3 hashes the whole text of what is left.  Rows leave at the
first level at which they are alone, and only rows of surviving groups have their
content read in full.  Every level is a map-side combined count; rows meet group
verdicts in equi joins of written tables, so adaptive execution can split a
group of copies that holds a large share of the rows.  No join uses the row id.

Defined cases: a null text counts as the empty text; texts are equal when they
are identical byte for byte; the largest id of a group stays and a null id sorts
below all others; repeats of one row (same id, same text) count in
``group_size`` and share the verdict of their id, ``one_row_per_id`` drops the
repeats; an empty table gives an empty result; extra columns pass through, also
those named like a result column, which the result column replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_or_empty

#: Code points that the level 2 hash reads.
PREFIX_CHARS = 256

_VERDICT = ("keep_id", "group_size", "kept")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per group of two or more equal texts.

    Columns ``_bytes``, ``_full`` (binary SHA-256), ``keep_id``, ``group_size``
    and ``keep_repeats`` (rows that carry ``keep_id``).
    """
    text = text_or_empty(text_col)
    n_bytes = F.octet_length(text).alias("_bytes")
    prefix = F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("_prefix")

    lengths = docs.select(n_bytes).groupBy("_bytes").agg(F.count(F.lit(1)).alias("n"))
    lengths = staged(lengths.filter("n > 1").select("_bytes"), "exact-lengths")

    prefixes = docs.select(n_bytes, prefix).join(lengths, "_bytes", "left_semi")
    prefixes = prefixes.groupBy("_bytes", "_prefix").agg(F.count(F.lit(1)).alias("n"))
    prefixes = staged(prefixes.filter("n > 1").select("_bytes", "_prefix"), "exact-prefixes")

    survivors = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), n_bytes, prefix)
    survivors = survivors.join(prefixes, ["_bytes", "_prefix"], "left_semi")
    full = survivors.select("_id", "_bytes", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_full"))
    # By id first: spreads a hot group over all tasks and counts repeats of one row.
    by_id = full.groupBy("_bytes", "_full", "_id").agg(F.count(F.lit(1)).alias("n"))
    groups = by_id.groupBy("_bytes", "_full").agg(
        F.max(F.struct("_id", "n")).alias("top"), F.sum("n").alias("group_size")
    )
    groups = groups.filter("group_size > 1").select(
        "_bytes", "_full", F.col("top._id").alias("keep_id"), "group_size", F.col("top.n").alias("keep_repeats")
    )
    return staged(groups, "exact-groups")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of *docs* with ``text_sha256``, ``keep_id``, ``group_size`` and ``kept``."""
    groups = duplicate_groups(docs, id_col, text_col)
    text = text_or_empty(text_col)
    own = [c for c in docs.columns if c not in (*_VERDICT, "text_sha256", "_bytes", "_full")]
    rows = docs.select(
        *own, F.octet_length(text).alias("_bytes"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("_full")
    )
    # hashing the narrow side spares the texts a sort
    joined = rows.join(groups.drop("keep_repeats").hint("shuffle_hash"), ["_bytes", "_full"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        *own,
        F.lower(F.hex("_full")).alias("text_sha256"),
        F.when(alone, F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col(id_col).eqNullSafe(F.col("keep_id"))).alias("kept"),
    )


def one_row_per_id(kept: DataFrame, id_col: str = "doc_id", hash_col: str = "text_sha256") -> DataFrame:
    """Of repeats of one kept row (same id and text) a single one."""
    repeats = staged(
        kept.groupBy(id_col, hash_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(id_col, hash_col),
        "exact-repeats",
    )
    if repeats.isEmpty():
        return kept
    same = kept[id_col].eqNullSafe(repeats[id_col]) & (kept[hash_col] == repeats[hash_col])
    single = kept.join(repeats, same, "left_anti")
    again = kept.join(repeats, same, "left_semi")
    order = Window.partitionBy(id_col, hash_col).orderBy(hash_col)
    again = again.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return single.unionByName(again)
