"""Pairs that meet under a key, without the pairs inside groups that are linked already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import never_sent, staged


def with_groups(rows: DataFrame, groups: DataFrame, side: str) -> DataFrame:
    """*rows* with the group of their column *side*, itself where (node, component) *groups* has none."""
    found = rows.join(never_sent(groups.select(F.col("node").alias(side), "component")), side, "left")
    return found.select(*rows.columns, F.coalesce("component", side).alias(f"{side}_group"))


def pairs_across(own: DataFrame, asked: DataFrame, keys: list[str], symmetric: bool = False) -> DataFrame:
    """Rows of *own* (keys, a, a_group, ...) met with rows of *asked* (keys, b, b_group, ...) of another group.

    Under each key the group with the most rows of *own* is set apart: its rows are met with
    rows outside it only, so that a large group of copies costs its size times the number
    of strangers under the key, and not its square.  With ``symmetric`` both tables hold the
    same rows, and each pair comes once or twice, in either order.  Both tables should be
    written ones, so that adaptive execution can split a key with many rows.
    """
    counts = own.groupBy(*keys, "a_group").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy(*keys).agg(F.max(F.struct("n", "a_group")).alias("main"))
    main = staged(main.select(*keys, F.col("main.a_group").alias("main")), "across-main")
    asked = asked.join(never_sent(main), keys)
    # written, else the joins below would take over its partitions, which cannot be split
    strangers = staged(asked.filter("b_group <> main").drop("main"), "across-strangers")
    met = own.join(never_sent(strangers), keys).filter("a_group <> b_group")
    if symmetric:
        return met
    odd = staged(own.join(never_sent(main), keys).filter("a_group <> main").drop("main"), "across-odd")
    inside = staged(asked.filter("b_group = main").drop("main"), "across-inside")
    return met.unionByName(odd.join(never_sent(inside), keys))
