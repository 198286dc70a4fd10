"""Row numbers and the row before, in the row order.

A window over all rows would put them into one task.  Rows are cut into buckets that
follow each other in the order instead.  Where the order still is that of the scan, a
bucket is a piece of a file, known without a look at the rows.  After a sort the rows
are range-partitioned by the whole order and written to the shared folder, so that the
partitions stay what they are; those are the buckets then.  Windows run inside a bucket;
what crosses its edges (row counts, last rows, nearest matches) is one row a bucket.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.relation import Relation, fresh
from ..sources.shared import staged

_IN_TASK = (1 << 33) - 1
_SLASHES = r"^([A-Za-z][A-Za-z0-9+.-]*):/+"
#: Rows of a file in one piece of a place that is made of a rank and a row.
_RANK_SHIFT = 44
_CHUNK_BITS = 20


def settled(rel: Relation) -> Relation:
    """The rows written in their order; a place in it is one number from then on."""
    df, place = rel.df, fresh("place")
    if rel.order:
        df = df.repartitionByRange(*rel.order_columns()).sortWithinPartitions(*rel.order_columns())
    df = staged(df.withColumn(place, F.monotonically_increasing_id()), "settled")
    # the number of the partition stands above the number in it
    return rel.with_(df=df).sorted_by([(place, True)], ordinal=place, buckets=(F.shiftright(F.col(place), 33),))


def with_ordinal(rel: Relation) -> Relation:
    """The relation with a place that is one number, where files can be ranked; else as it is."""
    if rel.ordinal or not rel.files:
        return rel
    spark, (file, row) = rel.df.sparkSession, (c for c, _ in rel.order)
    # listings and rows may write the same local path with one slash or three
    names = sorted(re.sub(_SLASHES, r"\1:/", f) for f in rel.files)
    ranks = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "_ranked string, _rank long")
    place = fresh("place")
    df = rel.df.join(F.broadcast(ranks), F.regexp_replace(file, _SLASHES, "$1:/") == F.col("_ranked"), "left")  # a row a file, MOST_RANKED at most
    rank = F.coalesce("_rank", F.raise_error(F.concat(F.lit("a row of an unlisted file: "), F.col(file))).cast("long"))
    df = df.withColumn(place, F.shiftleft(rank, _RANK_SHIFT).bitwiseOR(F.col(row))).drop("_ranked", "_rank")
    return rel.with_(df=df, order=[(place, True)], ordinal=place, files=())


def chunked(place: str) -> tuple[Column, ...]:
    return (F.shiftright(F.col(place), _CHUNK_BITS),)


def _cut(rel: Relation) -> tuple[Relation, list[str], bool]:
    """The relation with bucket columns, their names, and whether it was settled for that."""
    fresh_places = not rel.buckets
    if fresh_places:
        rel = settled(rel)
    names = [fresh("bucket") for _ in rel.buckets]
    return rel.with_(df=rel.df.withColumns(dict(zip(names, rel.buckets, strict=True)))), names, fresh_places


def _met(df: DataFrame, few: DataFrame, names: list[str], bounded: bool) -> DataFrame:
    """Rows with their bucket's row; buckets of a sort are few, pieces of a scan stay where windows put them."""
    return df.join(F.broadcast(few) if bounded else few, names)


def _numbered(rel: Relation, total: str | None = None) -> tuple[Relation, str, list[str], bool]:
    number = fresh("number")
    rel, names, fresh_places = _cut(rel)
    sizes = rel.df.groupBy(*names).agg(F.count(F.lit(1)).alias("_size"))
    along = Window.orderBy(*names)  # a row a bucket
    before = F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, -1))
    more = [F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total)] if total else []
    sizes = sizes.select(*names, F.coalesce(before, F.lit(0)).alias("_before"), *more)
    if fresh_places:  # no row has gone since its place was given
        inside = F.col(rel.ordinal).bitwiseAND(F.lit(_IN_TASK)) + 1
    else:
        inside = F.row_number().over(Window.partitionBy(*names).orderBy(*rel.order_columns()))
    df = _met(rel.df.withColumn(number, inside.cast("long")), sizes, names, fresh_places)
    return rel.with_(df=df.withColumn(number, F.col(number) + F.col("_before")).drop("_before")), number, names, fresh_places


def number_rows(rel: Relation, total: str | None = None) -> tuple[Relation, str]:
    """The relation with each row's number, from 1, and with the number of all rows in *total*."""
    if rel.row_number and not total:
        number = fresh("number")
        return rel.with_(df=rel.df.withColumn(number, F.col(rel.row_number) + 1)), number
    rel, number, names, _ = _numbered(rel, total)
    return rel.with_(df=rel.df.drop(*names)), number


def previous_values(rel: Relation, columns: list[str]) -> tuple[Relation, list[str], str]:
    """The relation with the row before's cells (the own ones in the first row) and a first-row mark."""
    names, first = [fresh("prev") for _ in columns], fresh("first")
    rel, buckets, fresh_places = _cut(rel)
    inside = Window.partitionBy(*buckets).orderBy(*rel.order_columns())
    cells = F.struct(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)))
    if all(up for _, up in rel.order):
        place = F.col(rel.ordinal) if rel.ordinal else F.struct(*(F.col(c) for c, _ in rel.order))
        last = rel.df.groupBy(*buckets).agg(F.max_by(cells, place).alias("_last"))
    else:
        back = Window.partitionBy(*buckets).orderBy(*rel.order_columns(reverse=True))
        last = rel.df.withColumn("_n", F.row_number().over(back)).filter("_n = 1").select(*buckets, cells.alias("_last"))
    carried = last.select(*buckets, F.lag("_last").over(Window.orderBy(*buckets)).alias("_carried"))  # a row a bucket
    df = _met(rel.df.withColumn("_lag", F.lag(cells).over(inside)), carried, buckets, fresh_places)
    df = df.withColumn("_lag", F.coalesce("_lag", "_carried")).withColumn(first, F.col("_lag").isNull())
    for c, n in zip(columns, names, strict=True):
        df = df.withColumn(n, F.when(F.col(first), F.col(c)).otherwise(F.col(f"_lag.{n}")))
    return rel.with_(df=df.drop("_lag", "_carried", *buckets)), names, first


def near_hits(rel: Relation, hit: str, before: int, after: int) -> Relation:
    """The rows with a row where *hit* holds among the *before* rows behind them, or *after* ahead.

    The nearest hits on both sides are found inside the bucket, else carried over from the
    nearest bucket that has one.
    """
    rel, number, names, fresh_places = _numbered(rel)
    at = F.when(F.col(hit), F.col(number))
    along, against = Window.orderBy(*names), Window.orderBy(*(F.col(n).desc() for n in names))  # a row a bucket
    edges = rel.df.groupBy(*names).agg(F.min(at).alias("_least"), F.max(at).alias("_most"))
    edges = edges.select(
        *names,
        F.max("_most").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_behind"),
        F.min("_least").over(against.rowsBetween(Window.unboundedPreceding, -1)).alias("_ahead"),
    )
    # both frames grow from their start: one that ends at the bucket's end is gone through again for every row
    inside, back = (Window.partitionBy(*names).orderBy(*rel.order_columns(reverse=r)) for r in (False, True))
    df = rel.df.withColumn("_up", F.max(at).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_down", F.min(at).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    df = _met(df, edges, names, fresh_places)
    behind, ahead = F.coalesce("_up", "_behind"), F.coalesce("_down", "_ahead")
    near = (F.col(number) - behind <= after) | (ahead - F.col(number) <= before)
    df = df.filter(F.coalesce(near, F.lit(False))).drop("_up", "_down", "_behind", "_ahead", number, *names)
    return rel.with_(df=df, row_number=None)
