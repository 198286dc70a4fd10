"""Connected components of an edge table.

Blocks of at most ``BLOCK_EDGES`` edges are cut down to spanning forests, one task each,
as long as that shrinks the table; a dense group so counts with its nodes and not with
its pairs.  A table that fits one block is solved by the same union-find in one task.
What is larger goes through alternating large and small stars: every round is an
aggregation and a join, its edge table is written to the shared folder so that lineage
stays short, and nothing but a count and two sums of hashes reaches the driver.  Rounds
grow with the logarithm of the graph's size.  All ways give the least node of each
component.

Defined cases: an edge may repeat; a node without edges is not in the result; an empty
table gives an empty result; columns but a and b are ignored; null ends are not allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import never_sent, staged

#: Edges that one task keeps in memory.
BLOCK_EDGES = 500_000


class _Trees:
    """Union-find; a tree's root is its least node."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        """Whether the edge joins two trees."""
        x, y = self.root(a), self.root(b)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _ends(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges that join two trees, block by block."""
    trees, seen = _Trees(), 0
    for batch in batches:
        if seen and seen + batch.num_rows > BLOCK_EDGES:
            trees, seen = _Trees(), 0
        seen += batch.num_rows
        yield batch.filter(pa.array([trees.join(a, b) for a, b in _ends(batch)], pa.bool_()))


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of the task."""
    trees = _Trees()
    for batch in batches:
        for a, b in _ends(batch):
            trees.join(a, b)
    found = {top for x in trees.up if (top := trees.root(x)) not in trees.up}
    nodes = [*trees.up, *found]
    columns = [pa.array(nodes, pa.int64()), pa.array([trees.root(x) for x in nodes], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["node", "component"])


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over edges (a, b) with a < b.

    ``larger``: hang each node's larger neighbours on its smallest neighbour or
    itself; else hang its smaller neighbours and the node itself there.
    """
    if larger:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # only neighbours above u move: those are the edges with a = u
        out = edges.withColumnRenamed("a", "u").join(never_sent(staged(least, "cc-least")), "u").select(F.col("m"), F.col("b").alias("v"))
    else:
        up = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = staged(up.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        out = up.join(never_sent(least), "u").select("m", "v").union(least.select("m", F.col("u").alias("v")))
    return out.filter("m != v").select(F.least("m", "v").alias("a"), F.greatest("m", "v").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """A count and sums of two hashes: the same for the same set of edges."""
    sums = [F.sum(F.xxhash64(F.lit(i), "a", "b").cast("decimal(20,0)")) for i in range(2)]
    return tuple(edges.agg(F.count(F.lit(1)), *sums).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of *edges* (a, b), which should be a written table; component is the least node."""
    edges = edges.select("a", "b")
    count = edges.count()
    while count > BLOCK_EDGES:
        forest = staged(edges.coalesce(-(-count // BLOCK_EDGES)).mapInArrow(_forest, "a long, b long"), "cc-forest")
        edges, before, count = forest, count, forest.count()
        if 2 * count > before:
            break
    if count <= BLOCK_EDGES:
        return staged(edges.coalesce(1).mapInArrow(_solved, "node long, component long"), "cc-solved")
    current = staged(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-first")
    mark = None
    while mark != (mark := _mark(current)):
        current = staged(_stars(staged(_stars(current, True), "cc-large"), False), "cc-small")
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
