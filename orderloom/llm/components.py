"""Connected components by alternating stars; links never leave the executors.

Each round replaces a node's links by links to its least neighbour, first towards
larger nodes, then towards smaller ones.  Aggregations combine before they
shuffle, so a hub costs its joins but no single group.  A round ends in a table in
the shared folder; rounds stop when only stars are left (logarithmic in the diameter).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._plan import discard, written


class UnionFind:
    """Classes of whatever is hashable; the least member is the root."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as stars: fewer rows, same components."""
    for batch in batches:
        classes = UnionFind()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            classes.union(a, b)
        rows = [(x, r) for x in list(classes.parent) if (r := classes.find(x)) != x]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["u", "v"]
        )


def _stars(held: DataFrame) -> bool:
    """Every node has one link, to a node that has none: nothing is left to do."""
    rows, nodes = held.agg(F.count("u"), F.count_distinct("u")).first()
    return rows == nodes and held.join(held.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """(id, component) of every node of the links (a, b) with a link to another
    node; component is the least id reachable."""
    links = links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).dropna()
    held = written(links.mapInArrow(_forest, "u bigint, v bigint").distinct())
    while not _stars(held):
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("x")).select("x.u", "x.v")
        last, held = held, written(small.filter(F.col("u") != F.col("v")).distinct())
        discard(last)
    roots = held.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return held.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
