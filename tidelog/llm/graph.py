"""Connected components by alternating large and small stars, each round a staged table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges that one task may hold: about 100 MB.
ONE_TASK = 500_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node gets the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours get the least of them. ``edges`` have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    hung = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return hung.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) by union-find over few edges."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = find(parent.setdefault(x, x)), find(parent.setdefault(y, y))
                parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "component": pa.array(map(find, nodes), pa.int64())})

    return edges.select("a", "b").repartition(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); component: its least node.

    Up to ``one_task`` edges, which bounds what the task holds, are joined at once; more of them by stars.
    """
    edges = common.staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if edges.count() <= one_task:
        return _in_one_task(edges)
    while True:
        new = common.staged(_small_star(_large_star(edges)), "edges")
        seen, now = (e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for e in (edges, new))
        edges = new
        if seen == now:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
