"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarix import storage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Minima are combined before the shuffle and have one row a node, so hubs split in the join."""
    if large:  # every larger neighbour goes to the smallest of the neighbourhood
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        pick = F.col("v") > F.col("u")
    else:  # every smaller neighbour, and the node itself
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        pick = F.lit(True)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.where(pick).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


#: Edges that one task joins up by itself, so that small graphs don't pay for rounds of jobs.
FEW = 1 << 17


def _forest(edges: DataFrame) -> DataFrame:
    """(node, component) of a few edges (a, b) by union-find in one task; nodes are integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent.setdefault(up, up)
                x = up
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "component"])

    return edges.repartition(1).mapInArrow(run, "node bigint, component bigint")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Each round is written to the shared folder, so lineage stays short and lost executors cost one
    round. Self-loops are ignored; nodes without another neighbour don't appear. Up to FEW edges between
    integers are left to one task.
    """
    now = storage.materialise(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if dict(now.dtypes)["a"] == dict(now.dtypes)["b"] == "bigint" and now.limit(FEW + 1).count() <= FEW:
        return _forest(now)
    mark = None
    for _ in range(rounds):
        after = storage.materialise(_star(_star(now, True), False), "edges")
        storage.release(now)
        now = after
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # settled: every node points at the smallest node of its component
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select("b", "b")).distinct()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an iteration's state to the shared folder and go on from the written table."""
    return storage.materialise(df, "state")
