"""Connected components of an edge table by alternating large and small stars, after contraction in partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import tidy, written

MOST_EDGES, MOST_ROUNDS = 500_000, 99


class Forest:
    """Union-find whose roots are the smallest nodes."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, at = self.up, x
        while (y := up.get(at, at)) != at:
            at = y
        while (y := up.get(x, x)) != at:
            up[x], x = at, y
        return at

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))
        return a != b


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars; at most MOST_EDGES at a time."""
    forest, n = Forest(), 0

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in forest.up if (r := forest.root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            forest.join(u, v)
        n += batch.num_rows
        if n > MOST_EDGES:
            yield stars()
            forest, n = Forest(), 0
    yield stars()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """edges: u, v (longs; rows with a null are no edges, an empty table gives an empty one). Returns node, label: of each node with an edge, the smallest node reachable. Raises if MOST_ROUNDS don't suffice."""
    now = written(edges.select("u", "v").filter("u <> v").mapInArrow(tidy(_contracted), "u long, v long").distinct(), "edges-0", folder)
    sums = None
    for k in range(1, MOST_ROUNDS + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.filter("u <> v").distinct(), f"edges-{k}", folder)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == sums:
            break
        sums = new
    else:
        raise RuntimeError(f"components have not converged in {MOST_ROUNDS} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
