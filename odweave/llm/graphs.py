"""Connected components as DataFrame rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.llm.common import materialize
from odweave.session import remove, shared_dir

#: Edges that a task contracts at a time.
CONTRACT_EDGES = 500_000


class Union:
    """Disjoint sets of any labels; the root of a set is its least label."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each CONTRACT_EDGES replaced by a star around the least id of each of their components."""
    union, held = Union(), 0

    def stars() -> pa.RecordBatch:
        ids = [x for x in union.up if union.find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([union.find(x) for x in ids], pa.int64())], names=["u", "v"])

    for batch in batches:
        for x, y in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
            union.join(x, y)
        held += batch.num_rows
        if held >= CONTRACT_EDGES:
            yield stars()
            union, held = Union(), 0
    yield stars()


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours, by partial aggregation."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in edges (a, b) with a <> b; root is the least id reachable.

    Each task first contracts the edges it holds. Then rounds alternate large-star (larger neighbours of a node
    move to the least) and small-star (smaller ones and the node itself do) until no edge changes, which they
    reach in a number of rounds that grows with the logarithm of the number of ids. Each round is written to the
    shared folder and the one before it deleted.
    """
    spark = edges.sparkSession
    least_first = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    path = shared_dir(spark)
    now = materialize(least_first.mapInArrow(_contract, "u long, v long"), path)
    signature = _signature(now)
    while True:
        both = now.union(now.select("v", "u"))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, path = path, shared_dir(spark)
        now = materialize(small, path)
        remove(spark, before)
        seen = _signature(now)
        if seen == signature:
            break
        signature = seen
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
