"""Connected components of an edge table by alternating large-star and
small-star rounds (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014).

Each round is two aggregations and two joins on node identifiers.  A hub's
edges are pre-aggregated for its minimum and its join may be split by Spark;
no component is gathered in a task or on the driver.  Rounds are written to
the shared checkpoint folder.  Before the rounds every task contracts its own
edges, which leaves a star per task and component.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlabel.llm.common import scratch_table

_EDGE = "u long, v long"
#: Edges a task contracts at once.
CONTRACT_EDGES = 1_000_000


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (p := parent.setdefault(root, root)) != root:
            root = p
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        """(member, root) of every member that is no root."""
        return [(x, r) for x in list(self.parent) if (r := self.find(x)) != x]


def edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()),
                                       pa.array([b for _, b in pairs], pa.int64())], ["u", "v"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.union(a, b)
        if len(forest.parent) > CONTRACT_EDGES:
            yield edge_batch(forest.stars())
            forest = Forest()
    yield edge_batch(forest.stars())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v -> one star step, u > v again."""
    if large:  # every node: its larger neighbours move to its smallest neighbour (or itself)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # every node: it and its smaller neighbours move to its smallest neighbour
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("centre"), F.least("u", "m").alias("m"))
    joined = both.join(least, both["u"] == least["centre"])
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("centre").alias("u"), F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Undirected edges (u, v) -> (node, root) of every node that is not the
    smallest of its component; roots themselves are not listed."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    edges = scratch_table(edges.mapInArrow(_contract, _EDGE).distinct(), "cc-0")

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    for i in range(1, max_rounds + 1):
        if not before[0]:
            break
        edges = scratch_table(_star(_star(edges, True), False), f"cc-{i}")
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
