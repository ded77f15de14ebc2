"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truthloom.plans.workspace import Workspace


class Union:
    """Union-find over hashable keys; the smallest key of a group is its name."""

    def __init__(self):
        self.up: dict = {}

    def find(self, key):
        up = self.up
        root = key
        while (above := up.get(root, root)) != root:
            root = above
        while key != root:
            up[key], key = root, up.get(key, key)
        return root

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning star forest of the edges of each batch."""
    for batch in batches:
        union = Union()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            union.join(a, b)
        nodes = list(union.up)
        names = batch.schema.names
        kind = batch.schema.field(0).type
        roots = [union.find(n) for n in nodes]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(roots, kind)], names)


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its least node.

    Each round shortens all paths; the number of rounds grows with the logarithm of the longest.
    Rounds are tables in the shared folder, so a lost executor repeats one round at most.
    """
    schema = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).schema
    now = work.keep(edges.select("a", "b").where("a <> b").mapInArrow(_contract, schema).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = work.keep(small, "edges")
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
