"""Connected components as a fixed point of two star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt


#: Edges that one task may solve (some 60 MB in Python).
SMALL = 1 << 18


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each pair with the least v of its u.

    The grouped side is dealt out once more before the join, so that both sides of the join come
    from plain exchanges and adaptive execution can split the partition of a hub.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(dealt(least), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _with_least(both).where("v > u")
    return found.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_least(down)
    kept = found.select("u", F.col("m").alias("v"))
    moved = found.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(moved).distinct()


def _signature(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()


def _solved(batches):
    """(node, component) of all edges (u, v) of one task, by union-find; a root is the least node of its tree."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up] if up in parent else up
        return x

    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(u), root(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if kind is not None:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "component"])


def connected_components(edges: DataFrame, small: int = 0) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: any ordered type); component is the least node.

    Null ends and loops are ignored: a node that has no other edge is not returned. No edges: no rows.
    Only two numbers a round reach the driver. Up to ``small`` different edges, a bounded number, are solved by one task in
    Python in place of rounds of many tasks each; the result is the same.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _signature(edges)
    if 0 < before[0] <= small:
        kind = edges.schema["u"].dataType.simpleString()
        return cut(edges.coalesce(1).mapInArrow(_solved, f"node {kind}, component {kind}"))
    while before[0]:
        edges = cut(_small_star(_large_star(edges)))
        now = _signature(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
