"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node it reaches.

    ``edges`` has two bigint columns u and v. Every half round rewires each node's edges to
    its least neighbour; only per-node minima are aggregated, with partial sums, and each
    table is written, so joins on a node with very many edges can be split. Two numbers a
    round reach the driver.
    """
    e = F.col
    current = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges"
    )
    before = None
    for _ in range(max_rounds):
        # Large star: neighbours greater than u move to u's least neighbour (or u).
        both = current.select("u", "v").union(current.select(e("v").alias("u"), e("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")), "cc-large")
        up = current.select(e("v").alias("u"), e("u").alias("v")).join(least, "u")
        large = materialize(
            up.select(e("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct(), "cc-large-edges"
        )
        # Small star: u and its lesser neighbours move to the least of them.
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-small")
        moved = large.join(low, "u").where("v <> m").select(e("v").alias("u"), e("m").alias("v"))
        after = materialize(moved.union(low.select("u", e("m").alias("v"))).distinct(), "cc-edges")
        discard(current, least, large, low)
        current = after
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return current.select(e("u").alias("node"), e("v").alias("root")).union(
        current.select(e("v").alias("node"), e("v").alias("root")).distinct()
    )
