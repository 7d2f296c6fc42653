"""Synthetic graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .style import init_positions


def gen_pair(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Two nodes and the edge between them."""
    return gen_pairs(spark.range(1), "id")


def gen_pairs(ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """For each id k two nodes, 2 k and 2 k + 1, of mass 2, and the edge between them."""
    k = F.col(key).cast("long")
    ends = F.explode(F.array(*[F.struct((2 * k + side).alias("node_id"), F.lit(kind).alias("kind")) for side, kind in ((0, "account"), (1, "hashtag"))]))
    nodes = ids.select(ends.alias("e")).select("e.*", F.lit(2.0).alias("mass"))
    return init_positions(nodes), ids.select((2 * k).alias("src"), (2 * k + 1).alias("dst"), F.lit(1).cast("long").alias("weight"))


def gen_blocks(
    spark: SparkSession,
    red: Sequence[int] = (1000, 1000, 1000),
    black: Sequence[int] = (500, 500),
    links: Sequence[tuple[int, int]] = ((0, 0), (1, 1), (2, 0), (2, 1)),
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of groups of red and black nodes; linked groups are fully joined.
    Edges come from ranges and arithmetic, without a join."""
    starts, at, nodes, edges = {}, 0, None, None
    for kind, sizes in (("red", red), ("black", black)):
        for g, n in enumerate(sizes):
            starts[kind, g] = at
            seen = [b for r, b in links if r == g] if kind == "red" else [r for r, b in links if b == g]
            mass = 1 + sum((black if kind == "red" else red)[k] for k in seen)
            part = spark.range(at, at + n).select(F.col("id").alias("node_id"), F.lit(kind).alias("kind"), F.lit(g).alias("grp"), F.lit(float(mass)).alias("mass"))
            nodes = part if nodes is None else nodes.union(part)
            at += n
    for r, b in links:
        n = black[b]
        part = spark.range(red[r] * n).select(
            (F.floor(F.col("id") / n) + starts["red", r]).cast("long").alias("src"), (F.col("id") % n + starts["black", b]).alias("dst"), F.lit(1).cast("long").alias("weight")
        )
        edges = part if edges is None else edges.union(part)
    return nodes, edges


def gen_cloud(spark: SparkSession, n: int = 4_000_000, seed: int = 1) -> DataFrame:
    """Nodes of mass 1 without edges, in a square of half-width 40."""
    nodes = spark.range(n).select(F.col("id").alias("node_id"), F.lit("hashtag").alias("kind"), F.lit(1.0).alias("mass"))
    return init_positions(nodes, seed)
