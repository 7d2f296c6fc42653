"""Edges laid out once, so that no step of a layout moves them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import delete, discard, new_path, written

#: Edges of one end that share a bucket; an end with more is split.
HOT = 1 << 16


@dataclass
class LaidOut:
    """Edges (src, dst, weight, part) in a table bucketed and sorted by (dst, part): part tells the
    pieces of a dst with very many edges apart, and ``hot`` has (dst, parts) of those."""

    edges: DataFrame
    hot: DataFrame
    buckets: int
    names: list[tuple[str, str]]

    def placed(self, nodes: DataFrame) -> DataFrame:
        """(dst, part, x, y) of the nodes, bucketed as the edges are, so that the join of both needs
        no exchange; a hot node once for each part. The table before it is dropped."""
        d = nodes.select(F.col("node_id").alias("dst"), "x", "y").join(F.broadcast(self.hot), "dst", "left")
        d = d.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        while len(self.names) > 1:
            _drop(nodes, *self.names.pop())
        out, name = _bucketed(d, self.buckets, "placed")
        self.names.append(name)
        return out

    def drop(self) -> None:
        for name in self.names:
            _drop(self.edges, *name)
        self.names.clear()
        discard(self.hot)


def _drop(df: DataFrame, name: str, path: str) -> None:
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    delete(df.sparkSession, path)


def _bucketed(df: DataFrame, buckets: int, label: str) -> tuple[DataFrame, tuple[str, str]]:
    name, path = f"laid_{label}_{uuid.uuid4().hex}", new_path(df.sparkSession, label)
    dealt = df.repartition(buckets, "dst", "part").sortWithinPartitions("dst", "part")
    dealt.write.format("parquet").option("path", path).bucketBy(buckets, "dst", "part").sortBy("dst", "part").saveAsTable(name)
    return df.sparkSession.table(name), (name, path)


def lay_out(adj: DataFrame, hot: int = HOT, buckets: int | None = None) -> LaidOut:
    """``adj`` (src, dst, weight) written for many joins on dst: one shuffle, here, instead of one a
    step. The list of hot ends is short: no longer than the edges over ``hot``."""
    buckets = buckets or int(adj.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = adj.groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    many = written(many.select("dst", F.ceil(F.col("n") / hot).cast("int").alias("parts")), "hot-ends")
    d = adj.select("src", "dst", "weight").join(F.broadcast(many), "dst", "left")
    part = F.coalesce(F.pmod(F.xxhash64("src"), F.col("parts")), F.lit(0)).cast("int")
    edges, name = _bucketed(d.withColumn("part", part).drop("parts"), buckets, "edges")
    return LaidOut(edges, many, buckets, [name])
