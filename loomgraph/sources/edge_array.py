"""The edge array that the nodes' ranges point into, in files that cover ranges of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ids import with_dense_id
from .shared import discard


def write_edge_array(adj: DataFrame, path: str) -> None:
    """``adj`` (src, dst, weight) as an array in the order of (src, dst): each edge with its position.
    Edges are range-partitioned and sorted once, so that a node with very many edges lies in
    several files; a position is the place in the range plus the edges of the ranges before.
    ``path/index`` says which positions and nodes each file holds."""
    owned: list[DataFrame] = []
    numbered = with_dense_id(adj.select("src", "dst", "weight"), ["src", "dst"], "position", owned)
    numbered.write.parquet(f"{path}/edges")
    discard(*owned)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")
    back = adj.sparkSession.read.parquet(f"{path}/edges").select("src", "position", name)
    ends = [f(c).alias(n) for c, f, n in (("position", F.min, "first"), ("position", F.max, "last"), ("src", F.min, "first_src"), ("src", F.max, "last_src"))]
    back.groupBy("file").agg(*ends, F.count("*").alias("n")).write.parquet(f"{path}/index")


def read_edge_array(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight, position) of all edges."""
    return spark.read.parquet(f"{path}/edges")


def read_edge_range(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """The edges at positions ``start`` .. ``end`` - 1: of one node, if it is a node's range. Only files
    that the index names are opened, and in them only row groups that overlap."""
    index = spark.read.parquet(f"{path}/index").where((F.col("first") < end) & (F.col("last") >= start))
    files = [f"{path}/edges/{r.file}" for r in index.select("file").collect()]
    there = spark.read.parquet(*files) if files else read_edge_array(spark, path).limit(0)
    return there.where((F.col("position") >= start) & (F.col("position") < end))
