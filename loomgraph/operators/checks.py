"""Sorting with payload and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .carry import with_before


def sort_pairs(df: DataFrame, key: str, payload: str) -> DataFrame:
    return df.select(key, payload).orderBy(key, payload)


def count_inversions(df: DataFrame, order: list[str], key: str, owned: list[DataFrame] | None = None) -> DataFrame:
    """One row: how often a row's key is less than that of the row before, in ``order``."""
    near = with_before(df.select(*dict.fromkeys([*order, key])), order, {key: "_before"}, owned)
    return near.agg(F.count_if(F.col(key) < F.col("_before")).alias("inversions"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def tree_integrity(groups: DataFrame, tree: DataFrame, children: DataFrame) -> DataFrame:
    """(level, prefix, n_refs) of tree nodes that break the rule: every node but the root and
    every leaf is a child once, the root never."""
    all_ = tree.select("level", "prefix").union(groups.where("level = 32").select("level", "prefix"))
    refs = children.groupBy(F.col("child_level").alias("level"), F.col("child_prefix").alias("prefix")).agg(F.count("*").alias("n_refs"))
    root = tree.agg(F.min("level").alias("_root"))
    d = all_.join(refs, ["level", "prefix"], "left").withColumn("n_refs", F.coalesce("n_refs", F.lit(0))).join(F.broadcast(root))
    want = F.when(F.col("level") == F.col("_root"), 0).otherwise(1)
    return d.where(F.col("n_refs") != want).select("level", "prefix", "n_refs")
