"""Lists of any length in blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .carry import with_group_sums

#: Members of a block.
BLOCK = 1024


def block_lists(rows: DataFrame, keys: list[str], member: str, name: str, size: int = BLOCK, owned: list[DataFrame] | None = None) -> DataFrame:
    """(keys, block, n, ``name``): the members of each key in ascending order, in blocks of
    ``size``, numbered from 0; the last may have fewer. Members are numbered where they lie
    in sorted range partitions, so that a hot key is many tasks' work, and only a block's
    members meet. Null members come first."""
    d = with_group_sums(rows.select(*keys, member), keys, [member], {"_place": F.lit(1)}, owned)
    d = d.withColumn("block", F.floor((F.col("_place") - 1) / size).cast("long"))
    held = F.sort_array(F.collect_list(F.struct("_place", F.col(member).alias("m"))))  # at most a block
    return d.groupBy(*keys, "block").agg(F.count("*").alias("n"), held.alias("_held")).select(*keys, "block", "n", F.col("_held.m").alias(name))
