"""Dense ids and running sums over a whole table, without a single-partition window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written


def _added(d: DataFrame, name: str) -> DataFrame:
    """The written table ``d`` with ``name``: _c, a number within the row's partition _p, and the
    sum of _v over the partitions before. What is broadcast has one row for each partition."""
    sums = d.groupBy("_p").agg(F.sum("_v").alias("_s"))
    before = F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    return d.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_before") + F.col("_c")).drop("_v", "_p", "_c", "_before")


def _sorted(df: DataFrame, order: list[str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _owned(d: DataFrame, owned: list[DataFrame] | None) -> DataFrame:
    d = written(d, "ranged")
    if owned is not None:
        owned.append(d)
    return d


def with_running_sum(df: DataFrame, order: list[str], value: Column, name: str, owned: list[DataFrame] | None = None) -> DataFrame:
    """``name`` is the sum of ``value`` over the rows before, in the order of the columns
    ``order``, which should tell rows apart. Rows are range-partitioned and sorted once; each
    partition sums for itself in a stream, and the sums of the partitions before are added.
    The written table behind the result is added to ``owned``, for the caller to discard."""
    d = _sorted(df.withColumn("_v", value.cast("long")), order).withColumn("_p", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            v = b.column("_v").fill_null(0).to_numpy()
            ends = total + np.cumsum(v)
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - v)], names=[*b.schema.names, "_c"])

    d = d.mapInArrow(run, T.StructType([*d.schema.fields, T.StructField("_c", T.LongType())]))
    return _added(_owned(d, owned), name)


def with_dense_id(df: DataFrame, order: list[str], name: str, owned: list[DataFrame] | None = None) -> DataFrame:
    """Ids 0 .. n-1 in the order of the columns ``order``. Within a sorted partition the low bits
    of Spark's increasing ids are the place, so rows are numbered before they are written."""
    d = _sorted(df.withColumn("_v", F.lit(1).cast("long")), order).withColumn("_id", F.monotonically_increasing_id())
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    d = d.withColumns({"_p": F.shiftright("_id", 33), "_c": place}).drop("_id")
    return _added(_owned(d, owned), name)


def extend_ids(known: DataFrame, batch: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """(key, ``name``): the ids ``known`` and, after its largest, ids of the keys that are new in
    ``batch``, in the order of their first rows by ``order``. Ids never change, and are as if
    all batches had been numbered as one in their order. Null keys get none. Only new keys
    are sorted; ``known`` is hashed once for the anti-join, or not at all if it is small."""
    known = known.select(key, name)
    seen = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    fresh = seen.join(known, key, "left_anti").select(key, *[F.col(f"_first.{c}").alias(f"_o{k}") for k, c in enumerate(order)])
    start = known.agg(F.max(name)).first()[0]
    numbered = with_dense_id(fresh, [*[f"_o{k}" for k in range(len(order))], key], "_new")
    return known.union(numbered.select(key, (F.col("_new") + F.lit(0 if start is None else start + 1)).cast(known.schema[name].dataType).alias(name)))
