"""What a row needs from the rows before it, over a whole table in order.

Rows are range-partitioned and sorted once. An Arrow pass works within each partition and
marks what is still open: the first row, or the rows of the first group. One small row for
each partition says how it ends; carried forward over the partitions, empty ones passed by,
these rows close what is open. No window spans the table, no table meets itself, no dense
ids are made. What is broadcast has one row for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written

BATCH = pa.RecordBatch


def sorted_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in range partitions, each sorted, with the number ``_p`` of its partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())


def held_back(batches: Iterator[BATCH]) -> Iterator[tuple[BATCH, bool]]:
    """Batches with rows, and whether each is the last."""
    held = None
    for batch in batches:
        if batch.num_rows:
            if held is not None:
                yield held, False
            held = batch
    if held is not None:
        yield held, True


def _marks(n: int, first: bool, last: bool) -> tuple[pa.Array, pa.Array]:
    head, tail = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    head[0], tail[-1] = first, last
    return pa.array(head), pa.array(tail)


def with_before(df: DataFrame, order: list[str], columns: dict[str, str], owned: list[DataFrame] | None = None) -> DataFrame:
    """``df`` with the values that the row before, in the order of ``order``, has in some columns:
    ``columns`` gives the new name of each. The first row of the table gets nulls. Rows equal
    in ``order`` come in any order. The written table behind the result is added to ``owned``,
    for the caller to discard."""
    d = sorted_ranges(df, order)
    fields = [T.StructField(new, d.schema[old].dataType) for old, new in columns.items()]

    def shift(batches: Iterator[BATCH]) -> Iterator[BATCH]:
        before: list[pa.Array] | None = None
        for batch, last in held_back(batches):
            own = [batch.column(c) for c in columns]
            one = [pa.nulls(1, a.type) for a in own] if before is None else before
            moved = [pa.concat_arrays([x, a.slice(0, len(a) - 1)]) for x, a in zip(one, own, strict=True)]
            marks = _marks(batch.num_rows, before is None, last)
            yield pa.RecordBatch.from_arrays([*batch.columns, *moved, *marks], names=[*batch.schema.names, *columns.values(), "_head", "_tail"])
            before = [a.slice(len(a) - 1, 1) for a in own]

    flags = [T.StructField("_head", T.BooleanType()), T.StructField("_tail", T.BooleanType())]
    d = written(d.mapInArrow(shift, T.StructType([*d.schema.fields, *fields, *flags])), "before")
    if owned is not None:
        owned.append(d)
    ends = d.where("_tail").select("_p", *[F.col(old).alias(f"_end_{k}") for k, old in enumerate(columns)])
    by = Window.orderBy("_p")
    carry = ends.select("_p", *[F.lag(f"_end_{k}").over(by).alias(f"_end_{k}") for k in range(len(columns))])
    d = d.join(F.broadcast(carry), "_p")
    new = {name: F.when(F.col("_head"), F.col(f"_end_{k}")).otherwise(F.col(name)) for k, name in enumerate(columns.values())}
    return d.withColumns(new).drop("_p", "_head", "_tail", *[f"_end_{k}" for k in range(len(columns))])


def _changes(columns: list[pa.Array], before: list[pa.Array] | None) -> np.ndarray:
    """Whether each row's group differs from that of the row before; null equals null."""
    out = np.zeros(len(columns[0]), dtype=bool)
    for k, a in enumerate(columns):
        first = pa.nulls(1, a.type) if before is None else before[k]
        b = pa.concat_arrays([first, a.slice(0, len(a) - 1)])
        differ = pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.xor(pc.is_null(a), pc.is_null(b)), pc.fill_null(pc.not_equal(a, b), False))
        out |= differ.to_numpy(zero_copy_only=False)
    if before is None:
        out[0] = True
    return out


def with_group_sums(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], owned: list[DataFrame] | None = None) -> DataFrame:
    """``df`` with running sums within each group of equal ``group`` columns, in the order of
    ``order``, the row itself included. A group may span any number of partitions; its parts
    are summed where they are. The sums must fit in a bigint. ``owned`` as in with_before."""
    names = list(sums)
    d = sorted_ranges(df.withColumns({f"_v{k}": c.cast("long") for k, c in enumerate(sums.values())}), [*group, *order])
    values = [f"_v{k}" for k in range(len(names))]

    def run(batches: Iterator[BATCH]) -> Iterator[BATCH]:
        before, still, total = None, True, np.zeros(len(names), dtype=np.int64)
        for batch, last in held_back(batches):
            keys = [batch.column(c) for c in group]
            new, n = _changes(keys, before), batch.num_rows
            starts = np.flatnonzero(new)
            head = np.zeros(n, dtype=bool)
            if still:  # the partition's first group, which may have begun before
                second = starts[1] if before is None and len(starts) > 1 else starts[0] if before is not None and len(starts) else n
                head[:second] = True
                still = second == n
            owner = np.cumsum(new)
            found = []
            for k, c in enumerate(values):
                run_ = np.cumsum(batch.column(c).fill_null(0).to_numpy())
                base = np.concatenate([[-total[k]], run_[starts] - batch.column(c).fill_null(0).to_numpy()[starts]])
                found.append(run_ - base[owner])
            total = np.array([x[-1] for x in found], dtype=np.int64)
            before = [a.slice(n - 1, 1) for a in keys]
            kept = [batch.column(c) for c in batch.schema.names if c not in values]
            yield pa.RecordBatch.from_arrays(
                [*kept, *[pa.array(x) for x in found], pa.array(head), _marks(n, False, last)[1]],
                names=[*[c for c in batch.schema.names if c not in values], *names, "_head", "_tail"],
            )

    fields = [f for f in d.schema.fields if f.name not in values]
    new = [T.StructField(x, T.LongType()) for x in names] + [T.StructField("_head", T.BooleanType()), T.StructField("_tail", T.BooleanType())]
    d = written(d.mapInArrow(run, T.StructType([*fields, *new])), "group-sums")
    if owned is not None:
        owned.append(d)
    # What each partition's last group has there, and what each partition's first group asks for.
    keys = [F.col(c).alias(f"_k{k}") for k, c in enumerate(group)]
    gives = d.where("_tail").select("_p", *keys, F.lit(1).alias("_kind"), *[F.col(x).alias(f"_s{k}") for k, x in enumerate(names)])
    firsts = d.where("_head").groupBy("_p").agg(*[F.first(c).alias(f"_k{k}") for k, c in enumerate(group)])
    asks = firsts.select("_p", *[f"_k{k}" for k in range(len(group))], F.lit(0).alias("_kind"), *[F.lit(0).cast("long").alias(f"_s{k}") for k in range(len(names))])
    by = Window.partitionBy(*[f"_k{k}" for k in range(len(group))]).orderBy("_p", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = gives.union(asks).select("_p", "_kind", *[F.sum(f"_s{k}").over(by).alias(f"_s{k}") for k in range(len(names))]).where("_kind = 0").drop("_kind")
    d = d.join(F.broadcast(carry), "_p")
    closed = {x: F.col(x) + F.when(F.col("_head"), F.col(f"_s{k}")).otherwise(0) for k, x in enumerate(names)}
    return d.withColumns(closed).drop("_p", "_head", "_tail", *[f"_s{k}" for k in range(len(names))])
