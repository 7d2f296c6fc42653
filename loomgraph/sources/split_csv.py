"""Quoted CSV files read by many tasks each.

A line break may stand inside quotes, so where a record begins depends on all quotes before
it in its file. Spark's text source deals a file out in byte ranges. First the quotes of each
range are counted: their parity, summed over the ranges before, says whether a range begins
inside quotes. Then each range cuts its lines into records by itself. What it has before its
first record's begin, or after its last one's, belongs to a record that crosses the border
to another range; these fragments, at most two a range, are joined. Records are parsed by
Spark's own CSV parser.

Defined cases: quotes in a field are doubled; a quote inside an unquoted field is not CSV and
counts as one; blank lines are no records; a file's first record is its header and goes; a
quote that never closes makes the rest of its file one record.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
_RECORDS = "file string, block bigint, seq bigint, record string, begins boolean, ends boolean"
_NAMES = [x.split()[0] for x in _RECORDS.split(", ")]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, pa.Array]]:
    """((file, block), state, lines) of each run of lines of one range."""
    lines, files, blocks, states = (batch.column(k) for k in range(4))
    n = batch.num_rows
    other = pc.not_equal(files.slice(1), files.slice(0, n - 1)).to_numpy(zero_copy_only=False) | (np.diff(blocks.to_numpy()) != 0)
    cuts = [0, *(np.flatnonzero(other) + 1).tolist(), n]
    for lo, hi in pairwise(cuts):
        yield (files[lo].as_py(), blocks[lo].as_py()), states[lo].as_py(), lines.slice(lo, hi - lo)


def _cut(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Records of each range, in order, cut by array operations: with ``whole`` those that lie
    inside it, else what crosses its borders."""
    at: tuple[str, int] | None = None
    held: list[str] = []
    inside, begins, seq = 0, True, 0

    def rows(first: int, records: pa.Array, begin: bool, end: bool) -> pa.RecordBatch:
        n = len(records)
        columns = [pa.repeat(at[0], n), pa.repeat(at[1], n), pa.array(np.arange(first, first + n)), records, pa.repeat(begin, n), pa.repeat(end, n)]
        return pa.RecordBatch.from_arrays(columns, names=_NAMES)

    def left() -> Iterator[pa.RecordBatch]:
        if held and not whole:
            yield rows(seq, pa.array(["\n".join(held)]), begins, False)
        held.clear()

    for b in batches:
        if not b.num_rows:
            continue
        for key, state, lines in _runs(b):
            if key != at:
                yield from left()
                at, inside, seq = key, state, 0
                begins = not inside
            odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) & 1
            after = (inside + np.cumsum(odd)) & 1
            inside = int(after[-1])
            ends = np.flatnonzero(after == 0) + 1
            if not len(ends):
                held.extend(lines.to_pylist())
                continue
            # The first record ends what is held; the others begin and end here.
            first = "\n".join([*held, *lines.slice(0, int(ends[0])).to_pylist()])
            held.clear()
            if begins == whole:
                yield rows(seq, pa.array([first]), begins, True)
            if whole and len(ends) > 1:
                lo, hi = int(ends[0]), int(ends[-1])
                lists = pa.ListArray.from_arrays(pa.array((ends - lo).astype(np.int32)), lines.slice(lo, hi - lo))
                yield rows(seq + 1, pc.binary_join(lists, "\n"), True, True)
            begins, seq = True, seq + len(ends)
            held.extend(lines.slice(int(ends[-1])).to_pylist())
    yield from left()


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, record) of all records but headers; positions ascend within a file."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    parity = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = F.sum("odd").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    states = parity.select("file", "block", (F.coalesce(before, F.lit(0)) % 2).cast("int").alias("state"))
    dealt = lines.join(F.broadcast(states), ["file", "block"]).select("value", "file", "block", "state")
    # At most two fragments a range; a chain of them is one record.
    broken = dealt.mapInArrow(partial(_cut, whole=False), _RECORDS)
    chain = F.sum(F.col("begins").cast("int")).over(Window.partitionBy("file").orderBy("block", "seq"))
    joined = broken.withColumn("chain", chain).groupBy("file", "chain").agg(F.sort_array(F.collect_list(F.struct("block", "seq", "record"))).alias("parts"))
    joined = joined.select("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["seq"].alias("seq"), F.array_join(F.col("parts.record"), "\n").alias("record"))
    # Every record has a byte at least, so a range's begin and the place in it tell records apart.
    whole = dealt.mapInArrow(partial(_cut, whole=True), _RECORDS).select("file", "block", "seq", "record").union(joined)
    whole = whole.where("NOT (block = 0 AND seq = 0)").withColumn("record", F.regexp_replace("record", "\r$", ""))
    return whole.where("record <> ''").select("file", (F.col("block") + F.col("seq")).alias("position"), "record")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, and (_file, _position) of each record."""
    parsed = records(spark, path).select("file", "position", F.from_csv("record", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), _OPTIONS).alias("r"))
    return parsed.select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema], F.col("file").alias("_file"), F.col("position").alias("_position"))
