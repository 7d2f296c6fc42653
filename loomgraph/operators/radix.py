"""The binary radix tree over sorted keys, built where the keys lie.

An inner node stands between two neighbouring keys: its prefix is what they share, and its
subtree is the range of keys with that prefix. A slab of sorted keys builds all nodes whose
range ends inside it from its own prefix sums. The ranges that touch a slab's first or last
key may go on elsewhere: for the prefixes along these two spines, at most 32 levels each,
the slab gives the sums of both halves, and equal prefixes of all slabs are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spatial import common_prefix
from ..sources.shared import written
from .carry import sorted_ranges

KEY_BITS = 32
#: Keys that a task holds at once.
SLAB = 1 << 20
SUMS = ["n", "mass", "mx", "my"]
IDS = ["left_level", "left_prefix", "right_level", "right_prefix"]
NODE = ["level", "prefix", "kmin", "kmax", *SUMS, *IDS, "size"]
_KINDS = {c: pa.int64() for c in ("level", "prefix", "kmin", "kmax", "n", *IDS)} | {c: pa.float64() for c in ("mass", "mx", "my", "size")} | {"spine": pa.bool_()}


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits that 32-bit keys share; all of them for equal keys."""
    return KEY_BITS - np.frexp((a ^ b).astype(np.float64))[1].astype(np.int64)


def centre_distance(sums: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Distance of the mass centres of rows (n, mass, mx, my)."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.hypot(part[:, 2] / part[:, 1] - sums[:, 2] / sums[:, 1], part[:, 3] / part[:, 1] - sums[:, 3] / sums[:, 1])


def slab_tree(keys: np.ndarray, sums: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Inner nodes of distinct sorted keys with their rows of sums, in the order of the key pairs
    they stand between, and the places (lo, mid, hi) of their halves."""
    total = np.concatenate([np.zeros((1, sums.shape[1]), np.longdouble), np.cumsum(sums, axis=0, dtype=np.longdouble)])
    between = np.arange(1, len(keys))
    level = shared_bits(keys[:-1], keys[1:])
    prefix = keys[:-1] >> (KEY_BITS - level)
    lo = np.searchsorted(keys, prefix << (KEY_BITS - level))
    hi = np.searchsorted(keys, (prefix + 1) << (KEY_BITS - level))
    left, right = (total[between] - total[lo]).astype(float), (total[hi] - total[between]).astype(float)
    both = left + right
    size = 2 * np.maximum(centre_distance(both, left), centre_distance(both, right)) if len(between) else np.empty(0)
    down = [shared_bits(keys[lo], keys[between - 1]), shared_bits(keys[between], keys[hi - 1])] if len(between) else [between, between]
    nodes = {"level": level, "prefix": prefix, "kmin": keys[lo], "kmax": keys[hi - 1]}
    nodes |= {c: both[:, k] for k, c in enumerate(SUMS)} | {"size": size}
    nodes |= {"left_level": down[0], "left_prefix": keys[lo] >> (KEY_BITS - down[0]), "right_level": down[1], "right_prefix": keys[hi - 1] >> (KEY_BITS - down[1])}
    return nodes, {"lo": lo, "mid": between, "hi": hi}


def _spines(keys: np.ndarray, sums: np.ndarray) -> dict[str, np.ndarray]:
    """Sums of both halves of every prefix of the first and of the last key."""
    total = np.concatenate([np.zeros((1, sums.shape[1]), np.longdouble), np.cumsum(sums, axis=0, dtype=np.longdouble)])
    levels = np.arange(1, KEY_BITS + 1)
    halves = {(int(n), int(k >> (KEY_BITS - n + 1)) * 2 + bit) for k in (keys[0], keys[-1]) for n in levels for bit in (0, 1)}
    level, prefix = np.array(sorted(halves), dtype=np.int64).T
    lo = np.searchsorted(keys, prefix << (KEY_BITS - level))
    hi = np.searchsorted(keys, (prefix + 1) << (KEY_BITS - level))
    has = hi > lo
    level, prefix, lo, hi = level[has], prefix[has], lo[has], hi[has]
    own = (total[hi] - total[lo]).astype(float)
    return {"level": level, "prefix": prefix, "kmin": keys[lo], "kmax": keys[hi - 1]} | {c: own[:, k] for k, c in enumerate(SUMS)}


def _rows(columns: dict[str, np.ndarray], spine: bool) -> pa.RecordBatch:
    n = len(columns["level"])
    full = columns | {"spine": np.full(n, spine)}
    arrays = [pa.array(full[c]).cast(t, safe=False) if c in full else pa.nulls(n, t) for c, t in _KINDS.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(_KINDS))


def _slabs(batches: Iterator[pa.RecordBatch], slab: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, slab):
            part = batch.slice(lo, slab)
            if n and n + part.num_rows > slab:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _id(low: str, high: str) -> tuple[Column, Column]:
    level = common_prefix(F.col(low), F.col(high)).cast("long")
    return level, F.call_function("shiftright", F.col(high), (KEY_BITS - level).cast("int"))


def tree_nodes(buckets: DataFrame, slab: int = SLAB, owned: list[DataFrame] | None = None) -> DataFrame:
    """(level, prefix, kmin, kmax, n, mass, mx, my, left and right level and prefix, size): the inner
    nodes over distinct keys, from rows (prefix, n, mass, mx, my). One range shuffle, one table
    written with about a row a key; only the spines are grouped. ``owned`` gets that table."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slabs(batches, slab):
            keys = table["prefix"].combine_chunks().to_numpy()
            sums = np.column_stack([table[c].combine_chunks().fill_null(0).to_numpy().astype(float) for c in SUMS])
            nodes, at = slab_tree(keys, sums)
            inside = (at["lo"] > 0) & (at["hi"] < len(keys))
            yield _rows({c: x[inside] for c, x in nodes.items()}, spine=False)
            yield _rows(_spines(keys, sums), spine=True)

    schema = ", ".join(f"{c} {'bigint' if t == pa.int64() else 'double' if t == pa.float64() else 'boolean'}" for c, t in _KINDS.items())
    parts = written(sorted_ranges(buckets.select("prefix", *SUMS), ["prefix"]).mapInArrow(build, schema), "tree-parts")
    if owned is not None:
        owned.append(parts)
    halves = parts.where("spine").groupBy("level", "prefix").agg(F.min("kmin").alias("kmin"), F.max("kmax").alias("kmax"), *[F.sum(c).alias(c) for c in SUMS])
    half = lambda bit: F.max(F.when(F.col("prefix") % 2 == bit, F.struct("kmin", "kmax", *SUMS)))
    met = halves.groupBy((F.col("level") - 1).alias("level"), F.call_function("shiftright", F.col("prefix"), F.lit(1)).alias("prefix")).agg(half(0).alias("l"), half(1).alias("r"))
    met = met.where("l IS NOT NULL AND r IS NOT NULL").withColumns({c: F.col(f"l.{c}") + F.col(f"r.{c}") for c in SUMS})
    ends = {"kmin": F.col("l.kmin"), "lmax": F.col("l.kmax"), "rmin": F.col("r.kmin"), "kmax": F.col("r.kmax")}
    met = met.withColumns(ends)
    away = lambda s: F.sqrt(sum(((F.col(f"{s}.{c}") / F.nullif(F.col(f"{s}.mass"), F.lit(0.0)) - F.col(c) / F.nullif(F.col("mass"), F.lit(0.0))) ** 2 for c in ("mx", "my")), F.lit(0.0)))
    (ll, lp), (rl, rp) = _id("kmin", "lmax"), _id("rmin", "kmax")
    stitched = met.withColumns({"left_level": ll, "left_prefix": lp, "right_level": rl, "right_prefix": rp, "size": 2 * F.greatest(away("l"), away("r"))})
    return parts.where("NOT spine").select(*NODE).union(stitched.select(*NODE))
