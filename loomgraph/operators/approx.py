"""Repulsion approximated by a mass tree and an opening angle."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, written
from .forces import repulsion_exact
from .radix import KEY_BITS, slab_tree
from .spatial import prefix_groups, radix_tree, with_morton

#: The opening angle.
THETA = 0.1
#: Points of a tree that is broadcast, or inner nodes that divide a larger one: 80 bytes each.
TOP = 200_000
#: Points of a group of neighbours at most, if their keys differ.
GROUP = 1 << 14
#: Points walked at a time, pairs of points at a time, and points of one group that one task walks.
CHUNK, PAIRS, OPENERS = 256, 1 << 21, 50_000
#: Groups whose boxes are tried together; rows that are sent at a time.
_BOXES, _OUT = 32, 20_000


@dataclass
class MassTree:
    """A tree, or what a group of points may visit of it, as arrays. A child is a number: below
    ``len(cx)`` an inner node, then a bucket of points, then what is not at hand."""

    cx: np.ndarray
    cy: np.ndarray
    mass: np.ndarray
    size: np.ndarray
    child: np.ndarray
    #: Where a walk begins: what is below the root.
    below: np.ndarray
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.empty(0))
    points: np.ndarray = field(default_factory=lambda: np.empty((0, 3)))


def whole_tree(keys: np.ndarray, ids: np.ndarray, points: np.ndarray) -> MassTree:
    """The tree of points (x, y, mass) with their keys."""
    by = np.argsort(keys, kind="stable")
    keys, ids, points = keys[by], ids[by], points[by]
    own, first = np.unique(keys, return_index=True)
    bounds = np.append(first, len(keys))
    mass = points[:, 2]
    rows = np.column_stack([np.ones(len(keys)), mass, mass * points[:, 0], mass * points[:, 1]])
    sums = np.add.reduceat(rows, first, axis=0) if len(own) else np.empty((0, 4))
    nodes, at = slab_tree(own, sums)
    n = len(nodes["level"])
    name = (nodes["level"] << 33) + nodes["prefix"]
    order = np.argsort(name)

    def number(side: str, alone: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        want = (nodes[f"{side}_level"] << 33) + nodes[f"{side}_prefix"]
        found = order[np.minimum(np.searchsorted(name, want, sorter=order), max(n - 1, 0))] if n else want
        return np.where(alone, n + bucket, found)

    child = np.column_stack([number("left", at["mid"] - at["lo"] == 1, at["lo"]), number("right", at["hi"] - at["mid"] == 1, at["mid"])])
    top = np.flatnonzero((at["lo"] == 0) & (at["hi"] == len(own))) if n else np.full(min(len(own), 1), n)
    below = child[top[0]] if n else top
    return MassTree(nodes["mx"] / nodes["mass"], nodes["my"] / nodes["mass"], nodes["mass"], nodes["size"], child, below, bounds, ids, points)


def _names(level, prefix):
    """One number for a node, of columns or arrays; buckets have the level of whole keys."""
    return level * (1 << 33) + prefix


def part_of_tree(inner: pa.Table, members: pa.Table, start: list[int]) -> MassTree:
    """The tree of inner nodes and points with their names; a walk begins at ``start``."""
    column = lambda t, c: t[c].combine_chunks().to_numpy(zero_copy_only=False)
    name = column(inner, "name")
    order = np.argsort(name)
    name, key = name[order], column(members, "name")
    by = np.argsort(key, kind="stable")
    own, first = np.unique(key[by], return_index=True)

    def number(want: np.ndarray) -> np.ndarray:
        here, there = np.searchsorted(name, want), np.searchsorted(own, want)
        is_here = np.append(name, -1)[here] == want
        return np.where(is_here, here, len(name) + np.where(np.append(own, -1)[there] == want, there, len(own)))

    child = number(np.column_stack([column(inner, c)[order] for c in ("left", "right")]).astype(np.int64))
    ids, points = _points(members)
    values = [column(inner, c)[order] for c in ("x", "y", "mass", "size")]
    return MassTree(*values, child, number(np.array(start, dtype=np.int64)), np.append(first, len(key)), ids[by], points[by])


def walk(tree: MassTree, start: np.ndarray, ids: np.ndarray, points: np.ndarray, strength: float, soft: float, theta: float) -> np.ndarray:
    """Force (two rows) on each of ``points`` (x, y, mass). All points descend together, one level
    of the tree a round: a node either counts as a whole, if theta times the softened
    distance exceeds its size, or opens."""
    force, n, buckets = np.zeros((2, len(points))), len(tree.cx), len(tree.bounds) - 1
    p, c = np.repeat(np.arange(len(points)), len(start)), np.tile(start, len(points))
    px, py = points[:, 0].copy(), points[:, 1].copy()

    def push(p: np.ndarray, dx: np.ndarray, dy: np.ndarray, mass: np.ndarray, near: np.ndarray) -> None:
        w = strength * points[p, 2] * mass / near
        force[0] += np.bincount(p, w * dx, len(points))
        force[1] += np.bincount(p, w * dy, len(points))

    while len(p):
        at = c >= n
        in_bucket, b = p[at], c[at] - n
        if len(b) and b.max() >= buckets:
            raise ValueError("a point opened a node whose children are not at hand")
        sizes = tree.bounds[b + 1] - tree.bounds[b]
        ends = np.cumsum(sizes)
        lo = 0
        while lo < len(b):  # a bucket counts point by point, without the point itself
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
            k = sizes[lo:hi]
            q = np.repeat(in_bucket[lo:hi], k)
            j = np.arange(len(q)) + np.repeat(tree.bounds[b[lo:hi]] - (np.cumsum(k) - k), k)
            other = ids[q] != tree.ids[j]
            q, j = q[other], j[other]
            dx, dy = px[q] - tree.points[j, 0], py[q] - tree.points[j, 1]
            push(q, dx, dy, tree.points[j, 2], dx * dx + dy * dy + soft)
            lo = hi
        p, c = p[~at], c[~at]
        dx, dy = px[p] - tree.cx[c], py[p] - tree.cy[c]
        near = dx * dx + dy * dy + soft
        far = theta * np.sqrt(near) > tree.size[c]
        push(p[far], dx[far], dy[far], tree.mass[c[far]], near[far])
        p, c = np.repeat(p[~far], 2), tree.child[c[~far]].ravel()
    return force


def _points(table) -> tuple[np.ndarray, np.ndarray]:
    column = lambda c: table[c].combine_chunks() if isinstance(table, pa.Table) else table.column(c)
    points = np.column_stack([column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "mass")])
    return column("node_id").to_numpy(zero_copy_only=False), points.astype(float).reshape(-1, 3)


def _forces(tree: MassTree, table, *options: float) -> Iterator[pa.RecordBatch]:
    """(node_id, fx, fy) of the rows of a table or batch."""
    for lo in range(0, table.num_rows, CHUNK):
        ids, points = _points(part := table.slice(lo, CHUNK))
        force = walk(tree, tree.below, ids, points, *options)
        held = part["node_id"].combine_chunks() if isinstance(part, pa.Table) else part.column("node_id")
        yield pa.RecordBatch.from_arrays([held, pa.array(force[0]), pa.array(force[1])], names=["node_id", "fx", "fy"])


def _divided(tree: DataFrame, size: int, top: int) -> tuple[np.ndarray, pa.Table]:
    """Least possible keys of the largest subtrees of at most 2^k points, k by ``size`` but so large
    that at most ``top`` nodes are above them, and the nodes above."""
    counts = tree.agg(*[F.count_if(F.col("n") > (1 << k)).alias(str(k)) for k in range(48)]).first()
    most = max(next(k for k in range(48) if counts[k] <= top), max(size, 1).bit_length() - 1)
    most = min(most, max((k for k in range(48) if counts[k]), default=0))  # the root at least
    rows = tree.where(F.col("n") > (1 << most)).toArrow()
    get = {c: rows[c].combine_chunks().cast(pa.int64()).to_numpy() for c in ("level", "prefix", "left_level", "left_prefix", "right_level", "right_prefix")}
    levels, prefixes = (np.concatenate([get[f"left_{c}"], get[f"right_{c}"]]) for c in ("level", "prefix"))
    below = ~np.isin(_names(levels, prefixes), _names(get["level"], get["prefix"]))
    return np.sort((prefixes << (KEY_BITS - levels))[below]), rows


def repulsion_approx(nodes: DataFrame, strength: float = 1.0, soft: float = 0.0025, theta: float = THETA, top: int = TOP) -> DataFrame:
    """(node_id, fx, fy). Up to ``top`` points the whole tree is broadcast as arrays, and every task
    walks its points down it: no join. Beyond, the points of a subtree are a group, and a group
    is sent, once, the nodes and points that any place in its box may visit; its task walks
    all points of the group down those. The result is a written table; what it was made
    from is deleted. Nodes without a mass push nothing and aren't pushed; nodes without a
    position are left out."""
    nodes = nodes.where("x IS NOT NULL AND y IS NOT NULL").select("node_id", "x", "y", F.coalesce("mass", F.lit(0.0)).cast("double").alias("mass"))
    keyed = written(with_morton(nodes.where("mass > 0")), "approx-nodes")
    sc, n = keyed.sparkSession.sparkContext, keyed.count()
    used, options = [keyed], (strength, soft, theta)
    schema = f"node_id {keyed.schema['node_id'].dataType.simpleString()}, fx double, fy double"
    if n <= top:
        table = keyed.toArrow()
        shared = sc.broadcast(whole_tree(table["morton"].combine_chunks().to_numpy(), *_points(table)))

        def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _forces(shared.value, batch, *options)

        # By the number of points, not by bytes: rows are small and their work is not.
        tasks = max(1, min(math.ceil(n / CHUNK), 8 * sc.defaultParallelism))
        walked = keyed.repartition(tasks).mapInArrow(descend, schema)
    else:
        tree = radix_tree(prefix_groups(keyed), owned=used)
        cuts, upper = _divided(tree, min(GROUP, n // (4 * sc.defaultParallelism)), top)
        shared = sc.broadcast(cuts)
        if len(cuts):
            walked = _by_groups(keyed, tree, shared, upper, options, schema)
        else:  # one key: a bucket counts point by point
            walked = repulsion_exact(keyed, strength, soft)
            used.append(walked)
    walked = written(walked, "approx-walked")
    used.append(walked)
    total = nodes.select("node_id", F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy")).union(walked)
    out = written(total.groupBy("node_id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy")), "approx-force")
    discard(*used)
    shared.destroy()
    return out


@dataclass
class Boxes:
    """Boxes (least x, greatest x, least y, greatest y) of the groups, a row each, in the order of their
    keys, and boxes around every ``_BOXES`` of them. A group has ``tasks`` tasks from ``first`` on."""

    each: np.ndarray
    first: np.ndarray
    tasks: np.ndarray

    def __post_init__(self) -> None:
        by = range(0, len(self.each), _BOXES)
        self.around = np.array([[b[:, 0].min(), b[:, 1].max(), b[:, 2].min(), b[:, 3].max()] for b in (self.each[k : k + _BOXES] for k in by)])

    def visitors(self, x: np.ndarray, y: np.ndarray, size: np.ndarray, soft: float, theta: float) -> tuple[np.ndarray, np.ndarray]:
        """(node, task) for all nodes that a place in the box of the task's group may open."""

        def opens(k: np.ndarray, box: np.ndarray) -> np.ndarray:
            dx = np.maximum(np.maximum(box[..., 0] - x[k], x[k] - box[..., 1]), 0)
            dy = np.maximum(np.maximum(box[..., 2] - y[k], y[k] - box[..., 3]), 0)
            return theta * np.sqrt(dx * dx + dy * dy + soft) <= size[k] * (1 + 1e-9)  # more than rounding

        k, a = np.nonzero(opens(np.arange(len(x))[:, None], self.around[None]))
        k, g = np.repeat(k, _BOXES), (a[:, None] * _BOXES + np.arange(_BOXES)).ravel()
        k, g = k[g < len(self.each)], g[g < len(self.each)]
        has = opens(k, self.each[g])
        k, g = k[has], g[has]
        times = self.tasks[g]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(k, times), np.repeat(self.first[g], times) + place


def _by_groups(keyed: DataFrame, tree: DataFrame, cuts, upper: pa.Table, options: tuple[float, float, float], schema: str) -> DataFrame:
    """(node_id, fx, fy) of all points. Nodes and points meet their parents by one join; a group gets
    those whose parent it may open, and what is below the root."""
    kind = keyed.schema["node_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = np.searchsorted(cuts.value, batch.column("morton").to_numpy(), side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group)], names=[*batch.schema.names, "group"])

    placed = keyed.mapInArrow(place, f"node_id {kind}, x double, y double, mass double, morton bigint, group bigint")
    box = placed.groupBy("group").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    box = box.orderBy("group").toArrow()  # a row a group
    groups, n = (box[c].to_numpy() for c in ("group", "n"))
    tasks = -(-n // OPENERS)
    units = int(tasks.sum())
    boxes = Boxes(np.column_stack([box[c].to_numpy() for c in ("x0", "x1", "y0", "y1")]), np.cumsum(tasks) - tasks, tasks)
    top = int(np.argmin(upper["level"].to_numpy()))
    start = [int(_names(int(upper[f"{s}_level"][top].as_py()), int(upper[f"{s}_prefix"][top].as_py()))) for s in ("left", "right")]

    name = lambda s: _names(F.col(f"{s}level").cast("long"), F.col(f"{s}prefix"))
    inner = tree.select(F.lit(None).cast(kind).alias("node_id"), F.col("cx").alias("x"), F.col("cy").alias("y"), "mass", name("").alias("name"), "size", name("left_").alias("left"), name("right_").alias("right"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("size", "double"), ("left", "bigint"), ("right", "bigint"))]
    leaf = _names(F.lit(KEY_BITS).cast("long"), F.col("morton"))
    points = keyed.select("node_id", "x", "y", "mass", leaf.alias("name"), *none)
    parents = inner.select(F.explode(F.array("left", "right")).alias("name"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("size").alias("psize"))
    # All walks begin below the root, so all open it.
    parents = parents.withColumn("psize", F.when(F.col("name").isin(start), F.lit(float("inf"))).otherwise(F.col("psize")))
    rows = inner.union(points).join(parents, "name")
    sent = ["node_id", "x", "y", "mass", "name", "size", "left", "right"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                node, task = boxes.visitors(*[part.column(c).to_numpy() for c in ("px", "py", "psize")], *options[1:])
                for at in range(0, len(node), _OUT):
                    k = pa.array(node[at : at + _OUT])
                    yield pa.RecordBatch.from_arrays([pa.array(task[at : at + _OUT]), pa.array(np.zeros(len(k), bool)), *[part.column(c).take(k) for c in sent]], names=["task", "own", *sent])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = np.searchsorted(groups, batch.column("group").to_numpy())
            task = boxes.first[g] + batch.column("salt").to_numpy() % tasks[g]
            full = {"task": pa.array(task), "own": pa.array(np.ones(len(g), bool))} | {c: batch.column(c) for c in ("node_id", "x", "y", "mass")}
            empty = {"name": pa.int64(), "size": pa.float64(), "left": pa.int64(), "right": pa.int64()}
            full |= {c: pa.nulls(len(g), t) for c, t in empty.items()}
            yield pa.RecordBatch.from_arrays(list(full.values()), names=list(full))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        held.clear()
        own, is_inner = table["own"], pc.is_valid(table["size"])
        part = part_of_tree(table.filter(is_inner), table.filter(pc.and_not(pc.invert(own), is_inner)), start)
        yield from _forces(part, table.filter(own), *options)

    out = f"task bigint, own boolean, node_id {kind}, x double, y double, mass double, name bigint, size double, left bigint, right bigint"
    own = placed.withColumn("salt", F.pmod(F.xxhash64("node_id"), F.lit(1 << 31))).mapInArrow(deal, out)
    met = rows.mapInArrow(send, out).union(own)
    return met.repartitionById(units, F.col("task").cast("int")).mapInArrow(finish, schema)
