"""Forces of one layout step, the speed controller and the update of the nodes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fields import Grid, by_cells

#: Nodes of one side of a tile of the all-pairs kernel: at most about, and at least for a tile of its own.
BLOCK, LEAST = 1 << 20, 2048
#: Pairs that the kernel holds at a time, in a core's cache; rows that it sends at a time.
_CHUNK, OUT = (128, 384), 10_000
#: Nodes up to which all pairs are taken one by one, and rows of one id that need not be.
TILED, REPEATS = 1 << 16, 1000
#: Relative error of a softened square of a distance that a matrix product may bring.
_ROUNDING = 1e-10


@dataclass(frozen=True)
class Speed:
    """State of the controller."""

    speed: float = 1.0
    efficiency: float = 1.0
    jitter: float = 1.0
    max_jitter: float = 10.0


def attraction(nodes: DataFrame, adj: DataFrame, strength: float = 1.0, power: float = 1.0, there: DataFrame | None = None) -> DataFrame:
    """(node_id, fx, fy): weighted pull of the neighbours. Sums of w, w x and w y over
    neighbours need one join on dst and partial sums, then one join on the node itself.
    ``there``: the nodes as (dst, part, x, y), bucketed like edges that were laid out; then
    only the partial sums move."""
    w = F.pow(F.col("weight").cast("double"), F.lit(power)) if power != 1 else F.col("weight").cast("double")
    on = ["dst"] if there is None else ["dst", "part"]
    there = nodes.withColumnRenamed("node_id", "dst") if there is None else there
    there = there.select(*on, F.col("x").alias("_x"), F.col("y").alias("_y"))
    sums = adj.select("src", *on, w.alias("_w")).join(there, on).groupBy("src").agg(
        F.sum(F.col("_w") * F.col("_x")).alias("_wx"), F.sum(F.col("_w") * F.col("_y")).alias("_wy"), F.sum("_w").alias("_w")
    )
    d = nodes.select("node_id", "x", "y").join(sums, F.col("node_id") == F.col("src"), "left")
    pull = lambda s, p: strength * F.coalesce(F.col(s) - F.col(p) * F.col("_w"), F.lit(0.0))
    return d.select("node_id", pull("_wx", "x").alias("fx"), pull("_wy", "y").alias("fy"))


def gravity(nodes: DataFrame, strength: float = 1.0, strong: bool = True) -> DataFrame:
    """Pull to the origin by mass; the weak form doesn't grow with distance. Zero there."""
    by = F.col("mass") * strength
    if not strong:
        r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
        by = F.when(r > 0, by / r).otherwise(0.0)
    return nodes.select("node_id", (-F.col("x") * by).alias("fx"), (-F.col("y") * by).alias("fy"))


def _snake(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """An order in which each ``size`` points in a row lie near each other: strips by y, run through by x to and fro."""
    strip = np.argsort(np.argsort(y)) // int(math.sqrt(size * len(y)) + 1)
    return np.lexsort((np.where(strip % 2, -x, x), strip))


def _tile_forces(near: tuple[np.ndarray, ...], far: tuple[np.ndarray, ...] | None, soft: float) -> list[np.ndarray]:
    """Forces (two rows) that the nodes (code, x, y, m) of each side get from the other, by the inverse
    of the softened square of the distance; without ``far`` from all nodes of the side but those
    of one code. Neighbours are taken some at a time, with places counted from their middle:
    if they lie so close together that rounding can't matter, squares of distances are one
    matrix product, else all is made of differences. Memory is that of the sides and a small chunk."""
    rows, columns = _CHUNK
    order = _snake(near[1], near[2], rows)
    codes, x, y, m = (c[order] if len(c) else c for c in near)
    codes2, x2, y2, m2 = far or (codes, x, y, m)
    on, by = np.zeros((2, len(x))), np.zeros((2, len(x2)))
    w_ = np.empty(rows * columns)
    for a in range(0, len(x), rows):
        s = slice(a, min(a + rows, len(x)))
        cx, cy = x[s].mean(), y[s].mean()
        u, v, p, q = x[s] - cx, y[s] - cy, x2 - cx, y2 - cy
        r = u * u + v * v
        close = 8 * np.finfo(float).eps * r.max() <= _ROUNDING * soft
        left, right = np.column_stack([-2 * u, -2 * v, r + soft, np.ones(len(u))]), np.vstack([p, q, np.ones(len(p)), p * p + q * q])
        here, there = (m[s], m[s] * u, m[s] * v), (m2, m2 * p, m2 * q)
        sums, apart = np.zeros((3, len(u))), np.zeros((2, len(u)))
        for b in range(0, len(x2), columns):
            t = slice(b, min(b + columns, len(x2)))
            shape = (len(u), t.stop - b)
            w = w_[: shape[0] * shape[1]].reshape(shape)
            if close:
                np.matmul(left, right[:, t], out=w)
            else:
                dx, dy = x[s, None] - x2[t], y[s, None] - y2[t]
                np.add(dx * dx + dy * dy, soft, out=w)
            np.divide(1.0, w, out=w)
            if far is None:
                w[codes[s, None] == codes2[t]] = 0.0
            if not close:  # nothing counted from the middle: it may be far from all of them
                for k, d in enumerate((dx, dy)):
                    d *= w
                    apart[k] += d @ m2[t]
                    by[k, t] -= here[0] @ d
                continue
            if far is not None:
                back = here[0] @ w
                by[0, t] += p[t] * back - here[1] @ w
                by[1, t] += q[t] * back - here[2] @ w
            for k in range(3):
                sums[k] += w @ there[k][t]
        on[:, order[s]] = m[s] * (u * sums[0] - sums[1] + apart[0]), m[s] * (v * sums[0] - sums[2] + apart[1])
    return [on] if far is None else [on, by * m2]


def repulsion_exact(nodes: DataFrame, strength: float = 1.0, soft: float = 0.0025, block: int = BLOCK, tiled: int = TILED) -> DataFrame:
    """(node_id, fx, fy) by all pairs; a node without a mass has none; nodes without an id or a position
    are left out. Up to ``tiled`` nodes pairs are taken one by one. More are met by cells, to the
    rounding of doubles and in work that grows with the nodes (``fields``): a written table. So
    that this holds for any input, numbers that are not finite, a softening that is nothing beside
    the extent, and ids of over ``REPEATS`` rows are left to the pairs one by one."""
    nodes = nodes.where("node_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    nodes = nodes.select("node_id", *[F.col(c).cast("double").alias(c) for c in "xy"], F.coalesce("mass", F.lit(0.0)).cast("double").alias("mass"))
    ends = [f(c) for c in "xy" for f in (F.min, F.max)]
    n, mass, *box = nodes.agg(F.count("*"), F.max(F.abs("mass")), *ends).first()
    if n > tiled and math.isfinite(mass):
        grid = Grid.over(*box, soft)
        if grid is not None and nodes.groupBy("node_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= REPEATS:
            return by_cells(nodes, strength, soft, n, grid)
    return repulsion_by_tiles(nodes, strength, soft, n, block)


def repulsion_by_tiles(nodes: DataFrame, strength: float, soft: float, n: int, block: int = BLOCK) -> DataFrame:
    """All pairs, by tiles. Nodes are dealt into parts and every two parts meet in one task, so a
    node is sent once for each part. How many parts there are follows from the number of
    tasks; only parts of more than ``block`` nodes are divided further. So what is shuffled
    grows with the nodes and a task holds two parts, while the work is quadratic."""
    tasks = 4 * nodes.sparkSession.sparkContext.defaultParallelism
    parts = max(1, math.ceil(n / block), min(math.ceil(n / LEAST), math.ceil(math.sqrt(2 * tasks))))
    own = F.pmod(F.xxhash64("node_id"), F.lit(parts)).cast("int")
    dealt = nodes.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    i, j = F.greatest("own", "other"), F.least("own", "other")
    # Tiles are numbered row by row of a triangle: one partition each.
    tile = (i * (i + 1) / 2 + j).cast("int")
    dealt = dealt.select(tile.alias("tile"), (F.col("own") > F.col("other")).alias("near"), (i == j).alias("same"), "node_id", "x", "y", "mass")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        tiles = table["tile"].to_numpy()
        for k in np.unique(tiles).tolist():
            part = table.filter(pa.array(tiles == k))
            same, near = part["same"][0].as_py(), part["near"].to_numpy()
            sides = [part] if same else [part.filter(pa.array(near)), part.filter(pa.array(~near))]
            if not all(side.num_rows for side in sides):
                continue
            ids = [side["node_id"].combine_chunks() for side in sides]
            codes = [np.unique(v.to_numpy(zero_copy_only=False), return_inverse=True)[1] if same else np.empty(0) for v in ids]
            held_ = [(c, *(side[name].to_numpy() for name in ("x", "y", "mass"))) for c, side in zip(codes, sides, strict=True)]
            for v, force in zip(ids, _tile_forces(held_[0], None if same else held_[1], soft), strict=True):
                out = pa.RecordBatch.from_arrays([v, *[pa.array(strength * f) for f in force]], names=["node_id", "fx", "fy"])
                for at in range(0, out.num_rows, OUT):
                    yield out.slice(at, OUT)

    kind = nodes.schema["node_id"].dataType.simpleString()
    sums = dealt.repartitionById(parts * (parts + 1) // 2, F.col("tile")).mapInArrow(kernel, f"node_id {kind}, fx double, fy double")
    return sums.groupBy("node_id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def total_force(*forces: DataFrame) -> DataFrame:
    out = forces[0]
    for f in forces[1:]:
        out = out.union(f)
    return out.groupBy("node_id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def _swing() -> F.Column:
    dx, dy = F.col("fx") - F.col("fx_prev"), F.col("fy") - F.col("fy_prev")
    return F.sqrt(dx * dx + dy * dy)


def swing_traction(nodes: DataFrame) -> DataFrame:
    """One row over nodes with fx, fy, fx_prev, fy_prev: swing weighs 1 + mass."""
    sx, sy = F.col("fx") + F.col("fx_prev"), F.col("fy") + F.col("fy_prev")
    return nodes.agg(
        F.sum((1 + F.col("mass")) * _swing()).alias("swing"), F.sum(0.5 * F.sqrt(sx * sx + sy * sy)).alias("traction"), F.count("*").alias("n")
    )


def next_speed(state: Speed, swing: float, traction: float, n: int) -> Speed:
    """The controller's step; its constants are fixed values of the layout method."""
    swing, traction = swing + 0.001, traction + 0.001
    estimate = 0.05 * math.sqrt(n)
    jitter = state.jitter * max(math.sqrt(estimate), min(state.max_jitter, estimate * traction / (float(n) * n)))
    efficiency = state.efficiency
    if swing / traction > 2.0:
        if efficiency > 0.05:
            efficiency *= 0.5
        jitter = max(jitter, state.jitter)
    target = jitter * efficiency * traction / swing
    if swing > jitter * traction:
        if efficiency > 0.05:
            efficiency *= 0.7
    elif state.speed < 1000:
        efficiency *= 1.3
    return replace(state, speed=state.speed + min(target - state.speed, 0.5 * state.speed), efficiency=efficiency)


def update_nodes(nodes: DataFrame, speed: float) -> DataFrame:
    """Nodes with fx, fy, fx_prev, fy_prev moved by one step; the force becomes the last one."""
    step = speed / (1.0 + speed * F.col("mass") * _swing())
    new = {"x": F.col("x") + step * F.col("fx"), "y": F.col("y") + step * F.col("fy"), "fx_prev": F.col("fx"), "fy_prev": F.col("fy")}
    return nodes.withColumns(new).drop("fx", "fy")
