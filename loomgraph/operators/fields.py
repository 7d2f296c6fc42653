"""The exact repulsion of many nodes: near pairs one by one, far cells by expansions that are
carried to the rounding of doubles. No pair is left out and no force is weakened, but the
work grows with the nodes, not with their pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, written

#: Interpolation points along an axis. The softened inverse square is analytic, so two cells with a
#: cell between them meet by 20 points an axis to about 1e-14 of the sum of all sizes.
ORDER = 20
#: Two cells of no more pairs than this, and no more points each, meet point by point.
PAIRS, POINTS = 1 << 16, 1 << 11
#: Points of a group of neighbouring cells, which is one task's work.
GROUP = 1 << 16
#: Levels of the grid that are counted first, and at a time after.
_FIRST, _NEXT = 6, 2
#: Least cells are so much narrower than the softening that they need no cell between them.
_NARROW = 0.7
#: Deepest grid, and digits of a coordinate in least cells that leave places in a cell exact.
_DEEPEST, _DIGITS = 31, 48
#: Pairs of points held at a time; relative error of a softened square that a matrix product may bring.
_CHUNK, _ROUNDING = (128, 384), 1e-12
#: Rows that are sent at a time.
_OUT, _SENT = 10_000, 500

_MASKS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
_AROUND = np.array([(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])


def _codes(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Morton codes; a cell's code is that of its parent and two more bits."""
    out = []
    for v in (i, j):
        for shift, mask in _MASKS:
            v = (v | (v << shift)) & mask
        out.append(v)
    return (out[0] << 1) | out[1]


def _places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for v in (codes >> 1, codes):
        v = v & _MASKS[-1][1]
        for (shift, _), mask in zip(_MASKS[::-1], [m for _, m in _MASKS[-2::-1]] + [0xFFFFFFFF], strict=True):
            v = (v | (v >> shift)) & mask
        out.append(v)
    return out[0], out[1]


@dataclass(frozen=True)
class Grid:
    """Square cells, halved ``depth`` times. Widths are powers of two and the corner is a multiple
    of the least, so that places within cells are exact."""

    side: float
    depth: int
    i0: int
    j0: int

    @staticmethod
    def over(x0: float, x1: float, y0: float, y1: float, soft: float) -> Grid | None:
        """The grid over a box, None if doubles or the depth don't allow one."""
        if not (soft > 0 and all(math.isfinite(v) for v in (x0, x1, y0, y1, soft))):
            return None
        side = 2.0 ** math.floor(math.log2(_NARROW * math.sqrt(soft)))
        if max(map(abs, (x0, x1, y0, y1))) / side >= 2.0**_DIGITS:
            return None
        i0, j0 = math.floor(x0 / side), math.floor(y0 / side)
        depth = max(math.floor(x1 / side) - i0, math.floor(y1 / side) - j0).bit_length()
        return Grid(side, depth, i0, j0) if depth <= _DEEPEST else None

    def keys(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return _codes(*(np.floor(v / self.side).astype(np.int64) - low for v, low in ((x, self.i0), (y, self.j0))))

    def width(self, level: int) -> float:
        return math.ldexp(self.side, self.depth - level)

    def inside(self, level: int, codes: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the cells, from -1 to 1."""
        half, up = self.width(level) / 2, self.depth - level
        i, j = _places(codes)
        return tuple((v - ((c << up) + low) * self.side - half) / half for v, c, low in ((x, i, self.i0), (y, j, self.j0)))


def _met(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether cells of so many points meet point by point. If two do, so do their children."""
    return (n * m <= PAIRS) & (np.maximum(n, m) <= POINTS)


def _look(codes: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Points of the wanted cells, 0 of one that isn't there."""
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return np.where(codes[at] == wanted, n[at], 0)


def _shifted(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Codes of cells at these places, -1 beyond the border."""
    top = 1 << level
    inside = (i >= 0) & (i < top) & (j >= 0) & (j < top)
    return np.where(inside, _codes(np.where(inside, i, 0), np.where(inside, j, 0)), -1)


@dataclass
class Cells:
    """Codes, ascending, and points of each level's cells that take part, a level an entry: the root,
    and the children of every cell that has too many points to meet itself or a neighbour
    point by point. Points of one range of keys, or a share of them, are a group: range r
    starts at ``starts[r]`` and has the groups from ``first[r]`` to ``first[r + 1]``."""

    grid: Grid
    levels: list[tuple[np.ndarray, np.ndarray]]
    starts: np.ndarray
    first: np.ndarray

    def crowded(self, level: int) -> np.ndarray:
        """Cells of the level whose children take part."""
        codes, n = self.levels[level]
        if level == self.grid.depth:
            return codes[:0]
        i, j = _places(codes)
        near = _look(codes, n, _shifted(level, i[:, None] + _AROUND[:, 0], j[:, None] + _AROUND[:, 1]))
        return codes[(~_met(n[:, None], near) & (near > 0)).any(1)]

    def meetings(self, level: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place in own, code of the other, its direction, whether by expansion) of all pairs of cells
        that meet at this level, where own are cells of it. Two cells meet at the first level at
        which they are few points or have a cell between them, so any two points meet at one."""
        codes, n = self.levels[level]
        i, j = _places(own)
        if level == 0:
            a, other, di, dj = np.arange(len(own)), own, np.zeros(len(own), int), np.zeros(len(own), int)
        else:
            step = np.array([(u, v) for u in range(-2, 4) for v in range(-2, 4)])
            u, v = (i & ~1)[:, None] + step[:, 0], (j & ~1)[:, None] + step[:, 1]
            there = _shifted(level, u, v)
            held = _look(codes, n, there) > 0
            parents = self.levels[level - 1]
            held[held] &= ~_met(_look(*parents, np.broadcast_to((own >> 2)[:, None], there.shape)[held]), _look(*parents, there[held] >> 2))
            a, k = np.nonzero(held)
            other, di, dj = there[a, k], (u[a, k] - i[a]), (v[a, k] - j[a])
        few = _met(_look(codes, n, own[a]), _look(codes, n, other))
        apart = (np.maximum(abs(di), abs(dj)) > 1) | (level == self.grid.depth)
        now = few | apart
        return a[now], other[now], np.column_stack([di, dj])[now], ~few[now]

    def groups(self, level: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First group of each cell, and the one after its last."""
        up = 2 * (self.grid.depth - level)
        low, high = (np.searchsorted(self.starts, v, side="right") - 1 for v in (codes << up, ((codes + 1) << up) - 1))
        return self.first[low], self.first[high + 1]

    def recipients(self, level: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in own, group, whether by expansion): who needs these cells, each once."""
        a, other, _, far = self.meetings(level, own)
        low, high = self.groups(level, other)
        times = high - low
        group = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - low, times)
        out = np.unique(np.column_stack([np.repeat(v, times) for v in (a, far)] + [group]), axis=0)
        return out[:, 0], out[:, 2], out[:, 1].astype(bool)


def counted(keyed: DataFrame, grid: Grid, size: int) -> Cells:
    """The cells, counted from the top down, some levels at a time and only below those with many
    points. The driver gets a row for each cell that takes part: far fewer than nodes, since
    only cells with some hundred points, and neighbours of such, have children here."""
    spark, depth = keyed.sparkSession, grid.depth
    cells = Cells(grid, [], np.zeros(1, np.int64), np.array([0, 1]))
    code = lambda level: F.shiftright("key", 2 * (depth - level))
    at, last, crowded = 0, min(_FIRST, depth), None
    while True:
        levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), code(k).alias("code")) for k in range(at, last + 1)])).alias("c")
        part = keyed
        if crowded is not None:
            few = spark.createDataFrame(pa.table({"code": crowded}))
            part = keyed.select("key", code(at - 1).alias("code")).join(F.broadcast(few), "code", "left_semi")
        table = part.select(levels).groupBy("c.level", "c.code").agg(F.count("*").alias("n")).toArrow()
        level, codes, n = (table[c].combine_chunks().to_numpy() for c in ("level", "code", "n"))
        for k in range(at, last + 1):
            this = level == k
            by = np.argsort(codes[this])
            have, count = codes[this][by], n[this][by].astype(np.int64)
            if k > 0:
                below = np.isin(have >> 2, crowded)
                have, count = have[below], count[below]
            cells.levels.append((have, count))
            crowded = cells.crowded(k)
            if not len(crowded):
                break
        if not len(crowded):
            break
        at, last = last + 1, min(last + _NEXT, depth)
    starts, points = [], []
    for k, (codes, n) in enumerate(cells.levels):
        leaf = ~np.isin(codes, cells.crowded(k))
        starts.append(codes[leaf] << (2 * (depth - k)))
        points.append(n[leaf])
    starts, points = np.concatenate(starts), np.concatenate(points)
    by = np.argsort(starts)
    starts, points = starts[by], points[by]
    # A cell of the least width may have any number of points: it is a range for itself, of several groups.
    full, large = (np.cumsum(points) - points) // size, points > size
    cut = np.append(True, (full[1:] != full[:-1]) | large[1:] | large[:-1])
    total = np.add.reduceat(points, np.flatnonzero(cut))
    shares = np.where(large[cut], -(-total // size), 1)
    cells.starts = np.where(np.arange(cut.sum()) == 0, 0, starts[cut])
    cells.first = np.append(0, np.cumsum(shares))
    return cells


_NODES = np.cos((2 * np.arange(ORDER) + 1) * np.pi / (2 * ORDER))
_TO_NODES = 2 / ORDER * np.cos(np.outer(np.arange(ORDER), np.arccos(_NODES)))
_TO_NODES[0] = 1 / ORDER


def _basis(t: np.ndarray) -> np.ndarray:
    """Weights of the interpolation points at each place."""
    return np.cos(np.arccos(np.clip(t, -1, 1))[:, None] * np.arange(ORDER)) @ _TO_NODES


def _kernels(h: float, di: int, dj: int, soft: float) -> tuple[np.ndarray, np.ndarray]:
    """What an expansion of a cell, so many cells away, brings about in another: x and y."""
    gap = (_NODES[:, None] - _NODES) * h / 2
    dx, dy = gap - di * h, gap - dj * h
    w = 1 / ((dx * dx + soft)[:, None, :, None] + (dy * dy)[None, :, None, :])
    return tuple((w * d).reshape(ORDER**2, ORDER**2) for d in (dx[:, None, :, None], dy[None, :, None, :]))


def near_field(x: np.ndarray, y: np.ndarray, x2: np.ndarray, y2: np.ndarray, m2: np.ndarray, soft: float, same: int | None = None) -> np.ndarray:
    """Two rows: the sums that sources bring about at places. With ``same`` the places are themselves
    sources, from that one on, and meet all but themselves. Places are taken some at a time; if
    these lie so close together that rounding can't matter, they are counted from their middle
    and squares of distances are one matrix product, else all is made of differences."""
    rows, columns = _CHUNK
    out = np.zeros((2, len(x)))
    w_ = np.empty(rows * columns)
    for a in range(0, len(x), rows):
        s = slice(a, min(a + rows, len(x)))
        cx, cy = x[s].mean(), y[s].mean()
        u, v, p, q = x[s] - cx, y[s] - cy, x2 - cx, y2 - cy
        r = u * u + v * v
        close = 8 * np.finfo(float).eps * r.max() <= _ROUNDING * soft
        left, right = np.column_stack([-2 * u, -2 * v, r + soft, np.ones(len(u))]), np.vstack([p, q, np.ones(len(p)), p * p + q * q])
        weights = np.column_stack([m2, m2 * p, m2 * q])
        sums = np.zeros((len(u), 3))
        for b in range(0, len(x2), columns):
            t = slice(b, min(b + columns, len(x2)))
            k = np.arange(0) if same is None else np.arange(max(a, b - same), min(s.stop, t.stop - same))
            if close:
                w = w_[: len(u) * (t.stop - b)].reshape(len(u), t.stop - b)
                np.matmul(left, right[:, t], out=w)
                np.divide(1.0, w, out=w)
                w[k - a, k - b + (same or 0)] = 0.0
                sums += w @ weights[t]
            else:
                dx, dy = x[s, None] - x2[t], y[s, None] - y2[t]
                w = m2[t] / (dx * dx + dy * dy + soft)
                w[k - a, k - b + (same or 0)] = 0.0
                out[:, s] += (w * dx).sum(1), (w * dy).sum(1)
        if close:
            out[:, s] = u * sums[:, 0] - sums[:, 1], v * sums[:, 0] - sums[:, 2]
    return out


def _slices(cells: Cells, level: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the level that take part and have some of these keys, with where these begin and end."""
    codes, first = np.unique(keys >> (2 * (cells.grid.depth - level)), return_index=True)
    end = np.append(first[1:], len(keys))
    part = np.isin(codes, cells.levels[level][0], assume_unique=True)
    return codes[part], first[part], end[part]


_SEND = "task int, far boolean, level int, cell bigint, data binary"


def _rows(task, far, level, cell, data) -> pa.RecordBatch:
    types = (pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((task, far, level, cell, data), types, strict=True)], names=["task", "far", "level", "cell", "data"])


def _in_lots(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    lot = []
    for row in rows:
        lot.append(row)
        if len(lot) == _SENT:
            yield _rows(*zip(*lot, strict=True))
            lot = []
    if lot:
        yield _rows(*zip(*lot, strict=True))


def sent(cells: Cells, group: int, keys: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray) -> Iterator[tuple]:
    """Rows of ``_SEND`` of a group, its points ordered by key: points for the groups that meet them
    one by one, and expansions of cells; those of a cell that other groups share go to task -1."""
    for level in range(len(cells.levels)):
        codes, first, end = _slices(cells, level, keys)
        if not len(codes):
            continue
        low, high = cells.groups(level, codes)
        shared = high - low > 1
        place, task, far = cells.recipients(level, codes)
        for k, t in zip(place[~far & (task != group)].tolist(), task[~far & (task != group)].tolist(), strict=True):
            s = slice(first[k], end[k])
            yield t, False, level, int(codes[k]), np.stack([x[s], y[s], m[s]]).tobytes()
        for k in np.unique(place[far]).tolist():
            s = slice(first[k], end[k])
            tx, ty = cells.grid.inside(level, codes[k : k + 1], x[s], y[s])
            data = (_basis(tx).T @ (m[s, None] * _basis(ty))).tobytes()
            for t in [-1] if shared[k] else task[far & (place == k)].tolist():
                yield t, True, level, int(codes[k]), data


def field(cells: Cells, keys: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray, came: dict[tuple[bool, int], tuple[list[int], list[bytes]]], soft: float) -> np.ndarray:
    """Two rows: the sums at a group's points, ordered by key, over all other points. ``came``: cells and
    data that were sent, by (far, level)."""
    out = np.zeros((2, len(x)))
    for level in range(len(cells.levels)):
        codes, first, end = _slices(cells, level, keys)
        if not len(codes):
            continue
        a, other, way, far = cells.meetings(level, codes)
        if far.any():
            _far(cells.grid, level, codes, first, end, (a[far], other[far], way[far]), came.get((True, level), ([], [])), x, y, soft, out)
        near = ~far
        if not near.any():
            continue
        names, data = came.get((False, level), ([], []))
        names = np.array(names, np.int64)
        by = np.argsort(names, kind="stable")
        names, got = names[by], [np.frombuffer(data[k]).reshape(3, -1) for k in by]
        a, other = a[near], other[near]
        bounds = np.searchsorted(a, np.arange(len(codes) + 1))
        lows, highs = np.searchsorted(names, other), np.searchsorted(names, other, side="right")
        mine = np.searchsorted(codes, other)
        is_mine = codes[np.minimum(mine, len(codes) - 1)] == other
        for k in np.unique(a).tolist():
            s, parts = slice(first[k], end[k]), []
            same = None
            for e in range(bounds[k], bounds[k + 1]):
                if is_mine[e]:
                    if mine[e] == k:
                        same = sum(p.shape[1] for p in parts)
                    t = slice(first[mine[e]], end[mine[e]])
                    parts.append(np.stack([x[t], y[t], m[t]]))
                parts += got[lows[e] : highs[e]]
            if parts:
                out[:, s] += near_field(x[s], y[s], *np.concatenate(parts, axis=1), soft, same)
    return out


def _far(grid: Grid, level: int, codes, first, end, met, came, x, y, soft: float, out: np.ndarray) -> None:
    a, other, way = met
    names, which = np.unique(np.array(came[0], np.int64), return_inverse=True)
    sums = np.zeros((len(names), ORDER**2))
    for k, data in zip(which.tolist(), came[1], strict=True):
        sums[k] += np.frombuffer(data)
    at = np.searchsorted(names, other)
    if len(other) and not (len(names) and np.array_equal(names[np.minimum(at, len(names) - 1)], other)):
        raise RuntimeError("an expansion did not come")
    local = np.zeros((2, len(codes), ORDER**2))
    ways, kind = np.unique(way, axis=0, return_inverse=True)
    for k, (di, dj) in enumerate(ways.tolist()):
        these = kind.ravel() == k
        brought = sums[at[these]]
        for axis, kernel in enumerate(_kernels(grid.width(level), di, dj, soft)):
            local[axis, a[these]] += brought @ kernel.T
    for k in np.unique(a).tolist():
        s = slice(first[k], end[k])
        tx, ty = grid.inside(level, codes[k : k + 1], x[s], y[s])
        both = local[:, k].reshape(2, ORDER, ORDER)
        bx, by = _basis(tx), _basis(ty)
        for axis in range(2):
            out[axis, s] += ((bx @ both[axis]) * by).sum(1)


def by_cells(nodes: DataFrame, strength: float, soft: float, n: int, grid: Grid, size: int | None = None) -> DataFrame:
    """(node_id, fx, fy) of nodes (node_id, x, y, mass), a written table. Nodes are sorted into groups of
    neighbouring cells; a group's task sends its points to the groups nearby and expansions of
    its cells to those that meet them, and another sums what each group got. A node is sent to
    a few groups, a cell to as many as lie around it. Pairs of rows of one id, which don't
    push each other, are taken off."""
    sc = nodes.sparkSession.sparkContext
    size = size or max(1 << 12, min(GROUP, n // (4 * sc.defaultParallelism)))
    kind = nodes.schema["node_id"].dataType.simpleString()

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = grid.keys(batch.column("x").to_numpy(), batch.column("y").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=[*batch.schema.names, "key"])

    point = f"node_id {kind}, x double, y double, mass double, key bigint"
    keyed = written(nodes.select("node_id", "x", "y", "mass").mapInArrow(with_key, point), "exact-nodes")
    known = sc.broadcast(counted(keyed, grid, size))
    tasks = int(known.value.first[-1])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = known.value
        for batch in batches:
            at = np.searchsorted(cells.starts, batch.column("key").to_numpy(), side="right") - 1
            task = cells.first[at] + batch.column("salt").to_numpy() % (cells.first[at + 1] - cells.first[at])
            yield pa.RecordBatch.from_arrays([pa.array(task.astype(np.int32)), *batch.columns[:-1]], names=["task", *batch.schema.names[:-1]])

    own = keyed.withColumn("salt", F.pmod(F.xxhash64("node_id", "x", "y"), F.lit(1 << 31))).mapInArrow(dealt, f"task int, {point}")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, (_, keys, x, y, m), _ in _points(batches):
            yield from _in_lots(sent(known.value, group, keys, x, y, m))

    rows = written(own.repartitionById(tasks, F.col("task")).mapInArrow(send, _SEND), "exact-sent")

    def unite(key: tuple, table: pa.Table) -> pa.Table:
        level, cell = (v.as_py() for v in key)
        data = sum(np.frombuffer(v) for v in table["data"].to_pylist()).tobytes()
        _, task, far = known.value.recipients(level, np.array([cell]))
        task = task[far].tolist()
        return pa.Table.from_batches([_rows(task, [True] * len(task), [level] * len(task), [cell] * len(task), [data] * len(task))])

    united = rows.where("task < 0").groupBy("level", "cell").applyInArrow(unite, _SEND)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("node_id", kind), ("x", "double"), ("y", "double"), ("mass", "double"), ("key", "bigint"))]
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("far", "boolean"), ("level", "int"), ("cell", "bigint"), ("data", "binary"))]
    met = rows.where("task >= 0").union(united).select("*", *none).union(own.select("task", *blank, "node_id", "x", "y", "mass", "key"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, keys, x, y, m), came in _points(batches):
            push = strength * m * field(known.value, keys, x, y, m, came, soft)
            out = pa.RecordBatch.from_arrays([ids, *map(pa.array, push)], names=["node_id", "fx", "fy"])
            for at in range(0, out.num_rows, _OUT):
                yield out.slice(at, _OUT)

    pushed = met.repartitionById(tasks, F.col("task")).mapInArrow(finish, f"node_id {kind}, fx double, fy double")
    twice = keyed.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1").select("node_id")
    again = keyed.join(twice, "node_id", "left_semi")
    a, b = (again.select("node_id", *[F.col(c).alias(f"{c}{k}") for c in ("x", "y", "mass")]) for k in (1, 2))
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    off = -strength * F.col("mass1") * F.col("mass2") / (dx * dx + dy * dy + soft)
    pushed = pushed.union(a.join(b, "node_id").select("node_id", (off * dx).alias("fx"), (off * dy).alias("fy")))
    out = written(pushed.groupBy("node_id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy")), "exact-force")
    discard(keyed, rows)
    known.destroy()
    return out


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple, dict]]:
    """(group, (ids, keys, x, y, mass) ordered by key, what was sent to it) of each group of a partition."""
    own, came = {}, {}
    for batch in batches:
        task = batch.column("task").to_numpy()
        for g in np.unique(task).tolist():
            part = batch.filter(pa.array(task == g))
            points = part.filter(part.column("key").is_valid())
            if points.num_rows:
                own.setdefault(g, []).append(points.select(["node_id", "key", "x", "y", "mass"]))
            if points.num_rows < part.num_rows:
                rest = part.filter(part.column("key").is_null())
                to = came.setdefault(g, {})
                for far, level, cell, data in zip(*(rest.column(c).to_pylist() for c in ("far", "level", "cell", "data")), strict=True):
                    names, held = to.setdefault((far, level), ([], []))
                    names.append(cell)
                    held.append(data)
    for g in sorted(own):
        table = pa.Table.from_batches(own.pop(g))
        table = table.take(pa.array(np.argsort(table["key"].to_numpy(), kind="stable"))).combine_chunks()
        ids = table["node_id"].combine_chunks()
        yield g, (ids, *(table[c].to_numpy() for c in ("key", "x", "y", "mass"))), came.pop(g, {})
