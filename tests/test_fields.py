"""The exact repulsion by cells against sums of longer numbers, and its work."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import fields, forces

POINT = "node_id long, x double, y double, mass double"


def scattered(seed=5):
    """(id, x, y, mass): a thin wide cloud, a dense one, a heap within one least cell and far outliers."""
    rng = np.random.default_rng(seed)
    at = np.concatenate([rng.uniform(-300, 300, (900, 2)), rng.uniform(-4, 4, (1800, 2)), 1.01 + rng.uniform(0, 1e-3, (900, 2)), np.full((50, 2), 2.5), [[9000.0, -7000.0], [-2500.0, 20.0]]])
    return np.arange(len(at)), *at.T.copy(), rng.integers(1, 3000, len(at)).astype(float)


def direct(ids, x, y, m, soft, pick):
    """Forces on the rows of ``pick`` and the sums of sizes that they are made of."""
    x, y, m = (v.astype(np.longdouble) for v in (x, y, m))
    dx, dy = x[pick, None] - x, y[pick, None] - y
    w = m[pick, None] * m * (ids[pick, None] != ids) / (dx * dx + dy * dy + np.longdouble(soft))
    return np.array([(w * dx).sum(1), (w * dy).sum(1)]).astype(float), (w * np.hypot(dx, dy)).sum(1).astype(float)


def in_one_group(x, y, m, soft):
    grid = fields.Grid.over(x.min(), x.max(), y.min(), y.max(), soft)
    keys = grid.keys(x, y)
    by = np.argsort(keys, kind="stable")
    cells = fields.Cells(grid, [], np.zeros(1, np.int64), np.array([0, 1]))
    for k in range(grid.depth + 1):
        codes, n = np.unique(keys >> (2 * (grid.depth - k)), return_counts=True)
        part = np.isin(codes >> 2, crowded) if k else np.ones(len(codes), bool)  # noqa: F821
        cells.levels.append((codes[part], n[part].astype(np.int64)))
        crowded = cells.crowded(k)
        if not len(crowded):
            break
    points, came = (keys[by], x[by], y[by], m[by]), {}
    for task, far, level, cell, data in fields.sent(cells, 0, *points):
        assert far and task == 0
        for held, v in zip(came.setdefault((far, level), ([], [])), (cell, data), strict=True):
            held.append(v)
    out = np.empty((2, len(x)))
    out[:, by] = m[by] * fields.field(cells, *points, came, soft)
    return cells, out


@pytest.mark.parametrize("pairs", [64, 1 << 12, 1 << 16])
@pytest.mark.parametrize("at", [0.0, 2.0**24])
def test_forces_to_the_rounding_of_doubles(pairs, at, monkeypatch):
    monkeypatch.setattr(fields, "PAIRS", pairs)
    ids, x, y, m = scattered()
    x, y = np.round(x * 2**20) / 2**20, np.round(y * 2**20) / 2**20  # sums with 2^24 are exact
    want, sizes = direct(ids, x, y, m, 0.0025, np.arange(len(ids)))
    cells, got = in_one_group(x + at, y - at, m, 0.0025)
    assert len(cells.levels) > 5 and (abs(got - want) / sizes).max() < 5e-13


def test_any_two_points_meet_once(monkeypatch):
    monkeypatch.setattr(fields, "PAIRS", 100)
    _, x, y, m = scattered(6)
    cells, _ = in_one_group(x, y, m, 0.0025)
    met = 0
    for level, (codes, n) in enumerate(cells.levels):
        a, other, _, _ = cells.meetings(level, codes)
        met += int((n[a] * fields._look(codes, n, other)).sum())
    assert met == len(x) ** 2


def test_work_grows_with_the_nodes():
    def work(n, heap):
        rng = np.random.default_rng(n)
        x, y = rng.uniform(-100, 100, (2, n))
        if heap:  # a third in one place
            x[: n // 3], y[: n // 3] = 3.01, 4.01
        grid = fields.Grid.over(-100, 100, -100, 100, 0.0025)
        keys, cells, out = grid.keys(x, y), fields.Cells(grid, [], np.zeros(1, np.int64), np.array([0, 1])), 0
        for k in range(grid.depth + 1):
            codes, count = np.unique(keys >> (2 * (grid.depth - k)), return_counts=True)
            part = np.isin(codes >> 2, crowded) if k else np.ones(len(codes), bool)  # noqa: F821
            codes, count = codes[part], count[part]
            cells.levels.append((codes, count))
            a, other, _, far = cells.meetings(k, codes)
            out += int((count[a] * fields._look(codes, count, other))[~far].sum()) + int(far.sum()) * (1 << 16)
            crowded = cells.crowded(k)
            if not len(crowded):
                return out

    # By pairs one by one it would be 16 times.
    assert all(work(400_000, heap) < 6 * work(100_000, heap) for heap in (False, True)) and work(400_000, False) < 0.2 * 400_000**2


def test_groups_of_a_table(spark):
    ids, x, y, m = scattered(7)
    ids = np.where(ids % 50 == 1, ids - 1, ids)  # some ids of two rows
    rows = list(zip(ids.tolist(), x.tolist(), y.tolist(), m.tolist(), strict=True))
    d = spark.createDataFrame([*rows, (8000, 1.0, 1.0, None), (8001, None, 1.0, 1.0), (None, 1.0, 1.0, 5.0)], POINT).repartition(3)
    want, sizes = direct(ids, x, y, m, 0.0025, np.arange(len(ids)))
    sums = {}
    for i, f, size in zip(ids.tolist(), want.T, sizes, strict=True):
        held = sums.setdefault(i, np.zeros(3))
        held += [*f, size]
    grid = fields.Grid.over(x.min(), x.max(), y.min(), y.max(), 0.0025)
    nodes = d.where("node_id IS NOT NULL AND x IS NOT NULL").fillna(0.0, ["mass"])
    for found in (fields.by_cells(nodes, 1.0, 0.0025, len(ids), grid, 300), forces.repulsion_exact(d, 1.0, 0.0025, tiled=0)):
        got = {r.node_id: np.array([r.fx, r.fy]) for r in found.collect()}
        assert got.pop(8000).tolist() == [0.0, 0.0] and got.keys() == sums.keys()
        assert max(abs(got[i] - v[:2]).max() / v[2] for i, v in sums.items()) < 5e-13


def test_many_nodes_are_met_by_cells(spark):
    n = 80_000
    d = spark.range(n).select(F.col("id").cast("string").alias("node_id"), (80 * F.rand(1) - 40).alias("x"), (80 * F.rand(2) - 40).alias("y"), (1 + F.col("id") % 5).cast("double").alias("mass"))
    held = d.toPandas()
    out = forces.repulsion_exact(d, 1.0, 0.0025)
    assert hasattr(out, "_written_path")
    got = {r.node_id: (r.fx, r.fy) for r in out.collect()}
    pick = np.arange(0, n, 2000)
    want, sizes = direct(held.node_id.to_numpy(), held.x.to_numpy(), held.y.to_numpy(), held.mass.to_numpy(), 0.0025, pick)
    assert len(got) == n and all(abs(np.array(got[str(k)]) - f).max() < 5e-13 * s for k, f, s in zip(pick, want.T, sizes, strict=True))


def test_what_no_grid_can_hold_is_left_to_pairs(spark):
    over = fields.Grid.over
    assert over(0, 1, 0, 1, 0.0) is over(0, float("nan"), 0, 1, 1.0) is over(0, 1e12, 0, 1, 1e-4) is over(2.0**60, 2.0**60 + 512, 0, 1, 1.0) is None
    far = [(k, float(x), 0.0, 1.0) for k, x in enumerate((0, 1, 1e13))]
    got = {r.node_id: r.fx for r in forces.repulsion_exact(spark.createDataFrame(far, POINT), 1.0, 0.0025, tiled=0).collect()}
    assert got[0] == pytest.approx(-1 / 1.0025) and got[1] == pytest.approx(1 / 1.0025)
    one = spark.createDataFrame([(3, float(k), 0.0, 1.0) for k in range(forces.REPEATS + 2)], POINT)
    assert [(r.node_id, r.fx, r.fy) for r in forces.repulsion_exact(one, 1.0, 0.0025, tiled=0).collect()] == [(3, 0.0, 0.0)]
