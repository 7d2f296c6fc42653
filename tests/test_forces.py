"""The kernel of the exact repulsion: far from the origin, and by matrix products or not."""

import numpy as np
import pytest

from loomgraph.operators import forces


def cloud(n, wide, seed):
    rng = np.random.default_rng(seed)
    at = np.round(rng.uniform(-wide, wide, (2, n)) * 1024) / 1024  # sums with 2^24 are exact
    return np.arange(n), *at, rng.integers(1, 9, n).astype(float)


def direct(a, b, soft):
    dx, dy = (a[k][:, None].astype(np.longdouble) - b[k] for k in (1, 2))
    w = a[3][:, None] * b[3] * (a[0][:, None] != b[0]) / (dx * dx + dy * dy + soft)
    return np.array([(w * dx).sum(1), (w * dy).sum(1)]).astype(float)


@pytest.mark.parametrize("wide", [2, 300])
def test_sides_of_a_tile_against_all_differences(wide, monkeypatch):
    monkeypatch.setattr(forces, "_CHUNK", (16, 40))
    a, b = cloud(250, wide, 1), cloud(170, wide, 2)
    b = (b[0] + 1000, *b[1:])
    on, by = forces._tile_forces(a, b, 0.0025)
    assert np.allclose(on, direct(a, b, 0.0025), rtol=1e-9, atol=1e-7) and np.allclose(by, direct(b, a, 0.0025), rtol=1e-9, atol=1e-7)
    assert np.allclose(forces._tile_forces(a, None, 0.0025)[0], direct(a, a, 0.0025), rtol=1e-9, atol=1e-7)


def test_forces_do_not_depend_on_the_origin(spark):
    ids, x, y, m = cloud(300, 4, 3)
    want = direct((ids, x, y, m), (ids, x, y, m), 0.0025)
    rows = [(int(i), float(u) + 2**24, float(v) - 2**24, float(w)) for i, u, v, w in zip(ids, x, y, m)]
    got = forces.repulsion_exact(spark.createDataFrame(rows, "node_id long, x double, y double, mass double")).collect()
    assert len(got) == 300 and all((r.fx, r.fy) == pytest.approx(tuple(want[:, r.node_id]), rel=1e-9, abs=1e-7) for r in got)
