"""Repulsion by groups: what is sent, and a table that is one key."""

import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import approx


def test_a_point_is_not_sent_for_each_subtree_that_it_opens(spark, monkeypatch):
    monkeypatch.setattr(approx, "OPENERS", 200)
    n = 3000
    nodes = spark.range(n).select(F.col("id").alias("node_id"), F.lit(1.0).alias("mass"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = total()
    assert approx.repulsion_approx(nodes, theta=0.1, top=1500).count() == n
    sent = total() - before
    assert sent < 2000 * n, sent


def test_one_key_of_many_points(spark):
    d = spark.range(30).select(F.col("id").alias("node_id"), F.lit(2.0).alias("mass"), F.lit(1.5).alias("x"), F.lit(-1.0).alias("y"))
    d = d.union(spark.createDataFrame([(99, 0.0, 7.0, 7.0)], d.schema))
    got = {r.node_id: (r.fx, r.fy) for r in approx.repulsion_approx(d, top=10).collect()}
    assert len(got) == 31 and set(got.values()) == {(0.0, 0.0)}


def test_visitors_hold_all_that_members_open():
    rng = np.random.default_rng(4)
    at = rng.uniform(-5, 5, (70, 1, 2)) + rng.uniform(-0.3, 0.3, (70, 9, 2))
    boxes = approx.Boxes(np.column_stack([at[..., 0].min(1), at[..., 0].max(1), at[..., 1].min(1), at[..., 1].max(1)]), np.arange(70) * 2, np.full(70, 2))
    x, y, size = rng.uniform(-5, 5, 200), rng.uniform(-5, 5, 200), rng.exponential(0.2, 200)
    size[0] = np.inf
    found = set(zip(*(v.tolist() for v in boxes.visitors(x, y, size, 0.01, 0.3))))
    gap = ((at[None, ..., 0] - x[:, None, None]) ** 2 + (at[None, ..., 1] - y[:, None, None]) ** 2 + 0.01) ** 0.5
    opened = (0.3 * gap <= size[:, None, None]).any(2)
    want = {(int(k), 2 * int(g) + s) for k, g in zip(*np.nonzero(opened)) for s in (0, 1)}
    assert want <= found and len(found) < 2 * len(want) and {(0, t) for t in range(140)} <= found
