"""The radix tree by ranges, and walks down it, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import approx, checks, forces, spatial

POINT = "node_id long, mass double, x double, y double"


def brute_tree(keys):
    """{(level, prefix): keys below} of the inner nodes: prefixes after which both bits occur."""
    nodes = {}
    for level in range(32):
        for prefix in {k >> (32 - level) for k in keys}:
            below = [k for k in keys if k >> (32 - level) == prefix]
            if len({k >> (31 - level) & 1 for k in below}) == 2:
                nodes[level, prefix] = sorted(below)
    return nodes


@pytest.mark.parametrize("slab", [1 << 20, 1, 2, 5])
@pytest.mark.parametrize("parts", [1, 5])
def test_nodes_of_small_slabs(spark, slab, parts):
    rng = random.Random(slab * 10 + parts)
    keys = {rng.getrandbits(32) for _ in range(25)} | {rng.getrandbits(32) & 0xFFFF0003 for _ in range(10)} | {0, 1, 2**32 - 1, 2**31, 2**31 - 1}
    rows = [(k, 1.0 + rng.random(), rng.random(), rng.random()) for k in keys for _ in range(rng.choice([1, 1, 3]))]
    d = spark.createDataFrame(rows, "morton long, mass double, x double, y double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        groups = spatial.prefix_groups(d)
        tree = spatial.radix_tree(groups, slab=slab)
        got = {(r.level, r.prefix): r for r in tree.collect()}
        assert checks.tree_integrity(groups, tree, spatial.tree_children(tree)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute_tree(keys)
    assert got.keys() == want.keys() and len(got) == len(keys) - 1

    def centre(ks):
        own = [r for r in rows if r[0] in set(ks)]
        m = sum(r[1] for r in own)
        return len(own), m, sum(r[1] * r[2] for r in own) / m, sum(r[1] * r[3] for r in own) / m

    for (level, prefix), below in want.items():
        r = got[level, prefix]
        n, m, cx, cy = centre(below)
        halves = [[k for k in below if k >> (31 - level) & 1 == bit] for bit in (0, 1)]
        size = 2 * max(np.hypot(c[2] - cx, c[3] - cy) for c in map(centre, halves))
        assert (r.kmin, r.kmax, r.n) == (below[0], below[-1], n) and (r.mass, r.cx, r.cy, r["size"]) == pytest.approx((m, cx, cy, size))
        for side, half in zip(("left", "right"), halves, strict=True):
            name = (r[f"{side}_level"], r[f"{side}_prefix"])
            assert want[name] == half if len(half) > 1 else name == (32, half[0])


def test_one_key_and_none(spark):
    d = spark.createDataFrame([(5, 1.0, 0.0, 0.0), (5, 2.0, 1.0, 1.0)], "morton long, mass double, x double, y double")
    assert spatial.radix_tree(spatial.prefix_groups(d)).count() == 0
    assert spatial.radix_tree(spatial.prefix_groups(d.limit(0))).count() == 0


def test_keys_without_mass_have_no_centre(spark):
    d = spark.createDataFrame([(5, 0.0, 0.0, 0.0), (6, 0.0, 1.0, 1.0)], "morton long, mass double, x double, y double")
    r = spatial.radix_tree(spatial.prefix_groups(d)).first()
    assert (r.n, r.mass, r.cx, r["size"]) == (2, 0.0, None, None)


@pytest.mark.parametrize("theta", [0.0, 0.3])
def test_cut_trees_walk_as_whole_ones(spark, theta, monkeypatch):
    monkeypatch.setattr(approx, "OPENERS", 40)
    monkeypatch.setattr(approx, "PAIRS", 50)
    rng = random.Random(8)
    rows = [(k, 1.0 + k % 3, rng.gauss(0, 9), rng.choice([0.0, rng.gauss(0, 9)])) for k in range(300)] + [(900 + k, 1.0, 3.0, 3.0) for k in range(9)]
    d = spark.createDataFrame(rows, POINT)
    whole = {r.node_id: (r.fx, r.fy) for r in approx.repulsion_approx(d, theta=theta).collect()}
    for top in (40, 3):
        cut = {r.node_id: (r.fx, r.fy) for r in approx.repulsion_approx(d, theta=theta, top=top).collect()}
        assert cut.keys() == whole.keys() and all(cut[k] == pytest.approx(whole[k], rel=1e-9, abs=1e-9) for k in whole)
    if theta == 0:
        exact = {r.node_id: (r.fx, r.fy) for r in forces.repulsion_exact(d).collect()}
        assert all(whole[k] == pytest.approx(exact[k], rel=1e-7, abs=1e-7) for k in exact)


def test_text_ids(spark):
    d = spark.createDataFrame([("a", 1.0, 0.0, 0.0), ("b", 1.0, 0.0, 2.0), ("c", None, 1.0, 1.0)], "node_id string, mass double, x double, y double")
    f = {r.node_id: r.fy for r in approx.repulsion_approx(d, 1.0, 0.0).collect()}
    assert f == {"a": pytest.approx(-0.5), "b": pytest.approx(0.5), "c": 0.0}
    assert approx.repulsion_approx(d.limit(0)).count() == 0


def test_written_tables_of_a_walk(spark, monkeypatch):
    labels = []
    for module in (approx, __import__("loomgraph.operators.radix", fromlist=["radix"])):
        real = module.written
        monkeypatch.setattr(module, "written", lambda df, label, real=real: labels.append(label) or real(df, label))
    d = spark.range(500).select(F.col("id").alias("node_id"), F.lit(1.0).alias("mass"), (F.col("id") % 23).cast("double").alias("x"), (F.col("id") % 17).cast("double").alias("y"))
    approx.repulsion_approx(d, top=50)
    assert labels == ["approx-nodes", "tree-parts", "approx-walked", "approx-force"]
