"""Edges laid out for a layout run, and its steps against numpy."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.fixtures import OFFSET, relation
from loomgraph.operators import forces, graph
from loomgraph.operators.forces import Speed, next_speed
from loomgraph.plans import layout as steps
from loomgraph.plans.adjacency import lay_out
from loomgraph.plans.layout import LayoutParams, layout

from .conftest import DATA


def tables(spark):
    return spark.sql("SHOW TABLES").where("tableName LIKE 'laid_%'").count()


def test_no_exchange_of_edges(spark):
    nodes, adj = relation(spark, DATA, "nodes"), graph.mirror_edges(relation(spark, DATA, "edges"), OFFSET)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        laid = lay_out(adj, hot=20)
        assert laid.hot.count() > 3
        for _ in range(2):  # the plan of the second step
            there = laid.placed(nodes)
            pulled = forces.attraction(nodes, laid.edges, there=there)
            plan = pulled._jdf.queryExecution().executedPlan().toString()
        # Between the scans and their join nothing moves; what moves are sums by src.
        assert re.search(r"SortMergeJoin \[dst", plan) and "Bucketed: true" in plan
        assert not re.search(r"Exchange hashpartitioning\([^)]*dst", plan) and not re.search(r"Exchange.*part#", plan)
        got = {r.node_id: (r.fx, r.fy) for r in pulled.collect()}
        want = {r.node_id: (r.fx, r.fy) for r in forces.attraction(nodes, adj).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-6) for k in want)
        assert laid.edges.groupBy("dst", "part").count().agg(F.max("count")).first()[0] < 40
        assert tables(spark) == 2
        laid.drop()
        assert tables(spark) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("mode", ["exact", "approx"])
def test_three_steps_against_numpy(spark, mode):
    nodes, edges = relation(spark, DATA, "nodes"), relation(spark, DATA, "edges")
    adj = graph.mirror_edges(edges, OFFSET)
    p = LayoutParams(attraction=1e-3, repulsion=1e-6, soft=0.0025, gravity=1e-4, theta=0.0)
    out, history = layout(nodes, adj, 3, p, mode)
    got = {r.node_id: (r.x, r.y) for r in out.collect()}
    assert tables(spark) == 0
    rows = nodes.orderBy("node_id").collect()
    at = {r.node_id: k for k, r in enumerate(rows)}
    pos, mass = np.array([(r.x, r.y) for r in rows]), np.array([r.mass for r in rows])
    w = np.zeros((len(rows), len(rows)))
    for r in adj.collect():
        if r.src in at and r.dst in at:
            w[at[r.src], at[r.dst]] += r.weight
    last, state = np.zeros_like(pos), Speed()
    for k in range(3):
        gap = pos[:, None] - pos[None]
        push = mass[:, None] * mass[None] / ((gap**2).sum(2) + p.soft)
        np.fill_diagonal(push, 0)
        force = p.attraction * (w @ pos - w.sum(1)[:, None] * pos) - p.gravity * mass[:, None] * pos + p.repulsion * (push[:, :, None] * gap).sum(1)
        swing, traction = np.hypot(*(force - last).T), np.hypot(*(force + last).T) / 2
        assert history[k]["swing"] == pytest.approx(((1 + mass) * swing).sum(), rel=1e-6)
        state = next_speed(state, ((1 + mass) * swing).sum(), traction.sum(), len(rows))
        pos = pos + (state.speed / (1 + state.speed * mass * swing))[:, None] * force
        last = force
    assert all(got[r.node_id] == pytest.approx(tuple(pos[k]), rel=1e-6, abs=1e-6) for k, r in enumerate(rows))


def test_steps_by_cells_are_those_by_pairs(spark, monkeypatch):
    nodes, adj = relation(spark, DATA, "nodes"), graph.mirror_edges(relation(spark, DATA, "edges"), OFFSET)
    p, found, written = LayoutParams(attraction=1e-3, repulsion=1e-6, gravity=1e-4), [], []

    def by_cells(*args):
        written.append(forces.repulsion_exact(*args, tiled=0))
        return written[-1]

    for push in (forces.repulsion_exact, by_cells):
        monkeypatch.setattr(steps, "repulsion_exact", push)
        found.append({r.node_id: (r.x, r.y) for r in layout(nodes, adj, 2, p)[0].collect()})
    assert found[0].keys() == found[1].keys() and all(found[1][k] == pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in found[0].items())
    # Each step deletes the forces that it was given.
    assert len(written) == 2 and not any(os.path.exists(w._written_path.removeprefix("file://")) for w in written)
