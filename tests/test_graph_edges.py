"""Missing values, file order, opening angles and broken trees of the graph operators."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from loomgraph.fixtures import OFFSET, relation
from loomgraph.operators import approx, checks, forces, generate, graph, ids, spatial, style
from loomgraph.plans.ingest import build_graph
from loomgraph.plans.layout import LayoutParams, layout
from loomgraph.sources import files

from .conftest import DATA

HEAD = "userid,user_display_name,user_screen_name,user_reported_location,user_profile_description,user_profile_url,follower_count,following_count,account_creation_date,account_language\n"
POINT = "node_id long, mass double, x double, y double"


def test_first_row_of_a_name_wins_in_file_order(spark, tmp_path):
    rows = [[("a", "900"), ("b", "")], [("a", "5"), ("c", "x")]]
    for k, part in enumerate(rows):
        (tmp_path / f"{k}.csv").write_text(HEAD + "".join(f'{k},{n},s,"l\n2",d,u,{c},3,2014-05-01,en\n' for n, c in part), encoding="utf-8")
    posts = spark.createDataFrame([("a", datetime.date(2020, 1, 1), "[x]"), ("b", datetime.date(2020, 1, 1), "[x]")], "name string, date date, hashtags string")
    g = build_graph(files.read_accounts(spark, str(tmp_path), places=True), posts)
    assert [(r.account_id, r.name, r.followers) for r in g.accounts.orderBy("account_id").collect()] == [(0, "a", 900), (1, "b", None), (2, "a", 5), (3, "c", None)]
    assert {(r.account_id, r.weight) for r in g.edges.collect()} == {(0, 1), (1, 1)}


def test_unknown_followers_have_mass_one(spark):
    nodes = spark.createDataFrame([(0, "account", None), (1, "account", 3), (2, "hashtag", None)], "node_id long, kind string, followers long")
    assert [r.mass for r in style.with_mass(nodes).orderBy("node_id").collect()] == [1.0, 4.0, 2.0]


def test_a_missing_mass_or_position_spoils_no_other_node(spark):
    d = spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, None, 1.0, 0.0), (2, 2.0, 0.0, 2.0), (3, 1.0, None, 0.0)], POINT)
    for found in (forces.repulsion_exact(d, 1.0, 0.1), approx.repulsion_approx(d, 1.0, 0.1)):
        f = {r.node_id: (r.fx, r.fy) for r in found.collect()}
        assert f[0] == pytest.approx((0, -4 / 4.1)) and f[2] == pytest.approx((0, 4 / 4.1)) and f[1] == pytest.approx((0, 0)) and 3 not in f


def _uniform(spark, n):
    part = lambda k, a: math.modf(math.sin(k * a) * 43758.5453)[0]
    return spark.createDataFrame([(k, 1.0 + k % 4, 40 * part(k + 1, 12.9898), 40 * part(k + 1, 78.233)) for k in range(n)], POINT)


def test_exact_blocks_against_all_pairs(spark):
    rows = [tuple(r) for r in _uniform(spark, 150).collect()] + [(500, 2.0, 1.0, 1.0), (501, 3.0, 1.0, 1.0)]
    want = {}
    for i, m, x, y in rows:
        parts = [(m * n / ((x - u) ** 2 + (y - v) ** 2 + 0.0025), x - u, y - v) for j, n, u, v in rows if j != i]
        want[i] = (sum(f * a for f, a, _ in parts), sum(f * b for f, _, b in parts))
    for block in (20, 2048):
        got = {r.node_id: (r.fx, r.fy) for r in forces.repulsion_exact(spark.createDataFrame(rows, POINT), block=block).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-7, abs=1e-7) for k in want)


def test_exact_repulsion_shuffles_in_proportion_to_the_nodes(spark):
    sc = spark.sparkContext._jsc.sc()

    def shuffled(n):
        def total():
            sc.listenerBus().waitUntilEmpty(30_000)
            return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

        before = total()
        nodes = spark.range(n).select(F.col("id").alias("node_id"), F.lit(1.0).alias("mass"), F.rand(1).alias("x"), F.rand(2).alias("y"))
        forces.repulsion_exact(nodes).write.format("noop").mode("overwrite").save()
        return total() - before

    assert shuffled(40_000) < 6 * shuffled(10_000)


@pytest.mark.parametrize(("theta", "mean", "worst"), [(0.1, 0.002, 0.2), (0.5, 0.05, 5.0)])
def test_approx_error_by_opening_angle(spark, theta, mean, worst):
    nodes = _uniform(spark, 500).cache()
    exact = {r.node_id: (r.fx, r.fy) for r in forces.repulsion_exact(nodes).collect()}
    errors = [math.hypot(r.fx - exact[r.node_id][0], r.fy - exact[r.node_id][1]) / math.hypot(*exact[r.node_id]) for r in approx.repulsion_approx(nodes, theta=theta).collect()]
    assert len(errors) == 500 and sum(errors) / 500 < mean and max(errors) < worst
    assert max(errors) > 1e-9 or theta < 0.2  # tree nodes were accepted


def test_default_opening_angle():
    assert approx.THETA == LayoutParams().theta == 0.1


def test_approx_layout_is_near_the_exact_one(spark):
    nodes = relation(spark, DATA, "nodes")
    edges = relation(spark, DATA, "edges")
    adj = graph.mirror_edges(edges, OFFSET)
    params = LayoutParams(repulsion=1e-3, gravity=0.1)
    a, b = ({r.node_id: (r.x, r.y) for r in layout(nodes, adj, 1, params, mode)[0].collect()} for mode in ("exact", "approx"))
    assert a.keys() == b.keys() and max(math.dist(a[k], b[k]) for k in a) < 0.05


def test_integrity_finds_what_is_broken(spark):
    keyed = spatial.with_morton(_uniform(spark, 60))
    groups = spatial.prefix_groups(keyed)
    tree = spatial.radix_tree(groups)
    children = spatial.tree_children(tree).cache()
    assert checks.tree_integrity(groups, tree, children).count() == 0
    one = children.orderBy("child_level", "child_prefix").first()
    this = (F.col("child_level") == one.child_level) & (F.col("child_prefix") == one.child_prefix)
    lost = checks.tree_integrity(groups, tree, children.where(~this)).collect()
    assert [(r.level, r.prefix, r.n_refs) for r in lost] == [(one.child_level, one.child_prefix, 0)]
    twice = checks.tree_integrity(groups, tree, children.union(children.where(this))).collect()
    assert [(r.level, r.prefix, r.n_refs) for r in twice] == [(one.child_level, one.child_prefix, 2)]


def test_running_sums_over_partitions(spark):
    d = spark.range(200).select("id", (F.col("id") % 7).alias("n")).repartition(5)
    rows = ids.with_running_sum(d, ["id"], F.col("n"), "before").orderBy("id").collect()
    assert [r.before for r in rows] == [sum(k % 7 for k in range(n)) for n in range(200)]
    assert rows[0].asDict().keys() == {"id", "n", "before"}
    assert ids.with_dense_id(d.limit(0), ["id"], "k").count() == 0


def test_pairs(spark):
    nodes, edges = generate.gen_pairs(spark.createDataFrame([(3,), (7,)], "k long"), "k")
    assert sorted(r.node_id for r in nodes.collect()) == [6, 7, 14, 15] and sorted((r.src, r.dst) for r in edges.collect()) == [(6, 7), (14, 15)]


def test_leading_blanks_and_empty_tags(spark):
    posts = spark.createDataFrame([("a", None, t) for t in ("[ a,  b, ,c d ]", "[,]", "[ ]")], "name string, date date, hashtags string")
    assert sorted(r.hashtag for r in graph.explode_hashtags(posts).collect()) == ["a", "b", "c d "]


def test_speed_controller_takes_one_branch_each():
    calm = forces.next_speed(forces.Speed(), 1.0, 10.0, 100)
    assert calm.efficiency == pytest.approx(1.3) and calm.speed == pytest.approx(1.5)
    busy = forces.next_speed(forces.Speed(), 9.0, 10.0, 100)  # swing over jitter times traction, under twice the traction
    assert busy.efficiency == pytest.approx(0.7)
    capped = forces.next_speed(forces.Speed(speed=1000.0), 1.0, 10.0, 100)
    assert capped.efficiency == 1.0
