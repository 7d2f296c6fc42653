"""Hand-made cases and properties of the graph operators."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import approx, checks, forces, generate, graph, ids, spatial, style
from loomgraph.operators.forces import Speed, next_speed
from loomgraph.plans.ingest import build_graph
from loomgraph.plans.layout import LayoutParams, layout
from loomgraph.sources import files, graphs


def test_csv_edge_cases(spark, tmp_path):
    path = tmp_path / "a.csv"
    head = "userid,user_display_name,user_screen_name,user_reported_location,user_profile_description,user_profile_url,follower_count,following_count,account_creation_date,account_language\n"
    path.write_text(head + '1,"Ann, ""A""",x,"line\nbreak",d,u,12,3,2014-05-01,en\n2,Bé,x,y,z,u,,3,,en\n', encoding="utf-8")
    rows = {r.name: (r.followers, r.year_created) for r in files.read_accounts(spark, str(path)).collect()}
    assert rows == {'Ann, "A"': (12, 2014), "Bé": (None, None)}


def test_hashtags(spark):
    day = datetime.date(2017, 6, 22)
    posts = spark.createDataFrame([("a", day, t) for t in ("", "[]", "[x]", "[x, x]", "[x,,y]", "[X, y ]", None)], "name string, date date, hashtags string")
    tags = sorted(r.hashtag for r in graph.explode_hashtags(posts).collect())
    assert tags == sorted(["x", "x", "x", "x", "y", "X", "y "])


def test_build_graph(spark, tmp_path):
    day = datetime.date(2020, 1, 1)
    accounts = spark.createDataFrame([(0, "a", 5, 2012), (1, "a", 6, 2013), (2, "b", 0, 2018)], "account_id long, name string, followers long, year_created int")
    posts = spark.createDataFrame([("a", day, "[x, x]"), ("b", day, "[x, y]"), ("a", day, "[]")], "name string, date date, hashtags string")
    g = build_graph(accounts, posts)
    assert {tuple(r) for r in g.edges.collect()} == {(0, 0, 2, 2), (2, 0, 1, 1), (2, 1, 1, 1)}
    graphs.write_graph(g, str(tmp_path / "g"))
    back = graphs.read_graph(spark, str(tmp_path / "g"))
    assert tuple(graph.graph_summary(back).first()) == (3, 2, 3, 4, 5)
    with pytest.raises(ValueError):
        build_graph(accounts, posts.union(spark.createDataFrame([("zz", day, "[x]")], posts.schema)))


def test_dense_id_is_whatever_the_partitions(spark):
    for n in (1, 7):
        d = spark.range(100).repartition(n)
        rows = ids.with_dense_id(d, ["id"], "k").collect()
        assert all(r.id == r.k for r in rows) and len(rows) == 100


def test_pair_forces(spark):
    nodes, edges = generate.gen_pair(spark)
    assert edges.count() == 1
    nodes = spark.createDataFrame([(0, 2.0, 0.0, 0.0), (1, 2.0, 3.0, 4.0)], "node_id long, mass double, x double, y double")
    push = {r.node_id: (r.fx, r.fy) for r in forces.repulsion_exact(nodes, 1.0, 0.0025).collect()}
    f = 4 / (25 + 0.0025)
    assert push[0] == pytest.approx((-3 * f, -4 * f)) and push[1] == pytest.approx((3 * f, 4 * f))
    adj = spark.createDataFrame([(0, 1, 2), (1, 0, 2)], "src long, dst long, weight long")
    pull = {r.node_id: (r.fx, r.fy) for r in forces.attraction(nodes, adj, 1.0, 2.0).collect()}
    assert pull[0] == pytest.approx((12, 16)) and pull[1] == pytest.approx((-12, -16))
    weak = {r.node_id: (r.fx, r.fy) for r in forces.gravity(nodes, 1.0, strong=False).collect()}
    assert weak[0] == (0, 0) and weak[1] == pytest.approx((-1.2, -1.6))


def test_square_has_no_net_repulsion(spark):
    nodes = spark.createDataFrame([(k, 1.0, float(x), float(y)) for k, (x, y) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)])], "node_id long, mass double, x double, y double")
    total = forces.repulsion_exact(nodes, 1.0, 0.1, block=2).agg(F.sum("fx"), F.sum("fy")).first()
    assert total[0] == pytest.approx(0, abs=1e-12) and total[1] == pytest.approx(0, abs=1e-12)


def test_speed_branches():
    calm = next_speed(Speed(), 1.0, 10.0, 100)
    assert calm.efficiency == pytest.approx(1.3) or calm.efficiency == pytest.approx(0.7)
    wild = next_speed(Speed(), 100.0, 1.0, 100)
    assert wild.efficiency == pytest.approx(0.5 * 0.7)
    low = next_speed(Speed(efficiency=0.04), 100.0, 1.0, 100)
    assert low.efficiency == 0.04
    fast = next_speed(Speed(speed=2000.0), 0.0, 10.0, 10**6)
    assert fast.efficiency == 1.0


def _cloud(spark, n):
    return spark.createDataFrame([(k, 1.0 + k % 3, math.sin(k * 7.1) * (k % 11), math.cos(k * 3.3) * (k % 7)) for k in range(n)], "node_id long, mass double, x double, y double")


def test_approx_without_opening_is_exact(spark):
    nodes = _cloud(spark, 40).union(spark.createDataFrame([(900, 1.0, 1.0, 1.0), (901, 1.0, 1.0, 1.0)], "node_id long, mass double, x double, y double"))
    exact = {r.node_id: (r.fx, r.fy) for r in forces.repulsion_exact(nodes).collect()}
    got = {r.node_id: (r.fx, r.fy) for r in approx.repulsion_approx(nodes, theta=0.0).collect()}
    assert got.keys() == exact.keys()
    for k, v in exact.items():
        assert got[k] == pytest.approx(v, rel=1e-6, abs=1e-9)


def test_tree(spark):
    keyed = spatial.with_morton(_cloud(spark, 200))
    distinct = keyed.select("morton").distinct().count()
    groups = spatial.prefix_groups(keyed)
    tree = spatial.radix_tree(groups)
    assert tree.count() == distinct - 1
    assert checks.tree_integrity(groups, tree, spatial.tree_children(tree)).count() == 0
    root = spatial.tree_summary(groups, tree).orderBy("level").first()
    assert root.mass == pytest.approx(keyed.agg(F.sum("mass")).first()[0])


def test_one_point_and_flat_axis(spark):
    one = spark.createDataFrame([(1, 1.0, 2.0, 2.0), (2, 1.0, 2.0, 5.0)], "node_id long, mass double, x double, y double")
    assert [r.morton for r in spatial.with_morton(one).orderBy("node_id").collect()] == [0, 0x55555555]
    same = one.where("node_id = 1")
    assert approx.repulsion_approx(same).first().fx == 0.0


def test_grid_edges(spark):
    d = spark.createDataFrame([(0, -1.0, -1.0), (1, 1.0, 1.0), (2, 0.0, 0.0), (3, 1.01, 0.0)], "node_id long, x double, y double")
    assert [r.cell_id for r in spatial.with_cell(d, 1.0, 4).orderBy("node_id").collect()] == [0, 15, 10, None]


def test_coincident_nodes_are_pushed_apart(spark):
    d = spark.createDataFrame([(0, 1.0, 1.0, 0), (1, 1.0, 1.0, 1)], "node_id long, x double, y double, family int")
    f = {r.node_id: (r.fx, r.fy) for r in spatial.family_force(spatial.neighbors_within(d, 3.0), d).collect()}
    assert f[0] == pytest.approx((-f[1][0], -f[1][1])) and math.hypot(*f[0]) == pytest.approx(1.82)


def test_scale_and_blocks(spark):
    n = spark.createDataFrame([("account", 0), ("account", 1), ("hashtag", None)], "kind string, followers long")
    assert [r.scale for r in style.with_scale(n).collect()] == [None, pytest.approx(math.log(100)), 5.0]
    nodes, edges = generate.gen_blocks(spark, (10, 10, 10), (5, 5))
    assert (nodes.count(), edges.count()) == (40, 200)
    assert generate.gen_cloud(spark, 50).count() == 50


def test_layout_runs_and_keeps_nodes(spark):
    nodes, edges = generate.gen_blocks(spark, (6, 6, 6), (3, 3))
    nodes = style.init_positions(nodes.withColumn("kind", F.lit("hashtag")))
    adj = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out, history = layout(nodes, adj, 2, LayoutParams(gravity=0.1))
    assert out.count() == 24 and len(history) == 2 and history[1]["traction"] > 0
