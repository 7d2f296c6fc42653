"""Edges read by their node's range."""

from pyspark.sql import functions as F

from loomgraph.fixtures import OFFSET, relation
from loomgraph.operators import graph
from loomgraph.sources import edge_array

from .conftest import DATA


def test_ranges_of_nodes(spark, tmp_path):
    adj = graph.mirror_edges(relation(spark, DATA, "edges"), OFFSET).cache()
    counts = adj.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n_edges"))
    nodes = counts.union(spark.createDataFrame([(-1, 0), (OFFSET - 1, 0)], "node_id long, n_edges long"))
    ranges = {r.node_id: (r.start_pos, r.end_pos) for r in graph.adjacency_ranges(nodes).collect()}
    path = f"file://{tmp_path}/array"
    edge_array.write_edge_array(adj, path)
    all_ = [tuple(r) for r in edge_array.read_edge_array(spark, path).orderBy("position").collect()]
    assert [r[3] for r in all_] == list(range(len(all_))) and [r[:2] for r in all_] == sorted(r[:2] for r in all_)
    by_join = {n: [r for r in all_ if r[0] == n] for n in ranges}
    assert all(all_[a:b] == by_join[n] for n, (a, b) in ranges.items())
    some = sorted(ranges)[:3] + sorted(ranges)[-2:] + [OFFSET - 1]
    for n in some:
        found = edge_array.read_edge_range(spark, path, *ranges[n])
        assert sorted(map(tuple, found.collect()), key=lambda r: r[3]) == by_join[n]
    files = spark.read.parquet(f"{path}/index").orderBy("first").collect()
    assert len(files) > 1 and files[0]["first"] == 0 and all(a["last"] + 1 == b["first"] for a, b in zip(files, files[1:], strict=False))
    one = edge_array.read_edge_range(spark, path, 0, 2)
    assert len(one.inputFiles()) == 1 and "PushedFilters: [IsNotNull(position), GreaterThanOrEqual(position,0), LessThan(position,2)]" in one._jdf.queryExecution().executedPlan().toString()


def test_a_node_with_most_edges_lies_in_several_files(spark, tmp_path):
    adj = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("src"), F.col("id").alias("dst"), F.lit(1).alias("weight"))
    path = str(tmp_path / "array")
    edge_array.write_edge_array(adj, path)
    held = spark.read.parquet(f"{path}/index").where("first_src <= 7 AND last_src >= 7").count()
    assert held > 1 and edge_array.read_edge_array(spark, path).where("src = 7").count() == 2000
    assert edge_array.read_edge_range(spark, path, 5000, 6000).count() == 0
