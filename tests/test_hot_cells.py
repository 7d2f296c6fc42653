"""Cells, neighbours and lists when one key holds a third of all rows."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import blocks, graph, spatial
from loomgraph.queries import QUERIES

from .conftest import DATA

POINT = "node_id long, x double, y double"


def crowded(n=240):
    rng = random.Random(3)
    rows = [(k, rng.uniform(-4, 4), rng.uniform(-4, 4)) for k in range(n)]
    return rows + [(1000 + k, rng.uniform(1.0, 1.9), rng.uniform(-1.0, -0.1)) for k in range(n // 2)] + [(5000, None, 1.0), (5001, 1.5, -0.5), (5002, 1.5, -0.5)]


@pytest.mark.parametrize("bound", [512, 16])
def test_neighbours_of_a_crowded_cell(spark, bound):
    rows = crowded()
    want = set()
    for (i, x, y), (j, u, v) in itertools.permutations([r for r in rows if r[1] is not None], 2):
        if math.hypot(x - u, y - v) < 1.0:
            want.add((i, j, round(x - u, 9), round(y - v, 9)))
    owned = []
    got = spatial.neighbors_within(spark.createDataFrame(rows, POINT), 1.0, bound, owned).collect()
    assert len(got) == len(want) and {(r.i, r.j, round(r.dx, 9), round(r.dy, 9)) for r in got} == want and len(owned) == 1


def test_no_key_of_the_join_holds_a_crowded_cell(spark):
    d = spark.createDataFrame([r for r in crowded(900) if r[1] is not None], POINT)
    cells = spatial.counted_cells(d, 1.0, 32)
    assert cells.agg(F.max("n")).first()[0] > 400
    for side in spatial.meeting_blocks(d, cells, 1.0):
        assert side.groupBy(*spatial.MEET).count().agg(F.max("count")).first()[0] <= 2 * 32
    lone = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], POINT)
    left, right = spatial.meeting_blocks(lone, spatial.counted_cells(lone, 1.0), 1.0)
    assert left.count() == right.count() == 2  # cells without nodes are not visited


def test_blocks_of_a_hot_key_are_many_tasks_work(spark):
    rows = [("hot" if k % 3 else f"k{k % 7}", k) for k in range(4000)] + [("n", None), (None, 1)]
    d = spark.createDataFrame(rows, "key string, v long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        owned = []
        got = blocks.block_lists(d, ["key"], "v", "vs", 100, owned).collect()
        by_task = owned[0].groupBy("_p").agg(F.count_if(F.col("key") == "hot").alias("hot")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    whole = {}
    for r in sorted(got, key=lambda r: r.block):
        assert r.n == len(r.vs) <= 100
        whole.setdefault(r.key, []).extend(r.vs)
    want = {}
    for k, v in sorted(rows, key=lambda r: r[1] or 0):
        want.setdefault(k, []).append(v)
    assert whole == want and max(r.block for r in got) == 26
    assert sum(r.hot > 0 for r in by_task) >= 5 and max(r.hot for r in by_task) < 1000


def test_blocks_of_dates_and_cells(spark):
    occ = spark.createDataFrame([(1, 2, f"2020-01-{k % 28 + 1:02d}") for k in range(50)], "account_id long, hashtag_id long, date string").withColumn("date", F.col("date").cast("date"))
    rows = graph.edge_date_blocks(occ, 20).orderBy("block").collect()
    dates = [x for r in rows for x in r.dates]
    assert [r.n for r in rows] == [20, 20, 10] and dates == sorted(dates)
    assert graph.edge_date_blocks(occ.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pairs_of_few_bytes_are_many_tasks_work(spark, kind, monkeypatch):
    rows = [(k, x, y) for k, x, y in crowded(600) if x is not None]
    d = spark.createDataFrame([*rows, (None, 1.0, 0.0)], POINT).withColumn("node_id", F.col("node_id").cast(kind))
    monkeypatch.setattr(spatial, "TASK_PAIRS", 5000, raising=False)
    near = spatial.neighbors_within(d, 1.0, 32).withColumn("task", F.spark_partition_id()).collect()
    by_task = {}
    for r in near:
        by_task[r.task] = by_task.get(r.task, 0) + 1
    want = {(str(i), str(j)) for (i, x, y), (j, u, v) in itertools.permutations(rows, 2) if math.hypot(x - u, y - v) < 1.0}
    assert len(near) == len(want) and {(str(r.i), str(r.j)) for r in near} == want
    assert len(by_task) > 10 and max(by_task.values()) < len(near) / 5


def test_what_is_sent_grows_with_the_nodes(spark):
    def rows(n):
        d = spark.range(n).select(F.col("id").alias("node_id"), (4 * F.rand(1)).alias("x"), (4 * F.rand(2)).alias("y"))
        cells = spatial.counted_cells(d, 1.0, spatial.cell_bound(d, 1.0))
        return sum(side.count() for side in spatial.meeting_blocks(d, cells, 1.0))

    assert rows(160_000) < 5 * rows(40_000)  # blocks of 512 would be 20 a cell instead of 5


def test_distances_are_rounded_as_by_the_twin(spark, duck, monkeypatch):
    found = [k / 2e6 for k in range(400)] + [k / 997 / 20 for k in range(997)] + [0.49999999999999994e-6, 0.0499994999999999]
    d = spark.createDataFrame([(1, k, v) for k, v in enumerate(found)], "i long, j long, distance double")
    monkeypatch.setattr(spatial, "neighbors_within", lambda *a, **k: d)
    got = {r.j: r.distance for r in QUERIES["g8_neighbors_within"](spark, DATA).collect()}
    assert [got[k] for k in range(len(found))] == [duck.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchall()[0][0] for v in found]
