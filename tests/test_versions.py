"""Graphs that are whole or absent, and ids that never change."""

import datetime
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import ids
from loomgraph.plans.ingest import build_graph
from loomgraph.sources import graphs


@pytest.fixture
def made(spark):
    def make(n):
        day = datetime.date(2020, 1, 1)
        accounts = spark.createDataFrame([(k, f"a{k}", k, 2012) for k in range(n)], "account_id long, name string, followers long, year_created int")
        posts = spark.createDataFrame([(f"a{k}", day, f"[t{k % 3}, é{k}]") for k in range(n)], "name string, date date, hashtags string")
        return build_graph(accounts, posts)

    return make


def test_versions_and_old_readers(spark, made, tmp_path):
    path = f"file://{tmp_path}/g"
    with pytest.raises(graphs.GraphError):
        graphs.read_graph(spark, path)
    assert graphs.write_graph(made(3), path) == 1
    old = graphs.read_graph(spark, path, digests=True)
    assert graphs.write_graph(made(5), path) == 2
    assert old.accounts.count() == 3 == graphs.read_graph(spark, path, version=1).accounts.count()
    assert graphs.read_graph(spark, path).accounts.count() == 5
    assert graphs.read_manifest(spark, path)["summary"]["n_edges"] == 10
    assert graphs.expire_graphs(spark, path) == [1] and len(os.listdir(f"{tmp_path}/g/data")) == 1
    with pytest.raises(graphs.GraphError):
        graphs.read_graph(spark, path, version=1)
    assert graphs.read_graph(spark, path, digests=True).edges.count() == 10


def test_a_broken_write_leaves_the_last_version(spark, made, tmp_path, monkeypatch):
    path = str(tmp_path / "g")
    graphs.write_graph(made(3), path)
    broken = made(4)
    broken.edge_dates = broken.edge_dates.withColumn("date", F.raise_error(F.lit("lost")).cast("date"))
    with pytest.raises(Exception, match="lost"):
        graphs.write_graph(broken, path)
    monkeypatch.setattr(graphs, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        graphs.write_graph(made(4), path)
    assert len(os.listdir(tmp_path / "g/data")) == 1 and graphs.read_graph(spark, path).accounts.count() == 3


def test_a_number_that_is_taken(spark, made, tmp_path, monkeypatch):
    path = str(tmp_path / "g")
    graphs.write_graph(made(2), path)
    monkeypatch.setattr(graphs, "_numbers", lambda *a: [])  # as a writer sees it that looked before
    assert graphs.write_graph(made(3), path) == 2


def test_damaged_tables_do_not_load(spark, made, tmp_path):
    path = str(tmp_path / "g")
    graphs.write_graph(made(4), path)
    folder = glob.glob(f"{path}/data/*/accounts")[0]
    kept = spark.read.parquet(folder).collect()
    swapped = spark.createDataFrame(kept, spark.read.parquet(folder).schema).withColumn("name", F.lit("x"))
    swapped.write.mode("overwrite").parquet(folder)
    assert graphs.read_graph(spark, path).accounts.count() == 4
    with pytest.raises(graphs.GraphError):
        graphs.read_graph(spark, path, digests=True)
    spark.createDataFrame(kept[:2], swapped.schema).write.mode("overwrite").parquet(folder)
    with pytest.raises(graphs.GraphError):
        graphs.read_graph(spark, path)


def test_ids_under_growth(spark):
    rng = random.Random(1)
    batches = [[(rng.choice([None, *(f"k{x}" for x in range(40 + 30 * b))]), f"f{b}", k) for k in range(60)] for b in range(3)]
    known = spark.createDataFrame([], "key string, id long")
    seen = []
    for rows in [*batches, batches[0], []]:
        known = ids.extend_ids(known, spark.createDataFrame(rows, "key string, file string, position long"), "key", "id", ["file", "position"])
        seen.append({r.key: r.id for r in known.collect()})
        assert len(seen[-1]) == known.count()
    for a, b in zip(seen, seen[1:], strict=False):
        assert a.items() <= b.items()
    firsts = list(dict.fromkeys(k for rows in batches for k, *_ in rows if k is not None))
    assert seen[-1] == {k: n for n, k in enumerate(firsts)}
