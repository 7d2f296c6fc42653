"""Graphs in versioned folders: a graph is there whole or not at all.

``path/data/<version>`` has one Parquet table for each part. A version exists once its
manifest ``path/versions/<number>.json`` does, with the folder, the rows and a digest of
each table. A manifest is written aside and renamed, to a number that is free; so a write
that breaks off leaves the last version as it was, of two writers one takes the next
number, and readers keep the version that they began with.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph, graph_summary
from .shared import delete, store

TABLES = ("accounts", "hashtags", "edges", "edge_dates")


class GraphError(ValueError):
    """No whole graph at a path."""


def table_digest(df: DataFrame) -> tuple[int, str]:
    """(rows, sum of row hashes): the same however rows are ordered or partitioned."""
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)"))).first()
    return n, str(total or 0)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, folder = store(spark, f"{path}/versions")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _publish(spark: SparkSession, path: str, manifest: dict) -> int:
    aside = f"{path}/versions/.{uuid.uuid4().hex}"
    fs, jaside = store(spark, aside)
    out = fs.create(jaside, False)
    out.write(bytearray(json.dumps(manifest, indent=1).encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jaside.toUri(), spark._jsc.hadoopConfiguration()) if jaside.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    number = max(_numbers(spark, path), default=0) + 1
    while True:  # another writer may take the number first
        to = jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{number:08d}.json")
        if not fs.exists(to):
            context.rename(jaside, to, none)  # fails if it is there by now
            return number
        number += 1


def write_graph(graph: Graph, path: str) -> int:
    """Write all parts and publish them as the next version, whose number is returned. What is
    digested is what was written, read back."""
    spark, data = graph.edges.sparkSession, f"data/{uuid.uuid4().hex}"
    try:
        tables = {}
        for name in TABLES:
            getattr(graph, name).write.parquet(f"{path}/{data}/{name}")
            back = spark.read.parquet(f"{path}/{data}/{name}")
            tables[name] = dict(zip(("rows", "digest"), table_digest(back), strict=True)) | {"schema": back.schema.simpleString()}
        whole = Graph(**{name: spark.read.parquet(f"{path}/{data}/{name}") for name in TABLES})
        return _publish(spark, path, {"data": data, "tables": tables, "summary": graph_summary(whole).first().asDict()})
    except BaseException:
        delete(spark, f"{path}/{data}")
        raise


def read_manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of a version, of the last one if none is named."""
    numbers = _numbers(spark, path)
    if not numbers or version is not None and version not in numbers:
        raise GraphError(f"no whole graph {'' if version is None else f'of version {version} '}in {path}")
    number = numbers[-1] if version is None else version
    text = "".join(r.value for r in spark.read.option("wholetext", True).text(f"{path}/versions/{number:08d}.json").collect())
    return json.loads(text) | {"version": number}


def read_graph(spark: SparkSession, path: str, version: int | None = None, digests: bool = False) -> Graph:
    """A version of the graph. Schemas and row counts are held against the manifest, from the
    files' footers; with ``digests`` the rows too."""
    manifest = read_manifest(spark, path, version)
    parts = {name: spark.read.parquet(f"{path}/{manifest['data']}/{name}") for name in TABLES}
    for name, df in parts.items():
        want = manifest["tables"][name]
        found = table_digest(df) if digests else (df.count(), want["digest"])
        if found != (want["rows"], want["digest"]) or df.schema.simpleString() != want["schema"]:
            raise GraphError(f"{name} in {path} isn't what version {manifest['version']} says")
    return Graph(**parts)


def expire_graphs(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Delete all versions but the last ``keep``, manifests first; return their numbers. Data of
    broken writes that no manifest names goes too, so no write may be under way."""
    numbers = _numbers(spark, path)
    kept = numbers[max(0, len(numbers) - keep) :]
    named = {read_manifest(spark, path, n)["data"].rpartition("/")[2] for n in kept}
    gone = [n for n in numbers if n not in kept]
    for n in gone:
        delete(spark, f"{path}/versions/{n:08d}.json")
    fs, folder = store(spark, f"{path}/data")
    for f in fs.listStatus(folder) if fs.exists(folder) else []:
        if f.getPath().getName() not in named:
            fs.delete(f.getPath(), True)
    return gone
