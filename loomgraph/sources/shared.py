"""Written intermediate tables, in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the context's checkpoint folder; only where
    both are unset on a local master, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        set_by_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_by_context.isDefined():
            return set_by_context.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/graph/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table: its lineage ends there, and it is computed once."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def store(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path, as JVM objects."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def delete(spark: SparkSession, path: str) -> None:
    fs, jpath = store(spark, path)
    fs.delete(jpath, True)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_written_path", None)
        if path is not None:
            delete(df.sparkSession, path)
