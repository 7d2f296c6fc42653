"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, NumericType

#: Characters that separate words: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs``, whose doc_id is a number; a ValueError before any task if it isn't."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, NumericType | NullType):
        raise ValueError(f"doc_id must be a number, not {kind.simpleString()}")
    return docs


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset, as in
    local tests, a temporary folder is made and set.
    """
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


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a
    lost executor costs a reread of this table, not what came before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomgraph_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_loomgraph_path", None)
        if path is None:
            continue
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: Rows of a side that is broadcast, and elements of its lists.
FEW, FEW_ELEMENTS = 300_000, 2_000_000


def few(df: DataFrame, limit: int = FEW, lists: str | None = None) -> DataFrame:
    """``df``, a written table, broadcast if it has at most ``limit`` rows and, with ``lists``,
    at most FEW_ELEMENTS elements in that column; both are counted before."""
    rows, elements = df.agg(F.count("*"), F.sum(F.size(lists)) if lists else F.lit(0)).first()
    return F.broadcast(df) if rows <= limit and (elements or 0) <= FEW_ELEMENTS else df


def text_bytes(texts: pa.Array, chars: int = 60_000, table: bytes | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, ends) for runs of texts of about so many bytes, few enough that their
    arrays stay in the cache; null is empty. ``table`` translates bytes."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chars, side="right")) - 1)
        a, b = int(offsets[lo]), int(offsets[hi])
        raw = data.slice(a, b - a).to_pybytes() if b > a else b""
        yield lo, np.frombuffer(raw.translate(table), dtype=np.uint8), offsets[lo + 1 : hi + 1] - a
        lo = hi


def trimmed_words(text) -> F.Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text column; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))
