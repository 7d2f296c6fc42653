import glob
import os
import sys
import tempfile

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def canonical(rows):
    def one(v):
        if isinstance(v, float):
            return round(v, 6) + 0.0
        return "NULL" if v is None else v

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compare a query with its SQL twin on the smallest tables."""

    def check(query, sql):
        mine = query(spark, DATA)
        names = sorted(mine.columns)
        twin = duck.sql(sql)
        assert names == sorted(twin.columns)
        mine = [tuple(r[n] for n in names) for r in mine.collect()]
        theirs = duck.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
        assert canonical(mine) == canonical(theirs)

    return check
