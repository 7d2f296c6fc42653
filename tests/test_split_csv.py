"""Quoted files cut anywhere, against the reader that doesn't cut."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from loomgraph.sources import split_csv

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b", "c")])


def field(rng):
    kind = rng.random()
    if kind < 0.3:
        return rng.choice(["x", "", "word", "é", "15"])
    inner = "".join(rng.choice(["a", "\n", '""', ",", " ", "é", "\n\n", "longer text "]) for _ in range(rng.randint(0, 30)))
    return f'"{inner}"'


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def unsplit(spark, path):
    whole = spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return sorted((tuple(r) for r in whole.collect()), key=repr)


def test_files_cut_in_small_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(4)
    for k in range(3):
        rows = ["a,b,c", *(",".join(["id" + str(n), field(rng), field(rng)]) for n in range(60))]
        (tmp_path / f"{k}.csv").write_text("\n".join(rows) + ("\n" if k else ""), encoding="utf-8")
    d = split_csv.read_csv(spark, str(tmp_path), SCHEMA)
    got = d.collect()
    assert sorted((tuple(r)[:3] for r in got), key=repr) == unsplit(spark, str(tmp_path))
    for name in {r._file for r in got}:
        own = sorted((r._position, r.a) for r in got if r._file == name)
        assert [a for _, a in own] == [f"id{n}" for n in range(60)] and len({p for p, _ in own}) == 60
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20  # each file is many tasks' work


def test_a_field_over_many_ranges(spark, tmp_path, small_ranges):
    long = "line, of text\n" * 60
    (tmp_path / "x.csv").write_text(f'a,b,c\n1,"{long}",z\r\n\n2,"q""q",\n3,,"{long}"', encoding="utf-8")
    got = [tuple(r)[:3] for r in split_csv.read_csv(spark, str(tmp_path), SCHEMA).orderBy("_position").collect()]
    assert got == [("1", long, "z"), ("2", 'q"q', None), ("3", None, long)]


def test_headers_of_their_own_and_nothing(spark, tmp_path):
    (tmp_path / "h.csv").write_text('"a\nx",b,c\n1,2,3\n')
    (tmp_path / "only.csv").write_text("a,b,c\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "open.csv").write_text('a,b,c\n5,"never\nends')
    assert {r.record for r in split_csv.records(spark, str(tmp_path)).collect()} == {"1,2,3", '5,"never\nends'}
    assert {r.a for r in split_csv.read_csv(spark, str(tmp_path), SCHEMA).collect()} == {"1", "5"}


def test_cutting_takes_batches_not_lines():
    """A range's whole records come as arrays, two a batch at most, and each pass sends only its own kind."""
    lines = [x for n in range(500) for x in (f'{n},"a', 'b",c')]
    odd = ['tail of another"', *lines, 'x,"open']
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(part), pa.array(["f"] * len(part)), pa.array([7] * len(part)), pa.array([1] * len(part), pa.int32())], names=["value", "file", "block", "state"])
    for size in (1, 3, len(odd)):
        parts = [batch(odd[k : k + size]) for k in range(0, len(odd), size)]
        whole, broken = list(split_csv._cut(iter(parts), whole=True)), list(split_csv._cut(iter(parts), whole=False))
        got = [(r["seq"], r["record"], r["begins"], r["ends"]) for b in whole + broken for r in b.to_pylist()]
        records = [(n + 1, f'{n},"a\nb",c', True, True) for n in range(500)]
        assert got == [*records, (0, odd[0], False, True), (501, odd[-1], True, False)]
        assert len(whole) <= 2 * len(parts)
