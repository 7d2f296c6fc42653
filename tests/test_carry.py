"""Values and sums carried over the borders of range partitions."""

import itertools
import random

import pytest

from loomgraph.operators import carry


@pytest.fixture(params=[1, 3, 40])
def parts(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_the_row_before(spark, parts):
    rng = random.Random(parts)
    rows = [(k, None if k % 7 == 3 else f"v{k}") for k in rng.sample(range(1000), 25)]
    owned = []
    got = carry.with_before(spark.createDataFrame(rows, "k long, v string"), ["k"], {"k": "k0", "v": "v0"}, owned).orderBy("k").collect()
    rows.sort()
    assert [tuple(r) for r in got] == [(*b, *a) for a, b in zip([(None, None), *rows], rows, strict=False)]
    assert len(owned) == 1
    assert carry.with_before(spark.createDataFrame([], "k long, v string"), ["k"], {"v": "v0"}).count() == 0


def test_sums_of_groups_over_many_partitions(spark, parts):
    rng = random.Random(7)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3]), k, rng.randint(-5, 9)) for k in range(300)]
    got = carry.with_group_sums(spark.createDataFrame(rows, "g long, k long, v long"), ["g"], ["k"], {"s": carry.F.col("v"), "n": carry.F.lit(1)}).collect()
    want = []
    for _, part in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), key=lambda r: r[0]):
        s = 0
        for n, r in enumerate(part, 1):
            s += r[2]
            want.append((*r, s, n))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
