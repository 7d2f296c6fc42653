"""Hard negatives against brute force and the SQL twin."""

import math
import random

import numpy as np
import pytest

from loomgraph.llm import hard_negatives

ROWS = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, positives=5, negatives=3):
    """By hand, over whole rows; equal rows count once."""
    rows = {(i, tuple(v) if v is not None else None, y) for i, v, y, *_ in rows if i is not None and y is not None}
    rows = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in rows:
        if a[0] % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in rows if b is not a and len(b[2]) == len(a[2]))
        for ps, p, _ in [x for x in scored if x[2] == a[1]][:positives]:
            fits = [x for x in scored if x[2] != a[1] and 50 * -ps <= 100 * -x[0] <= 95 * -ps]
            out += [(a[0], p, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    d = spark.createDataFrame([(*r, "x") for r in rows], ROWS)
    got = hard_negatives.mine_embeddings(d, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("block", [4096, 40])
def test_against_brute_force(spark, block):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0.1, 0.3) for _ in range(9)], rng.choice([0, 0, 0, 0, 1, 2, 9])) for k in range(260)]
    rows += [rows[3], rows[50], (None, [0.5] * 9, 1), (301, None, 1), (302, [0.5] * 8 + [None], 1), (303, [0.5] * 8 + [math.nan], 1), (304, [math.inf] * 9, 1), (305, [0.5] * 9, None)]
    rows += [(350, [0.5, 0.25], 1), (351, [0.5, 0.25], 1), (352, [0.25, 0.25], 2), (400, [], 1), (401, [], 1), (402, [], 2)]
    got = mined(spark, rows, block=block)
    assert got == brute(rows) and len(got) > 40


def test_ties_and_copies(spark):
    rows = [(k, [0.5, 0.5], 3) for k in range(0, 120)] + [(k, [0.4, 0.4], 4) for k in range(200, 330)]
    got = mined(spark, rows, block=16)
    assert got == brute(rows) and got[0][:4] == (0, 7, 1, 203)  # 0 and 7 are moved to label 4, as is 203 to 5


def test_large_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([-1, 1]) * rng.uniform(1e4, 4e5) for _ in range(6)], k % 3) for k in range(160)]
    assert mined(spark, rows, block=64) == brute(rows) != []


def test_packed_products():
    rng = np.random.default_rng(5)
    for low, high, dim in ((-128, 128, 64), (0, 1, 3), (-5, 70000, 16), (-(1 << 28), 1 << 28, 7), (9, 10, 4)):
        a, c = (rng.integers(low, high, (n, dim)).astype(float) for n in (5, 23))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in c] for p in a]
        assert hard_negatives.packed_products(a, c).tolist() == want
    with pytest.raises(OverflowError):
        hard_negatives.packed_products(np.full((1, 2), 2.0**40), np.full((2, 2), 2.0**40) * [[1], [0]])


def test_no_rows(spark):
    assert mined(spark, []) == [] == mined(spark, [(50, None, 1)])
