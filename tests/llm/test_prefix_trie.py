"""The prefix trie against brute force and the SQL twin."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from loomgraph.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string, depth int, side string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not kids[p]
        saved[p] += (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if seqs[c] == p).encode()).hexdigest())
        for p, m in members.items()
    )


def found(spark, rows, **options):
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS).repartition(3)
    got = [r.asDict() for r in prefix_trie.prefix_trie(d, **options).collect()]
    for r in got:
        r["parent_conv_id"] = -1 if r["parent_conv_id"] is None else r["parent_conv_id"]
    # The tour nests: arcs are places 1 .. 2 n, and a subtree lies between its node's two arcs.
    assert sorted(x for r in got for x in (r["enter"], r["leave"])) == list(range(1, 2 * len(got) + 1))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[n] for n in names) for r in got)


def made(seed, n, hot=False):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(900), n):
        turns = [0, 1, 2] if hot and rng.random() < 0.4 else [rng.randint(0, 3) for _ in range(rng.randint(1, 9))]
        rows += [(c, k, ("user", "assistant")[k % 2], f"t{t}" * t) for k, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("slab", [1 << 20, 7])
def test_against_brute_force(spark, slab):
    rows = made(1, 90, hot=True)
    assert found(spark, rows, slab=slab) == brute(rows)


def test_nulls_ties_and_turnless(spark):
    rows = [(None, 0, "user", "lost"), (101, None, None, "x"), (101, 0, "user", None), (101, 0, "user", "y"), (100, 3, "user", "é\n"), (100, 1, None, None), (205, 0, "u", "one"), (204, 0, "u", "one"), (310, 0, "a", "b"), (310, 0, "a", "b"), (307, 1, "ab", ""), (308, 1, "a", "b")]
    got = found(spark, rows)
    # Rows of one turn that differ: any order would do, so only what doesn't depend on it is compared.
    assert [r[:6] for r in got if r[0] != 101] == [r[:6] for r in brute(rows) if r[0] != 101]
    plain = [r for r in rows if r[0] != 101]
    assert found(spark, plain) == brute(plain)


def test_one_long_conversation_over_many_partitions(spark):
    rows = [(500, k, "u", f"w{k % 3}") for k in range(400)] + [(c, k, "u", f"w{k % 3}") for c in (501, 502) for k in range(300)] + [(7, 0, "u", "z")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert found(spark, rows, slab=50) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_copies_and_nothing(spark):
    rows = [(c, k, "u", "same") for c in range(300, 360) for k in range(8)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] == found(spark, [(None, 1, "u", "x")])
