"""The trie of conversations' shared prefixes, by an Euler tour.

Turns are numbered where they lie in sorted range partitions, and a prefix is known by a
running sum of digests of (depth, role, text), four numbers of 32 bits cut from hashes; so
a long conversation is summed in parts, by the tasks that hold them. Rows with the same
depth and sums are one node, known from then on by its smallest conversation and depth.

Subtree sums come from an Euler tour: each node has an arc that enters it and one that
leaves it. An arc's predecessor follows from its siblings, its parent or its children. The
tour is ranked in two steps. Arcs are range-partitioned by conversation, where runs of
neighbouring arcs mostly lie together, and each partition ranks its own runs; then the
runs, much fewer, are ranked over all partitions by pointer jumping, a join a round, in
a number of rounds logarithmic in the number of runs. Prefix sums at a node's two arcs give
its leaves and savings.

Defined cases: rows without a conv_id take no part; a null role or text is empty; a null
turn comes first; rows of one turn are ordered by a digest of role and text; a table
without conversations has no node, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.carry import sorted_ranges, with_before, with_group_sums
from ..sources.shared import discard as discard_owned
from .common import discard, materialize

SUMS = ["s0", "s1", "s2", "s3"]
#: Bits of a run's number that tell runs of one partition apart, arcs ranked at once in a task, bytes of ids in a piece.
RUN_BITS, SLAB, PIECE = 36, 1 << 20, 1 << 20


def rebuilt_turns(conversations: DataFrame, owned: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The contract's rebuilding, as (conv_id, depth, c0, c1, chars) and (conv_id, n_turns): the first
    h turns of the conversation that begins the hundred, then the own turns after the first h."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256)
    part = lambda k: F.conv(F.substring(digest, 15 * k + 1, 15), 16, 10).cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part(0).alias("c0"), part(1).alias("c1"), F.length(text).cast("long").alias("chars")
    )
    turns = with_group_sums(rows, ["conv_id"], ["turn", "c0", "c1"], {"place": F.lit(1)}, owned).drop("turn")
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("own"))
    base, shared = F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % 6
    sizes = materialize(sizes.withColumns({"base": base, "h": shared}), "trie-sizes")
    bases = sizes.where(F.col("conv_id") == F.col("base")).select("base", F.col("own").alias("base_own"))
    convs = sizes.join(bases, "base", "left")
    taken = F.least("h", F.coalesce("base_own", F.lit(0)))
    convs = convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns"))
    convs = materialize(convs, "trie-conversations")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "c0", "c1", "chars")
    first = turns.where("place <= 5 AND conv_id % 100 = 0").withColumnRenamed("conv_id", "base")
    given = first.join(convs.where("taken > 0").select("conv_id", "base", "taken"), "base").where("place <= taken")
    given = given.select("conv_id", F.col("place").alias("depth"), "c0", "c1", "chars")
    rebuilt = materialize(own.union(given), "trie-turns")
    discard(sizes)
    return rebuilt, convs.select("conv_id", "n_turns")


def prefixes(turns: DataFrame, owned: list[DataFrame]) -> DataFrame:
    """``turns`` with the sums s0 .. s3 of their prefix, and p0 .. p3 of the prefix before."""
    halves: dict[str, Column] = {}
    for k, h in enumerate((F.xxhash64("c0", "c1", "depth"), F.xxhash64(F.lit(1), "c1", "depth", "c0"))):
        halves[SUMS[2 * k]], halves[SUMS[2 * k + 1]] = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))
    turns = turns.withColumns({f"own_{s}": c for s, c in halves.items()})
    d = with_group_sums(turns, ["conv_id"], ["depth"], {s: F.col(f"own_{s}") for s in SUMS}, owned)
    return d.select("conv_id", "depth", "chars", *SUMS, *[(F.col(s) - F.col(f"own_{s}")).alias(f"p{k}") for k, s in enumerate(SUMS)])


def trie_nodes(turns: DataFrame, sizes: DataFrame, owned: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, chars, s0 .. s3), the root included, and
    (s0 .. s3, depth, conv_id) of each conversation's last turn."""
    rows = materialize(prefixes(turns, owned), "trie-prefixes")
    found = rows.groupBy("depth", *SUMS).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), *[F.min(f"p{k}").alias(f"p{k}") for k in range(4)]
    )
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("conv_id IS NOT NULL")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("depth"), *[zero.alias(s) for s in SUMS], "conv_id", "n_convs", zero.alias("chars"), *[zero.alias(f"p{k}") for k in range(4)])
    found = materialize(found.unionByName(root), "trie-found")
    parent = found.select((F.col("depth") + 1).alias("depth"), *[F.col(s).alias(f"p{k}") for k, s in enumerate(SUMS)], F.col("conv_id").alias("parent_conv_id"))
    nodes = found.join(parent, ["depth", "p0", "p1", "p2", "p3"], "left")
    nodes = materialize(nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "chars", *SUMS), "trie-nodes")
    last = rows.join(sizes, "conv_id").where("depth = n_turns").select(*SUMS, "depth", "conv_id")
    none = sizes.where("n_turns = 0").select(*[zero.alias(s) for s in SUMS], zero.alias("depth"), "conv_id")
    ends = materialize(last.union(none), "trie-ends")
    discard(rows, found)
    return nodes, ends


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, s0 .. s3, ends_sha256). Ids are sorted and joined into pieces in the range partitions
    where they lie; only the pieces of one node meet, in order, in the task that digests them."""
    key = ["depth", *SUMS]
    kinds = "".join(f"{c} bigint, " for c in key)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in key]
            ids = batch.column("conv_id").to_pylist()
            change = np.zeros(len(ids), dtype=bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts = np.union1d(np.flatnonzero(change), np.arange(0, len(ids), PIECE // 20))
            begins, stops = cuts, np.append(cuts[1:], len(ids))
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(begins, stops, strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(c[begins]) for c in columns], pa.array([ids[a] for a in begins], pa.int64()), pa.array(texts, pa.string())], names=[*key, "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in key], batch.column("ids").to_pylist(), strict=True):
                if row[:-1] == at:
                    state.update(b"," + row[-1].encode())
                else:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = row[:-1], hashlib.sha256(row[-1].encode())
            if len(out) >= 10_000:
                yield _batch(out, [*key, "ends_sha256"])
                out = []
        if at is not None:
            out.append((*at, state.hexdigest()))
        if out:
            yield _batch(out, [*key, "ends_sha256"])

    pieces = sorted_ranges(ends, [*key, "conv_id"]).drop("_p").mapInArrow(joined, f"{kinds}first bigint, ids string")
    return pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digested, f"{kinds}ends_sha256 string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)


def tour_arcs(nodes: DataFrame, owned: list[DataFrame]) -> DataFrame:
    """(conv_id, depth, side, pred_conv, pred_depth, pred_side, leaves, saved): the arcs that enter
    (0) and leave (1) each node, and the arc before each: a tour in which children come by
    conv_id. Entering a node counts it as a leaf, if it is one, and what it saves."""
    near = with_before(nodes.drop(*SUMS), ["depth", "parent_conv_id", "conv_id"], {"depth": "d0", "parent_conv_id": "q0", "conv_id": "before"}, owned)
    near = near.withColumn("before", F.when((F.col("d0") == F.col("depth")) & (F.col("q0") == F.col("parent_conv_id")), F.col("before"))).drop("d0", "q0")
    below = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    d = near.join(below.agg(F.max("conv_id").alias("last_child"), F.count("*").alias("n_children")), ["conv_id", "depth"], "left")
    leaf = F.col("last_child").isNull()
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    first = F.col("before").isNull()
    enter = F.struct(
        zero.alias("side"), F.coalesce("before", "parent_conv_id").alias("pred_conv"), F.when(first, F.col("depth") - 1).otherwise(F.col("depth")).alias("pred_depth"),
        F.when(first, zero).otherwise(one).alias("pred_side"), F.when(leaf, one).otherwise(zero).alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    leave = F.struct(
        one.alias("side"), F.coalesce("last_child", "conv_id").alias("pred_conv"), F.when(leaf, F.col("depth")).otherwise(F.col("depth") + 1).alias("pred_depth"),
        F.when(leaf, zero).otherwise(one).alias("pred_side"), zero.alias("leaves"), zero.alias("saved"),
    )
    return d.select("conv_id", "depth", F.explode(F.array(enter, leave)).alias("arc")).select("conv_id", "depth", "arc.*")


ARC = ["conv_id", "depth", "side"]
PRED = ["pred_conv", "pred_depth", "pred_side"]
WEIGHTS = ["place", "leaves", "saved"]


def _runs(slab: pa.Table, partition: int, first_run: int) -> tuple[pa.Table, int]:
    """Arcs of one task with the run that each is in, and the sums of its run up to it."""
    conv, depth, side = (slab[c].combine_chunks().to_numpy() for c in ARC)
    before = [slab[c].combine_chunks() for c in PRED]
    none = before[0].is_null().to_numpy(zero_copy_only=False)
    pred_conv, pred_depth, pred_side = (c.fill_null(-1).to_numpy() for c in before)
    known = np.unique(conv)
    wide = 2 * (int(depth.max()) + 2)
    code = np.searchsorted(known, conv) * wide + 2 * depth + side
    at = np.minimum(np.searchsorted(known, pred_conv), len(known) - 1)
    there = ~none & (known[at] == pred_conv) & (pred_depth <= depth.max())
    want = np.where(there, at * wide + 2 * pred_depth + pred_side, -1)
    by = np.argsort(code)
    found = by[np.minimum(np.searchsorted(code, want, sorter=by), len(code) - 1)]
    up = np.where(there & (code[found] == want), found, -1)
    tail = np.ones(len(up), dtype=bool)
    tail[up[up >= 0]] = False
    head = up < 0
    # Pointer jumping within the task: sums over the arcs up to and including each.
    sums = np.stack([np.ones(len(up), dtype=np.int64), slab["leaves"].combine_chunks().to_numpy(), slab["saved"].combine_chunks().to_numpy()])
    top, jump = np.where(head, np.arange(len(up)), up), up.copy()
    while (live := np.flatnonzero(jump >= 0)).size:
        to = jump[live]
        sums[:, live] += sums[:, to].copy()
        top[live] = top[to]
        jump[live] = jump[to]
    names = np.cumsum(head) - 1 + first_run
    run = (partition << RUN_BITS) + names[top]
    columns = {c: slab[c] for c in [*ARC, *PRED]} | {"run": pa.array(run)} | {c: pa.array(x) for c, x in zip(WEIGHTS, sums, strict=True)}
    return pa.table(columns | {"head": pa.array(head), "tail": pa.array(tail)}), first_run + int(head.sum())


def ranked(arcs: DataFrame, slab: int = SLAB) -> DataFrame:
    """(conv_id, depth, side, place, leaves, saved) of each arc, summed from the tour's start."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = runs = 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal runs
            table = pa.Table.from_batches(held)
            out, runs = _runs(table, table["_p"][0].as_py(), runs)
            yield from out.to_batches()

        for batch in batches:
            for lo in range(0, batch.num_rows, slab):
                part = batch.slice(lo, slab)
                if n and n + part.num_rows > slab:
                    yield from done()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield from done()

    placed = sorted_ranges(arcs, ARC)
    kinds = ", ".join(f"{c} bigint" for c in [*ARC, *PRED, "run", *WEIGHTS])
    parts = materialize(placed.mapInArrow(local, f"{kinds}, head boolean, tail boolean"), "trie-runs")
    ends = parts.where("tail").select(*[F.col(c).alias(p) for c, p in zip(ARC, PRED, strict=True)], F.col("run").alias("before"), *[F.col(c).alias(f"_{c}") for c in WEIGHTS])
    heads = parts.where("head").select("run", *PRED).join(ends, PRED, "left")
    zero = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(0).cast("long")).alias(c)
    jumps = materialize(heads.select("run", "before", *[zero(c) for c in WEIGHTS]), "trie-jumps")
    # Every round doubles the runs that a jump passes over.
    while not (open_ := jumps.where("before IS NOT NULL")).isEmpty():
        there = jumps.select(F.col("run").alias("before"), F.col("before").alias("_before"), *[F.col(c).alias(f"_{c}") for c in WEIGHTS])
        passed = open_.join(there, "before").select("run", F.col("_before").alias("before"), *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in WEIGHTS])
        after = materialize(passed.union(jumps.where("before IS NULL")), "trie-jumps")
        discard(jumps)
        jumps = after
    starts = jumps.select("run", *[F.col(c).alias(f"_{c}") for c in WEIGHTS])
    out = parts.select(*ARC, "run", *WEIGHTS).join(starts, "run").select(*ARC, *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in WEIGHTS])
    out = materialize(out, "trie-ranked")
    discard(parts, jumps)
    return out


def subtree_sums(arcs: DataFrame, slab: int = SLAB) -> DataFrame:
    """(conv_id, depth, enter, leave, n_leaves, saved_tokens): places of a node's two arcs in the
    tour, and what the tour adds from the one to the other."""
    sums = ranked(arcs, slab)
    side = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    own = arcs.where("side = 0").select("conv_id", "depth", F.col("leaves").alias("own_leaves"), F.col("saved").alias("own_saved"))
    d = sums.groupBy("conv_id", "depth").agg(
        side(0, "place").alias("enter"), side(1, "place").alias("leave"),
        (side(1, "leaves") - side(0, "leaves")).alias("l"), (side(1, "saved") - side(0, "saved")).alias("s"),
    )
    d = d.join(own, ["conv_id", "depth"])
    return d.select("conv_id", "depth", "enter", "leave", (F.col("l") + F.col("own_leaves")).alias("n_leaves"), (F.col("s") + F.col("own_saved")).alias("saved_tokens"))


def prefix_trie(conversations: DataFrame, slab: int = SLAB) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and the places enter and leave of its arcs. A written table."""
    owned: list[DataFrame] = []
    turns, sizes = rebuilt_turns(conversations, owned)
    nodes, ends = trie_nodes(turns, sizes, owned)
    arcs = materialize(tour_arcs(nodes, owned), "trie-arcs")
    sums = materialize(subtree_sums(arcs, slab), "trie-sums")
    below = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    out = nodes.join(sums, ["conv_id", "depth"]).join(below, ["conv_id", "depth"], "left").join(end_digests(ends), ["depth", *SUMS], "left")
    empty = hashlib.sha256().hexdigest()
    out = out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), "enter", "leave",
    )
    out = materialize(out, "trie")
    discard(turns, nodes, ends, arcs, sums)
    discard_owned(*owned)
    return out


#: crc32 by its definition, a bit at a time: the polynomial is a fixed value.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
SQL = f"""
WITH turns AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT c, own, {_CRC} % 6 AS h FROM turns),
whole AS (SELECT a.c, list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) AS seq FROM heads a LEFT JOIN turns b ON b.c = a.c - a.c % 100),
steps AS (SELECT c, seq, d, seq[1:d] AS pre FROM whole, range(0, 100000) r(d) WHERE d <= len(seq)),
nodes AS (SELECT d AS depth, pre, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * (CASE WHEN d = 0 THEN 0 ELSE length(any_value(pre[d].t)) END) AS saved,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(seq) = d), '')) AS ends_sha256 FROM steps GROUP BY d, pre),
kids AS (SELECT n.depth, n.pre, n.conv_id, p.conv_id AS parent_conv_id, n.n_convs, n.saved, n.ends_sha256, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.pre[1:n.depth] = n.pre) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND n.pre[1:p.depth] = p.pre)
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, sum((m.n_children = 0)::INT)::BIGINT AS n_leaves, sum(m.saved)::BIGINT AS saved_tokens, n.ends_sha256
FROM kids n JOIN kids m ON m.depth >= n.depth AND m.pre[1:n.depth] = n.pre GROUP BY ALL
"""
