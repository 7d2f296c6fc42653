"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees.

Fingerprints are 64 bits. Neighbours are found by BK-trees: children are keyed by their
integer Hamming distance to the parent, and a search follows only edges within the radius.

Which trees a fingerprint searches is a matter of routing. Two that differ in at most
``radius`` bits agree on at least one of radius + 1 bit blocks, so members are dealt out by
each of their blocks, and every block's value has a tree: five tables at radius 4, trees of
about n / 7,000 members. When those would exceed ``TREE`` members, two or more blocks must
agree (``blocks_kept``). All trees of a task are built and searched level by level, as arrays.

A tree of more than ``shard`` fingerprints is split: its members are dealt into shards by
hash, each shard has a tree of its own, and every pair of shards meets in a task of its own.
So trees and groups are bounded, and no link is lost. Trees are built in the tasks that
search them; a broadcast of all trees would grow with the corpus.

Of the links found in a tree the edges of a spanning forest go on, at most one for each
member, never all pairs. Connected components of those edges are the groups. Equal
fingerprints are one node, however many documents have them.

Defined cases: a null or blank text has the fingerprint zero, linked like any other; a
text of fewer words than a shingle is one shingle; repeated rows are one node; a null
doc_id gets a component too, and is never its least member unless it is alone; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few, materialize
from .graph import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints in one tree at most.
SHARD = 4096
#: Fingerprints in a tree on average at most, if they were random.
TREE = 2048


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    first = [0, *(ends[: n - 1] + 1).tolist()]
    last = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed bigint."""
    d = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(t, size)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return d.mapInArrow(run, f"doc_id {d.schema[0].dataType.simpleString()}, fp bigint")


def bucket_masks(radius: int = RADIUS, kept: int = 3) -> list[int]:
    """Masks of every choice of ``kept`` of radius + kept bit blocks: two fingerprints
    within the radius differ in at most ``radius`` blocks, so they agree on the rest."""
    blocks = radius + kept
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(c)) for c in combinations(masks, kept)]


def blocks_kept(n: int, radius: int = RADIUS) -> int:
    """How many blocks agree in a table, so that trees of n random fingerprints stay small."""
    return next((k for k in range(1, radius + 1) if n / 2 ** (64 * k / (radius + k)) <= TREE), radius)


class BkForest:
    """BK-trees of many groups as arrays, built and searched a level at a time.

    ``members`` holds unsigned fingerprints, distinct within a group, and ``group`` ascends.
    Node k is members[k]; the first of a group is its tree's root."""

    def __init__(self, members: np.ndarray, group: np.ndarray):
        self.members = members
        first = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.empty(0, bool)
        self.roots = np.flatnonzero(first)
        above = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0)) if len(group) else np.empty(0, np.int64)
        rest = np.flatnonzero(~first)
        at = above[rest]
        kids, codes = [], []
        while len(rest):
            # Of the members at one distance from a node the first is its child; the others go below it.
            code = at * 65 + np.bitwise_count(members[rest] ^ members[at])
            by = np.argsort(code, kind="stable")
            rest, code = rest[by], code[by]
            head = np.concatenate([[True], code[1:] != code[:-1]])
            kids.append(rest[head])
            codes.append(code[head])
            at = rest[np.maximum.accumulate(np.where(head, np.arange(len(rest)), 0))][~head]
            rest = rest[~head]
        self.depth = len(kids)
        kid, code = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (kids, codes))
        by = np.argsort(code)
        #: Children by (parent, distance).
        self.kids, self.codes = kid[by], code[by]
        self.visited = 0

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, nodes within the radius), level by level from each query's root."""
        q, node = np.arange(len(queries)), roots
        while len(q):
            self.visited += len(q)
            distance = np.bitwise_count(queries[q] ^ self.members[node]).astype(np.int64)
            near = distance <= radius
            yield q[near], node[near]
            # Only edges whose key is within the radius of the distance can lead to a neighbour.
            lo = np.searchsorted(self.codes, node * 65 + np.maximum(distance - radius, 0))
            n = np.searchsorted(self.codes, node * 65 + np.minimum(distance + radius, 64), side="right") - lo
            q = np.repeat(q, n)
            node = self.kids[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(q))]


class _Union:
    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = int(up[x])
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the pairs, and note an edge for each that joins two trees."""
        x, y = self.up[a], self.up[b]
        open_ = x != y
        for x, y in zip(a[open_].tolist(), b[open_].tolist(), strict=True):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                self.edges.append((x, y))
        if open_.any():
            while (self.up[self.up] != self.up).any():
                self.up = self.up[self.up]


#: Queries of a group of many members that search at once; they may all be neighbours.
_QUERIES = 128


def group_edges(members: np.ndarray, group: np.ndarray, owner: np.ndarray, radius: int = RADIUS) -> tuple[list[tuple[int, int]], BkForest | None]:
    """(edges, trees): pairs of indexes that join what all pairs (any member, owner of its
    group) within the radius join. ``owner`` marks the members that the trees hold."""
    members = members.astype(np.int64).view(np.uint64)
    held = np.flatnonzero(owner)
    if not len(held):
        return [], None
    trees = BkForest(members[held], group[held])
    root = np.full(int(group[-1]) + 1, -1)
    root[group[held][trees.roots]] = trees.roots
    ask = np.flatnonzero(root[group] >= 0)
    size = np.bincount(group)[group[ask]]
    ask = ask[np.argsort(size, kind="stable")]
    bound = np.searchsorted(np.sort(size), 4 * _QUERIES)
    union = _Union(len(members))
    at = 0
    while at < len(ask):
        part = ask[at : min(at + 20_000, bound) if at < bound else at + _QUERIES]
        for q, node in trees.search(members[part], root[group[part]], radius):
            union.link(part[q], held[node])
        at += len(part)
    return union.edges, trees


def spanning_edges(members: np.ndarray, owners: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """As group_edges, for one group, of which ``owners`` are the indexes in the tree."""
    owner = np.zeros(len(members), dtype=bool)
    owner[owners] = True
    return group_edges(members, np.zeros(len(members), dtype=np.int64), owner, radius)[0]


def near_edges(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(u, v) edges whose components are those of all pairs within the radius. ``fps`` has
    one bigint column fp without repeats; it should be a written table."""
    masks = bucket_masks(radius, blocks_kept(fps.count(), radius))
    table = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(table).alias("b")).select("b.t", "b.key", "fp")
    # Trees over the bound: few, and known by key. Counting combines before the shuffle.
    hot = materialize(keyed.groupBy("t", "key").count().where(F.col("count") > shard), "simhash-hot")

    def work(rows: np.ndarray) -> pa.RecordBatch:
        group = np.concatenate([[0], np.cumsum((rows[1:, :4] != rows[:-1, :4]).any(axis=1))])
        edges = group_edges(rows[:, 4], group, rows[:, 5] > 0, radius)[0]
        x, y = np.array(edges, dtype=np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(rows[x, 4]), pa.array(rows[y, 4])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for b in batches:
            held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]))
            n += b.num_rows
            if n > 50_000:
                rows = np.concatenate(held)
                cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
                end = int(cuts[-1]) if len(cuts) else 0
                if end:
                    yield work(rows[:end])
                held, n = [rows[end:]], 0
        if held and len(rows := np.concatenate(held)):
            yield work(rows)

    # Columns i, j name the pair of shards that meet; the tree holds shard j.
    zero = F.lit(0).cast("long")
    one = keyed.select(F.col("t").cast("long").alias("t"), "key", zero.alias("i"), zero.alias("j"), "fp", F.lit(1).cast("long").alias("owner"))
    if not hot.isEmpty():
        small_hot = few(hot)
        one = one.join(small_hot.select(F.col("t").cast("long"), "key"), ["t", "key"], "left_anti")
        dealt = keyed.join(small_hot, ["t", "key"]).withColumn("n", F.ceil(F.col("count") / shard * 1.25).cast("long"))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(zero, F.col("n") - 1)))
        one = one.union(dealt.select(
            F.col("t").cast("long"), "key", F.greatest("own", "other"), F.least("own", "other"), "fp",
            (F.col("own") <= F.col("other")).cast("long"),
        ))
    placed = one.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "fp")
    return placed.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """One row per document: doc_id, fp (signed bigint), component_id (the least doc_id
    that it reaches over links between fingerprints)."""
    fps = materialize(fingerprints(docs, size), "simhash-fp")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    edges = near_edges(nodes.select("fp"), radius, shard)
    roots = materialize(connected_components(edges), "simhash-roots")
    # Least doc_id of each component: per fingerprint first, then per root.
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    member = materialize(member, "simhash-members")
    least = materialize(member.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    labels = materialize(member.join(least, "root").select("fp", "component_id"), "simhash-labels")
    discard(roots, nodes, member, least)
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each group stays, that with the least doc_id; columns as they came.
    Rows without a doc_id stay: they can't be told apart by one."""
    found = near_duplicates(docs.where(F.col("doc_id").isNotNull()), size, radius)
    gone = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias("at")).distinct(), "simhash-gone")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("at"))
    return whole.join(few(gone), "at", "left_anti").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def hex_fingerprint(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
