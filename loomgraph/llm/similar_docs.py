"""Near-duplicate documents by SimHash, confirmed and completed by exact Jaccard similarity.

Documents of equal shingle sets are one. The others have a SimHash fingerprint of their
shingles; BK-trees link fingerprints of few differing bits, and links between documents
whose shingles reach the threshold of Jaccard similarity hold.

A fingerprint of 64 bits can't settle a similarity of 0.8: such texts differ in about ten
bits, with a wide spread. So an exact join finds what the radius leaves out, among
documents that fingerprints haven't put into one component: as the lines are in line
dedup, a document is the set of its shingles, and documents propose, for each shared rare
shingle, a spanning forest of the pairs that pass the filters; proposals that reach the
threshold are linked. Where one fails, the documents that share its shingles and are still
in different components meet once more, all with all. So the components are those of all
pairs that reach the threshold, while a large group of near copies costs no quadratic output.

Defined cases: all null and blank texts are equal to each other and to nothing else; a
text of fewer words than a shingle is one shingle; rows without a doc_id stay; doc_id
names one text and is a number, else refused; an empty table gives an empty result; extra columns pass through,
whatever their names.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import set_join, simhash
from .common import discard, few, materialize, numbered
from .graph import connected_components

SHINGLE = 5
THRESHOLD = 0.8


def fingerprint_pairs(texts: DataFrame, first: DataFrame, size: int = SHINGLE, radius: int = simhash.RADIUS) -> DataFrame:
    """Pairs of documents of ``first`` that BK-trees of their fingerprints link, as a written table:
    a spanning forest of all links within the radius, and each document with the first of its
    fingerprint."""
    fps = materialize(simhash.fingerprints(texts, size).join(first.select("doc_id"), "doc_id"), "similar-fp")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "similar-fp-nodes")
    edges = materialize(simhash.near_edges(nodes.select("fp"), radius), "similar-fp-edges")
    u, v = nodes.select(F.col("fp").alias("u"), F.col("least").alias("a")), nodes.select(F.col("fp").alias("v"), F.col("least").alias("b"))
    linked = edges.join(u, "u").join(v, "v").select("a", "b").union(fps.join(nodes, "fp").select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
    line = F.lit(0).cast("int")
    pairs = linked.where("a <> b").select(F.greatest("a", "b").alias("doc_id"), line.alias("line"), F.least("a", "b").alias("doc_id0"), line.alias("line0"))
    out = materialize(pairs.distinct(), "similar-fp-pairs")
    discard(fps, nodes, edges)
    return out


def _labels(roots: DataFrame) -> DataFrame:
    return materialize(roots.where("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("q")), "similar-labels")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of different components, as a written table."""
    side = few(labels)
    d = pairs.join(side, "doc_id", "left").join(side.toDF("doc_id0", "q0"), "doc_id0", "left")
    return materialize(d.where(F.coalesce("q", "doc_id") != F.coalesce("q0", "doc_id0")).select(*set_join.PAIR), "similar-apart")


def later_copies(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, shard: int = set_join.SHARD, buckets: int | None = None) -> DataFrame:
    """(doc_id): documents that are not the first of their component, as a written table."""
    texts = numbered(docs).where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    read = partial(set_join.read_shingles, size=size)
    ranks = docs.sparkSession.sparkContext.broadcast(set_join.token_counts(texts, read, buckets))
    sets = materialize(set_join.set_rows(texts, ranks, read, threshold), "similar")
    first, equal, many = set_join.split_equal(sets)
    edges = [F.col("doc_id").alias("u"), F.col("doc_id0").alias("v")]
    near = fingerprint_pairs(texts, first, size)
    linked = set_join.verified(texts, near, read, threshold)
    roots = materialize(connected_components(linked.select(*edges)).distinct(), "similar-roots")
    labels = _labels(roots)
    # What fingerprints left apart: the exact join.
    every = set_join.candidates(set_join.prefix_rows(first), threshold, shard, forest=True)
    pairs = _apart(every, labels)
    good = set_join.verified(texts, pairs, read, threshold)
    used = [sets, many, near, linked, roots, labels, every, pairs, good]
    good = linked.union(good)
    roots = materialize(connected_components(good.select(*edges)).distinct(), "similar-roots")
    failed = materialize(pairs.join(good, set_join.PAIR, "left_anti"), "similar-failed")
    used.append(failed)
    if not failed.isEmpty():
        labels = _labels(roots)
        more = set_join.candidates_apart(first, failed, labels, threshold)
        found = set_join.verified(texts, more, read, threshold)
        used += [labels, more, found]
        if not found.isEmpty():
            used.append(roots)
            roots = materialize(connected_components(good.union(found).select(*edges)).distinct(), "similar-roots")
    gone = equal.select("doc_id").union(roots.where("node <> root").select(F.col("node").alias("doc_id")))
    out = materialize(gone.distinct(), "similar-gone")
    discard(roots, *used)
    return out


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One document of each component stays, that with the least doc_id; columns as they
    came. Texts aren't shuffled while the documents that go are few."""
    gone = later_copies(docs, **options).withColumnRenamed("doc_id", "at")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("at"))
    kept = whole.join(few(gone), "at", "left_anti")
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
