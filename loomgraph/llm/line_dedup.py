"""Line deduplication as an exact set-similarity join.

A line is the set of its words. It goes if an earlier line of the corpus, by (doc_id,
line number), has a Jaccard similarity of at least the threshold with it; all lines are
judged on the input, not on what is left. Lines of fewer than ``min_words`` different
words stay and remove nothing; with 1, as in the query, only blank lines do.

Lines of equal word sets are found by their digests: the first of each set stands for it
in the join, the later ones go. The rest is the join of ``set_join``: words ordered by
rarity, prefix, length, positional and bitmap filters. Each line names one earlier
candidate for each shared word instead of all, so large groups of similar lines cost no
quadratic output. Jaccard is verified on the words themselves. Only lines whose candidates
all fail meet all their candidates, so nothing is missed.

Defined cases: a null text has no lines and stays null; rows without a doc_id stay as
they are and take no part; rows of one doc_id count as the same document; of lines at the
same place none is earlier; a doc_id that isn't a number is refused; an empty table gives an empty result; extra columns pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import set_join
from .common import discard, few, materialize, numbered
from .set_join import SHARD, read_lines

THRESHOLD = 0.8
MIN_WORDS = 5


def repeated_lines(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, buckets: int | None = None, shard: int = SHARD) -> DataFrame:
    """(doc_id, line): the lines to remove, numbered from 0, as a written table."""
    docs = numbered(docs).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranks = docs.sparkSession.sparkContext.broadcast(set_join.token_counts(docs, read_lines, buckets))
    lines = materialize(set_join.set_rows(docs, ranks, read_lines, threshold, min_words), "lines")
    first, equal, many = set_join.split_equal(lines)
    pairs = set_join.candidates(set_join.prefix_rows(first), threshold, shard)
    good = set_join.verified(docs, pairs, read_lines, threshold)
    gone = equal.union(good.select("doc_id", "line"))
    # Lines whose candidates all failed: look at all of theirs.
    failed = materialize(pairs.select("doc_id", "line").distinct().join(good, ["doc_id", "line"], "left_anti"), "lines-failed")
    used = [lines, many, pairs, good, failed]
    if not failed.isEmpty():
        more = set_join.all_candidates(first, failed, pairs, threshold)
        again = set_join.verified(docs, more, read_lines, threshold)
        gone = gone.union(again.select("doc_id", "line"))
        used += [more, again]
    out = materialize(gone.select("doc_id", F.col("line").cast("long").alias("line")).distinct(), "lines-gone")
    discard(*used)
    return out


def _by_document(gone: DataFrame) -> DataFrame:
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("lines"))  # at most a document's lines


def judge_lines(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_removed and the numbers of the removed lines."""
    gone = _by_document(repeated_lines(docs, **options))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(gone, "doc_id", "left")
    empty = F.array().cast("array<bigint>")
    return out.select("doc_id", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("lines", empty).alias("removed_lines"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the repeated lines; ``n_chars``, if there, follows the text. Texts
    aren't shuffled while the documents that lose lines are few."""
    gone = materialize(_by_document(repeated_lines(docs, **options)), "lines-of-documents")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("at"))
    d = whole.join(few(gone.withColumnRenamed("doc_id", "at"), lists="lines"), "at", "left")
    field = lambda c: F.col("doc").getField(c)
    kept = F.array_join(F.filter(F.split(field("text"), "\n"), lambda x, k: ~F.array_contains("lines", k.cast("long"))), "\n")
    d = d.select("doc", F.when(F.col("lines").isNull(), field("text")).otherwise(kept).alias("text"), F.col("lines").isNotNull().alias("changed"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(field("n_chars"))
    return d.select(*[new.get(c, field(c)).alias(c) for c in docs.columns])
