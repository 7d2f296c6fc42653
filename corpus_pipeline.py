"""The corpus pipeline: five stages from raw documents to token counts.

Quality rules, line dedup, SimHash near-dedup, benchmark decontamination, BPE. Each
function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bpe, decontaminate, line_dedup, quality_rules, registry, similar_docs
from loomgraph.llm.common import discard, materialize, table

#: Near-duplicates share at least 0.8 of their shingles of five words.
SHINGLE, SIMILARITY = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.apply_quality_rules(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go, lines of few words too; a document that loses all
    has an empty text."""
    return line_dedup.dedup_lines(docs, min_words=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays. SimHash fingerprints link documents,
    Jaccard similarity confirms the links, and an exact join adds those that 64 bits can't show."""
    return similar_docs.keep_first(docs, size=SHINGLE, threshold=SIMILARITY)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contract's rule calls contaminated go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, one row per document."""
    return bpe.round_trip(docs, registry.tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("bpe", tokens),
]

#: SQL can express neither the tokens nor the components; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        try:
            kept = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        finally:
            discard(docs)  # a stage's table goes when the next one has read it, or failed
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
