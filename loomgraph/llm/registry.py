"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_template, decontaminate, hard_negatives, html_text, language_id, line_dedup, prefix_trie, quality_rules, simhash, suffix_dedup, token_files, url_filters
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.filter_urls(pages, url_filters.listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_template.with_probe(table(spark, sf_dir, "conversations"))
    return chat_template.conversation_digests(chat_template.format_conversations(rows))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.judge_substrings(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.judge_lines(table(spark, sf_dir, "documents"), min_words=1)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))
    return trie.drop("enter", "leave")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), folder)
    return token_files.token_digests(manifest, folder)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_url_filters, op2_chat_format, op3_bpe, op4_simhash, op5_html_text, op6_suffix_dedup, op7_language_id, op8_line_dedup,
    op9_decontaminate, op10_quality_rules, op11_prefix_trie,
    op12_token_files, op13_hard_negatives,
)}
ORACLES: dict[str, str] = {
    "op1_url_filters": url_filters.SQL,
    "op2_chat_format": chat_template.SQL,
    "op10_quality_rules": quality_rules.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
