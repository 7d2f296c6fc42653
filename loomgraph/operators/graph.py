"""From accounts and tag occurrences to a weighted, dated, bipartite graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import hashtag_array
from .blocks import BLOCK, block_lists
from .ids import with_dense_id, with_running_sum


@dataclass
class Graph:
    """accounts(account_id, name, followers, year_created), hashtags(hashtag_id, name),
    edges(account_id, hashtag_id, weight, n_dates), edge_dates(account_id, hashtag_id, date)."""

    accounts: DataFrame
    hashtags: DataFrame
    edges: DataFrame
    edge_dates: DataFrame


def explode_hashtags(posts: DataFrame) -> DataFrame:
    """(name, date, hashtag): a row for each occurrence of a tag in a post."""
    return posts.select("name", "date", F.explode(hashtag_array(F.col("hashtags"))).alias("hashtag"))


def account_dictionary(accounts: DataFrame) -> DataFrame:
    """(name, account_id): the first account of a name; others stay nodes without edges."""
    return accounts.groupBy("name").agg(F.min("account_id").alias("account_id"))


def hashtag_dictionary(occurrences: DataFrame) -> DataFrame:
    """(hashtag, hashtag_id): dense ids by the text of the tag."""
    return with_dense_id(occurrences.select("hashtag").distinct(), ["hashtag"], "hashtag_id")


def resolve_accounts(occurrences: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Occurrences with the account_id of their name; Spark broadcasts a small dictionary."""
    return occurrences.join(dictionary, "name")


def orphan_posts(posts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Posts by names that no account has."""
    return posts.join(dictionary, "name", "left_anti")


def edge_weights(occurrences: DataFrame) -> DataFrame:
    """(account_id, hashtag_id, weight, n_dates): both count the occurrences of the pair.
    Grouping by the pair spreads a frequent tag over its accounts."""
    n = F.count("*")
    return occurrences.groupBy("account_id", "hashtag_id").agg(n.alias("weight"), n.alias("n_dates"))


def edge_dates(occurrences: DataFrame) -> DataFrame:
    """One row for each occurrence, so that a heavy edge is no giant array."""
    return occurrences.select("account_id", "hashtag_id", "date")


def edge_date_lists(occurrences: DataFrame) -> DataFrame:
    """The dates of each edge in one sorted array, for edges known to be of modest weight."""
    return occurrences.groupBy("account_id", "hashtag_id").agg(F.sort_array(F.collect_list("date")).alias("dates"), F.count("*").alias("n_dates"))


def edge_date_blocks(occurrences: DataFrame, size: int = BLOCK, owned: list[DataFrame] | None = None) -> DataFrame:
    """(account_id, hashtag_id, block, n, dates): the dates of each edge in blocks of at most ``size``,
    in order, for edges of any weight."""
    return block_lists(occurrences, ["account_id", "hashtag_id"], "date", "dates", size, owned)


def degrees(edges: DataFrame) -> DataFrame:
    """(kind, id, n_edges) of both sides; every edge is one neighbour on either side."""
    a = edges.groupBy(F.col("account_id").alias("id")).agg(F.count("*").alias("n_edges"))
    h = edges.groupBy(F.col("hashtag_id").alias("id")).agg(F.count("*").alias("n_edges"))
    return a.select(F.lit("account").alias("kind"), "*").union(h.select(F.lit("hashtag").alias("kind"), "*"))


def with_degree(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes with n_edges, zero for those without edges."""
    d = edges.groupBy(key).agg(F.count("*").alias("n_edges"))
    return nodes.join(d, key, "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def graph_summary(graph: Graph) -> DataFrame:
    """One row: counts of the parts and the bytes of all names."""
    bytes_ = F.coalesce(F.sum(F.octet_length("name")), F.lit(0)).alias("b")
    a = graph.accounts.agg(F.count("*").alias("n_accounts"), bytes_.alias("ab"))
    h = graph.hashtags.agg(F.count("*").alias("n_hashtags"), bytes_.alias("hb"))
    e = graph.edges.agg(F.count("*").alias("n_edges"))
    d = graph.edge_dates.agg(F.count("*").alias("n_edge_dates"))
    one = a.join(F.broadcast(h)).join(F.broadcast(e)).join(F.broadcast(d))  # one row each
    return one.select("n_accounts", "n_hashtags", "n_edges", "n_edge_dates", (F.col("ab") + F.col("hb")).alias("n_name_bytes"))


def build_nodes(accounts: DataFrame, hashtags: DataFrame, offset: int) -> DataFrame:
    """(node_id, kind, name, followers, year_created): tags follow the accounts' ids."""
    a = accounts.select(F.col("account_id").alias("node_id"), F.lit("account").alias("kind"), "name", "followers", "year_created")
    h = hashtags.select((F.col("hashtag_id") + offset).alias("node_id"), F.lit("hashtag").alias("kind"), "name")
    return a.unionByName(h, allowMissingColumns=True)


def draw_edges(edges: DataFrame, offset: int) -> DataFrame:
    """(src, dst, weight), account to tag."""
    return edges.select(F.col("account_id").alias("src"), (F.col("hashtag_id") + offset).alias("dst"), "weight")


def mirror_edges(edges: DataFrame, offset: int) -> DataFrame:
    """Each edge in both directions, for sums over neighbours."""
    one = draw_edges(edges, offset)
    return one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def adjacency_ranges(nodes: DataFrame) -> DataFrame:
    """Nodes (node_id, n_edges) with the range [start_pos, end_pos) of their neighbours in
    an edge array ordered by node."""
    d = with_running_sum(nodes, ["node_id"], F.col("n_edges"), "start_pos")
    return d.withColumn("end_pos", F.col("start_pos") + F.col("n_edges"))
