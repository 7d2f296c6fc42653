"""From accounts and posts to a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import (
    Graph,
    account_dictionary,
    edge_dates,
    explode_hashtags,
    hashtag_dictionary,
    orphan_posts,
    resolve_accounts,
)
from ..operators.ids import with_dense_id
from ..sources.shared import written


def build_graph(accounts: DataFrame, posts: DataFrame, orphans: str = "fail") -> Graph:
    """``accounts``: (name, followers, year_created), with account_id if they have ids, or with
    (file, position), as read with places, to number them in the order of their files, so that
    the first account of a name has its edges; ``posts``: (name, date, hashtags). Posts of unknown accounts fail the job or, with
    ``orphans="drop"``, are left out."""
    if "account_id" not in accounts.columns:
        placed = {"file", "position"} <= set(accounts.columns)
        accounts = with_dense_id(accounts, ["file", "position"] if placed else ["name", "followers", "year_created"], "account_id")
    names = account_dictionary(accounts)
    if orphans == "fail" and not orphan_posts(posts, names).isEmpty():
        raise ValueError("posts by unknown accounts")
    # Occurrences keep the tag's text until they are counted: ids join the smaller tables.
    found = written(resolve_accounts(explode_hashtags(posts), names).select("account_id", "hashtag", "date"), "occurrences")
    tags = written(hashtag_dictionary(found), "hashtags")
    n = F.count("*")
    edges = found.groupBy("account_id", "hashtag").agg(n.alias("weight"), n.alias("n_dates")).join(tags, "hashtag")
    dates = edge_dates(found.join(tags, "hashtag"))
    return Graph(
        accounts.select("account_id", "name", "followers", "year_created"),
        tags.select("hashtag_id", F.col("hashtag").alias("name")),
        edges.select("account_id", "hashtag_id", "weight", "n_dates"),
        dates,
    )


