"""Reading account and post files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import creation_year, post_date
from ..schemas import ACCOUNTS_CSV, POSTS_CSV
from .split_csv import read_csv


def read_accounts(spark: SparkSession, path: str, places: bool = False) -> DataFrame:
    """(name, followers, year_created); columns that aren't kept aren't parsed. With ``places``
    also (file, position), the order of the rows."""
    d = read_csv(spark, path, ACCOUNTS_CSV)
    order = [F.col("_file").alias("file"), F.col("_position").alias("position")] if places else []
    return d.select(
        F.col("user_display_name").alias("name"),
        F.expr("try_cast(follower_count AS bigint)").alias("followers"),
        creation_year(F.col("account_creation_date")).alias("year_created"),
        *order,
    )


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """(name, date, hashtags)."""
    d = read_csv(spark, path, POSTS_CSV)
    return d.select(F.col("user_display_name").alias("name"), post_date(F.col("tweet_time")).alias("date"), "hashtags")
