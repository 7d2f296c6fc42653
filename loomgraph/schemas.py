"""Schemas of the two input files."""

from pyspark.sql import types as T


def _strings(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names.split()])


#: Column names of the account and post files: fixed values of the file format.
ACCOUNTS_CSV = _strings(
    "userid user_display_name user_screen_name user_reported_location user_profile_description user_profile_url "
    "follower_count following_count account_creation_date account_language"
)
POSTS_CSV = _strings(
    "tweetid userid user_display_name user_screen_name user_reported_location user_profile_description user_profile_url "
    "follower_count following_count account_creation_date account_language tweet_language tweet_text tweet_time "
    "tweet_client_name in_reply_to_tweetid in_reply_to_userid quoted_tweet_tweetid is_retweet retweet_userid "
    "retweet_tweetid latitude longitude quote_count reply_count like_count retweet_count hashtags urls user_mentions "
    "poll_choices"
)
