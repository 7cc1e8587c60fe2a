"""Joins of facts to tables with one row per key.

They are plain equi-joins at every size: the engine broadcasts a side it finds small enough and
splits the partitions of a hot key at run time, which these joins allow, since the facts are the
side that may repeat a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_join(facts: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``facts`` (any number of rows per key) to ``table`` (one row per key).

    Facts without a key match nothing and, in a left join, stay.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join {how!r}")
    return facts.join(table, key, how).select(*facts.columns, *[c for c in table.columns if c != key])


def author_join(tweets: DataFrame, users: DataFrame) -> DataFrame:
    """Posts with their author's profile; posts of unknown authors drop out."""
    profile = users.select(
        "user_id", "followers", "following", "tweet_count", "verified", "created_at"
    )
    return lookup_join(tweets, profile, "user_id").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp")
    )


def retweet_info(retweets: DataFrame, retweeters: DataFrame, ref: Column) -> DataFrame:
    """Re-shares with a reference, joined to their sharer; ``ref`` yields the post shared."""
    profile = retweeters.select(
        "user_id", "followers", "following", "tweet_count", "verified", "created_at"
    )
    kept = retweets.where(F.col("referenced_tweets").isNotNull()).withColumn("ref_tweet_id", ref)
    return lookup_join(kept, profile, "user_id")


def cascade_join(tweets: DataFrame, info: DataFrame) -> DataFrame:
    """Every re-share beside the post it shares."""
    posts = tweets.withColumnRenamed("tweet_id", "ref_tweet_id")
    return lookup_join(info, posts, "ref_tweet_id")
