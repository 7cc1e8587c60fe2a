"""Reach: people a post could be seen by, through its author and its re-shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplecast.operators.joins import lookup_join


def author_followers(tweets: DataFrame, users: DataFrame) -> DataFrame:
    """Add ``author_followers``, 0 for unknown authors."""
    audience = users.select("user_id", F.col("followers").alias("author_followers"))
    return lookup_join(tweets, audience, "user_id", "left").fillna(0, ["author_followers"])


def _spreads(has_topics: Column) -> Column:
    return F.coalesce(has_topics & (F.col("retweet_count") > 0), F.lit(False))


def reshare_reach(
    tweets: DataFrame, info: DataFrame, has_topics: Column, own_ref: str = "own_ref"
) -> DataFrame:
    """(tweet_id, reshare_reach): followers of the accounts that re-shared a post.

    Followers are summed once per shared post. A post gets its own sum and, if it spreads itself
    and refers to another post, that one's; both are totalled before the posts themselves move.
    """
    # both uses below then read the same aggregate, which Spark runs once
    shares = info.where(F.col("ref_tweet_id").isNotNull())
    sums = shares.groupBy("ref_tweet_id").agg(F.sum("followers").alias("_sum"))
    other = (F.col(own_ref) != 0) & (F.col(own_ref) != F.col("tweet_id"))
    links = tweets.where(_spreads(has_topics) & other).select(
        "tweet_id", F.col(own_ref).alias("ref_tweet_id")
    )
    through_other = lookup_join(links, sums, "ref_tweet_id").select("tweet_id", "_sum")
    through_own = sums.select(F.col("ref_tweet_id").alias("tweet_id"), "_sum")
    return (
        through_own.unionByName(through_other)
        .groupBy("tweet_id")
        .agg(F.sum("_sum").alias("reshare_reach"))
    )


def total_reach(author: str, has_topics: Column) -> Column:
    """Posts without topics or re-shares reach their author's followers only."""
    shared = F.when(_spreads(has_topics), F.col("reshare_reach"))
    return F.coalesce(author, F.lit(0)) + F.coalesce(shared, F.lit(0))


def tweet_reach(
    tweets: DataFrame,
    users: DataFrame,
    info: DataFrame,
    has_topics: Column,
    own_ref: str = "own_ref",
) -> DataFrame:
    """Add ``reach``: followers of the author and of everyone who re-shared."""
    return (
        author_followers(tweets, users)
        .join(reshare_reach(tweets, info, has_topics, own_ref), "tweet_id", "left")
        .withColumn("reach", total_reach("author_followers", has_topics))
        .drop("author_followers", "reshare_reach")
    )
