"""Pages as the collection API returns them: nested posts with the users they include."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplecast import schemas
from ripplecast.functions import text as tx
from ripplecast.functions.timeparts import to_utc


def read_tweet_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TWEET_PAGE).json(path)


def read_user_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.USER_PAGE).json(path)


def extract_tweet(posts: DataFrame, post: str = "tweet") -> DataFrame:
    """Flat post columns from the struct column ``post``."""
    field = F.col(post)
    metrics = field["public_metrics"]
    return posts.select(
        field["id"].try_cast("long").alias("tweet_id"),
        field["text"].alias("text"),
        field["author_id"].try_cast("long").alias("user_id"),
        to_utc(field["created_at"]).alias("timestamp"),
        tx.tweet_type(field["referenced_tweets"]).alias("tweet_type"),
        *[metrics[name].alias(name)
          for name in ("like_count", "reply_count", "retweet_count", "quote_count")],
        tx.device_class(field["source"]).alias("device"),
        field["lang"].alias("lang"),
        tx.topic_ids_of(field["context_annotations"]).alias("topics_ids"),
        tx.topic_names_of(field["context_annotations"]).alias("topics"),
        tx.ref_list(field["referenced_tweets"]).alias("referenced_tweets"),
    )


def extract_user(users: DataFrame, user: str = "user", keep: Sequence[str] = ()) -> DataFrame:
    """Flat user columns from the struct column ``user``, and the columns of ``keep``."""
    field = F.col(user)
    metrics = field["public_metrics"]
    return users.select(
        field["id"].try_cast("long").alias("user_id"),
        field["name"].alias("name"),
        field["username"].alias("username"),
        metrics["followers_count"].alias("followers"),
        metrics["following_count"].alias("following"),
        metrics["tweet_count"].alias("tweet_count"),
        field["verified"].alias("verified"),
        to_utc(field["created_at"]).alias("created_at"),
        *keep,
    )


def include_user_match(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(tweet, user) per post: the page's last included user with the author's id, or null.

    Author and post share a page, so the match needs no shuffle, and posts are matched before the
    page is taken apart: a post takes its author along and not the page's list of users.
    """
    last_first = F.reverse(F.col("includes")["users"])
    place = lambda post: F.array_position("_ids", post["author_id"])
    matched = F.transform(
        "data", lambda post: F.struct(post.alias("tweet"), F.get("_users", (place(post) - 1).cast("int")).alias("user"))
    )
    return (
        pages.withColumn("_users", last_first)
        .withColumn("_ids", F.transform("_users", lambda user: user["id"]))
        .select(F.explode(matched).alias("_match"), *keep)
        .select("_match.tweet", "_match.user", *keep)
    )


def normalize_api(pages: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Post rows and, one per post with a known author, user rows with the columns of ``keep``."""
    matched = include_user_match(pages, keep)
    return extract_tweet(matched), extract_user(matched.where(F.col("user").isNotNull()), keep=keep)


def normalize_users(pages: DataFrame) -> DataFrame:
    return extract_user(pages.select(F.explode("data").alias("user")))
