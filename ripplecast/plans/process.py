"""Raw posts, users and re-shares to enriched yearly tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplecast.functions import text as tx
from ripplecast.functions import timeparts as tp
from ripplecast.functions import topics as tg
from ripplecast.functions.sentiment import sentiment_class, valences, with_compound
from ripplecast.models import features
from ripplecast.operators.filters import OUTLIER_BOUNDS, outlier_filter
from ripplecast.operators.joins import author_join, retweet_info
from ripplecast.operators.ordering import keep_first
from ripplecast.operators.reach import reshare_reach, total_reach
from ripplecast.session import stored
from ripplecast.sources.tables import scan_table, sink_by_year

PROCESSED_COLUMNS = [
    "tweet_id", "text", "timestamp", "user_id", "like_count", "retweet_count", "quote_count",
    "reply_count", "reach", "topics_ids", "topics", "topics_cleaned", "sentiment", "hashtags",
    "popularity", "followers", "following", "tweet_count", "verified", "created_at", "year",
    "month", "day_of_week", "day_phase", "week_idx", "seniority",
]


def time_parts(posts: DataFrame) -> DataFrame:
    stamp = F.col("timestamp")
    return posts.withColumns(
        {
            "year": F.year(stamp),
            "month": tp.month_name(stamp),
            "day_of_week": tp.weekday_name(stamp),
            "day_phase": tp.day_phase(stamp),
            "week_idx": tp.week_index(stamp),
        }
    )


def account_age(rows: DataFrame) -> DataFrame:
    """Creation date and whole years of age at the end of the row's year."""
    created = tp.date_only(F.col("created_at"))
    return rows.withColumn("created_at", created).withColumn(
        "seniority", tp.seniority(F.col("created_at"), F.year("timestamp"))
    )


def topic_columns(posts: DataFrame) -> DataFrame:
    """First topic with its id and group; posts without topics get the defaults."""
    first = {name: F.try_element_at(name, F.lit(1)) for name in ("topics", "topics_ids")}
    return posts.withColumns(
        {
            "topics_cleaned": tg.topic_group(first["topics"]),
            "topics": tg.topic_or_default(first["topics"]),
            "topics_ids": tg.topic_id_or_default(first["topics_ids"]),
        }
    )


def sentiment_column(posts: DataFrame, lexicon: DataFrame) -> DataFrame:
    scored = with_compound(posts, valences(lexicon), "_compound")
    return scored.withColumn("sentiment", sentiment_class(F.col("_compound"))).drop("_compound")


def one_profile(users: DataFrame) -> DataFrame:
    """The first profile of every user: by row number if there is one, else by a hash of the row."""
    ordinal = F.col("ordinal") if "ordinal" in users.columns else F.lit(None).cast("long")
    profile = users.select(
        "user_id", "followers", "following", "tweet_count", "verified", "created_at",
        ordinal.alias("ordinal"),
    )
    return keep_first(profile, "user_id", "ordinal")


def reshare_info(
    retweets: DataFrame, retweeters: DataFrame, ref: Column | None = None
) -> DataFrame:
    stored = tx.ref_tweet_id(F.col("referenced_tweets")) if ref is None else ref
    return account_age(retweet_info(retweets, retweeters, stored))


def enrich(
    tweets: DataFrame, users: DataFrame, info: DataFrame, lexicon: DataFrame
) -> DataFrame:
    """One wide row per post with a known author; one lazy plan.

    Posts meet their re-share totals on ``tweet_id`` and their authors on ``user_id``; all other
    columns come from the post itself.
    """
    first_ref = F.try_element_at("referenced_tweets", F.lit(1))["id"]
    has_topics = F.size("topics") > 0
    posts = tweets.withColumn("own_ref", F.coalesce(first_ref, F.lit(0)))
    posts = posts.join(reshare_reach(posts, info, has_topics), "tweet_id", "left")
    posts = author_join(sentiment_column(posts, lexicon), users)
    posts = posts.withColumns(
        {
            "reach": total_reach("followers", has_topics),
            "hashtags": tx.has_hashtag(F.col("text")),
            "popularity": tx.popularity(F.col("retweet_count")),
        }
    )
    return account_age(time_parts(topic_columns(posts))).select(*PROCESSED_COLUMNS)


def process(
    tweets: DataFrame,
    users: DataFrame,
    retweets: DataFrame,
    retweeters: DataFrame,
    lexicon: DataFrame,
    bounds: dict[str, float] = OUTLIER_BOUNDS,
) -> tuple[DataFrame, DataFrame]:
    """Processed posts without outliers, and re-share info."""
    info = reshare_info(retweets, one_profile(retweeters))
    return outlier_filter(enrich(tweets, one_profile(users), info, lexicon), bounds), info


def process_and_save(
    tweets: DataFrame,
    users: DataFrame,
    retweets: DataFrame,
    retweeters: DataFrame,
    lexicon: DataFrame,
    tweets_path: str,
    info_path: str,
) -> None:
    """Write both tables by year; posts carry both encodings of their categories.

    Re-share info is stored first and read for the posts' reach. Posts are stored once before they
    are encoded, so that the categories' values come from the few columns that hold them.
    """
    spark = tweets.sparkSession
    info = reshare_info(retweets, one_profile(retweeters)).withColumn("year", F.year("timestamp"))
    sink_by_year(info, info_path)
    known = scan_table(spark, info_path).select("ref_tweet_id", "followers")
    posts = stored(outlier_filter(enrich(tweets, one_profile(users), known, lexicon)), "posts")
    sink_by_year(features.encode(posts), tweets_path)
