"""Row filters and fixed projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecast.functions.numeric import all_below, percent, round_half_even

# Default outlier bounds and the other sets that were tried.
OUTLIER_BOUNDS = {
    "followers": 100000, "following": 30000, "retweet_count": 1000, "like_count": 400,
    "seniority": 17,
}
OUTLIER_TRIALS = [
    {"followers": 10000, "following": 70000, "retweet_count": 100, "like_count": 500,
     "seniority": 17},
    {"followers": 100000, "following": 70000, "retweet_count": 100, "like_count": 500,
     "seniority": 17},
    {"followers": 100000, "following": 30000, "retweet_count": 100, "like_count": 400,
     "seniority": 17},
    OUTLIER_BOUNDS,
    {"followers": 5000, "following": 5000, "retweet_count": 1000, "like_count": 400,
     "seniority": 17},
    {"retweet_count": 5},
]

# Columns of the post profiles.
ANALYSIS_COLUMNS = [
    "text", "year", "day_phase", "day_of_week", "month", "retweet_count", "quote_count",
    "like_count", "reply_count", "sentiment", "hashtags", "topics_cleaned", "reach",
]


def collection_filter(posts: DataFrame) -> DataFrame:
    """English posts from the US without links that are neither re-shares nor replies."""
    return posts.where(
        (F.col("lang") == "en")
        & (F.col("place_country") == "US")
        & ~F.col("text").rlike("https?://")
        & ~F.col("tweet_type").isin("Retweet Tweet", "Reply Tweet")
    )


def share_candidates(posts: DataFrame) -> DataFrame:
    """Posts with topics that were re-shared at least once."""
    return posts.where((F.size("topics") > 0) & (F.col("retweet_count") > 0))


def known_topic(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("topics_ids") != -1)


def outlier_filter(posts: DataFrame, bounds: dict[str, float] = OUTLIER_BOUNDS) -> DataFrame:
    return posts.where(all_below(bounds))


def outlier_report(posts: DataFrame, bounds: dict[str, float] = OUTLIER_BOUNDS) -> DataFrame:
    """What the filter keeps and removes, in one pass."""
    kept = all_below(bounds)
    shared = F.col("retweet_count") > 0
    counts = posts.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(kept).alias("rows_kept"),
        F.count_if(shared).alias("shared"),
        F.count_if(shared & kept).alias("shared_kept"),
    )
    kept_share = F.try_divide(F.col("rows_kept"), F.col("rows"))
    shared_share = F.try_divide(F.col("shared_kept"), F.col("shared"))
    return counts.select(
        (round_half_even(kept_share, 4) * 100).alias("pct_kept"),
        round_half_even((1 - kept_share) * 100, 4).alias("pct_removed"),
        "rows_kept",
        "shared_kept",
        round_half_even((1 - shared_share) * 100, 4).alias("pct_shared_removed"),
    )


def retweets_with_ref(retweets: DataFrame) -> DataFrame:
    return retweets.where(F.col("referenced_tweets").isNotNull())


def popular_filter(posts: DataFrame, above: int) -> DataFrame:
    return posts.where(F.col("retweet_count") > above)


def popular_share(posts: DataFrame, above: int = 10) -> DataFrame:
    """Share of the re-shared posts that were re-shared more than ``above`` times."""
    counts = F.count_if(F.col("retweet_count") > above), F.count_if(F.col("retweet_count") > 0)
    return posts.agg(percent(*counts).alias("pct_popular"))


def analysis_projection(posts: DataFrame) -> DataFrame:
    return posts.select(*ANALYSIS_COLUMNS)


def year_slice(posts: DataFrame, year: int) -> DataFrame:
    return posts.where(F.col("year") == year)
