"""Engagement profiles per year and category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplecast.functions.numeric import engagement_rate, percent, round_half_even
from ripplecast.functions.text import COVID_KEYWORDS, keyword_match
from ripplecast.session import cut_lineage


def on_spine(
    df: DataFrame, key: str, categories: Sequence, measures: dict[str, Column]
) -> DataFrame:
    """(year, ord, key, total, measures) with every listed category in every year.

    Values off the list are folded into one leftover group before the aggregate, so a year's
    map holds at most one entry per listed category. ``total`` is the year's row count over the
    listed categories; a category absent from a year has null measures.
    """
    place = F.when(F.col(key).isin(list(categories)), F.col(key))
    cells = df.groupBy("year", place.alias(key)).agg(
        F.count(F.lit(1)).alias("_n"), *[m.alias(name) for name, m in measures.items()]
    )
    return cells_on_spine(cells, key, categories, list(measures), "_n")


def cells_on_spine(
    cells: DataFrame, key: str, categories: Sequence, measures: Sequence[str], rows: str
) -> DataFrame:
    """The same from (year, key, measures) cells, of which ``rows`` holds the row counts."""
    listed = [F.lit(category) for category in categories]
    known = F.col(key).isin(list(categories))
    entry = F.when(known, F.struct(F.col(key).alias("_cat"), F.struct(*measures).alias("_cell")))
    years = cells.groupBy("year").agg(
        F.map_from_entries(F.collect_list(entry)).alias("_cells"),
        F.sum(F.when(known, F.col(rows))).alias("total"),
    )
    return years.select(
        "year", "total", "_cells", F.posexplode(F.array(*listed)).alias("ord", key)
    ).select(
        "year",
        "ord",
        key,
        "total",
        *[F.try_element_at("_cells", F.col(key))[name].alias(name) for name in measures],
    )


def grouped_cells(
    df: DataFrame, sets: Sequence[Sequence[str]], measures: dict[str, Column]
) -> dict[tuple[str, ...], DataFrame]:
    """The measures of several groupings by year and keys, from one pass over the rows.

    The cells of all sets are one checkpointed table, which is as small as the reports.
    """
    keys = list(dict.fromkeys(key for one in sets for key in one))
    columns = ["year", *keys]
    cells = cut_lineage(
        df.groupingSets([["year", *one] for one in sets], *columns).agg(
            F.grouping_id(*columns).alias("_set"), *[m.alias(name) for name, m in measures.items()]
        )
    )

    def number(one: Sequence[str]) -> int:
        return sum((key not in one) << place for place, key in enumerate(reversed(keys)))

    return {
        tuple(one): cells.where(F.col("_set") == number(one)).select("year", *one, *measures) for one in sets
    }


def engagement() -> dict[str, Column]:
    return {
        "count": F.count(F.lit(1)),
        "retweets_mean": round_half_even(F.avg("retweet_count")),
        "likes_mean": round_half_even(F.avg("like_count")),
        "pct_with_retweets": engagement_rate(F.col("retweet_count")),
        "pct_with_likes": engagement_rate(F.col("like_count")),
    }


def profile_by_key(df: DataFrame, key: str, categories: Sequence) -> DataFrame:
    """Counts, means and engagement shares per year and category, in category order."""
    return with_share(on_spine(df, key, categories, engagement()))


def with_share(spread: DataFrame) -> DataFrame:
    return spread.withColumn("pct", percent(F.col("count"), F.col("total"))).drop("total")


def profile_by_two_keys(df: DataFrame, key: str, other: str) -> DataFrame:
    """The same for the observed pairs of two categories."""
    cells = (
        df.where(F.col(key).isNotNull() & F.col(other).isNotNull())
        .groupBy("year", key, other)
        .agg(*[measure.alias(name) for name, measure in engagement().items()])
    )
    return share_of_total(cells)


def share_of_total(cells: DataFrame, count: str = "count", name: str = "pct") -> DataFrame:
    """Add each cell's share of its year; ``cells`` is already aggregated."""
    total = F.sum(count).over(Window.partitionBy("year"))
    return cells.withColumn(name, percent(F.col(count), total))


def reach_by_topic(df: DataFrame, categories: Sequence, key: str = "topics_cleaned") -> DataFrame:
    measures = {"count": F.count(F.lit(1)), "reach_mean": round_half_even(F.avg("reach"))}
    return with_share(on_spine(df, key, categories, measures))


def shared_vs_not(df: DataFrame, categories: Sequence, key: str = "topics_cleaned") -> DataFrame:
    """Mean author followers of re-shared and other posts."""
    shares, followers = F.col("retweet_count"), F.col("followers")
    measures = {
        "followers_mean": F.avg(followers),
        "shared_followers_mean": F.avg(F.when(shares > 0, followers)),
        "not_shared_followers_mean": F.avg(F.when(shares == 0, followers)),
    }
    return (
        on_spine(df, key, categories, measures)
        .withColumn("year", F.col("year").cast("string"))
        .drop("total")
    )


def data_characteristics(df: DataFrame) -> DataFrame:
    known, shared = F.col("topics_cleaned").isNotNull(), F.col("retweet_count") > 0
    cells = df.groupBy("day_of_week").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(known).alias("known"),
        F.count_if(known & shared).alias("known_shared"),
        F.count_if(shared).alias("shared"),
    )
    named_days = F.when(F.col("day_of_week").isNotNull(), F.col("rows"))
    totals = cells.agg(
        F.floor(F.avg(named_days)).cast("long").alias("mean_per_weekday"),
        *[F.sum(name).alias(name) for name in ("rows", "known", "known_shared", "shared")],
    )
    return totals.select(
        "mean_per_weekday",
        F.col("known").alias("known_topic_rows"),
        round_half_even(percent(F.col("known"), F.col("rows"))).alias("pct_known_topic"),
        F.col("known_shared").alias("known_topic_shared_rows"),
        round_half_even(percent(F.col("shared"), F.col("rows"))).alias("pct_with_retweets"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of the non-null values of a column."""
    cells = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("count")
    )
    total = df.agg(F.count(column)).scalar()
    return cells.withColumn("share", F.try_divide(F.col("count"), total))


def keyword_year_counts(
    df: DataFrame, keywords: Sequence[str] = COVID_KEYWORDS, mode: str = "token"
) -> DataFrame:
    matched = keyword_match(F.col("text"), keywords, mode)
    return df.groupBy("year").agg(F.sum(matched).alias("matches"))


def keyword_profiles(
    df: DataFrame,
    key: str,
    categories: Sequence,
    keywords: Sequence[str] = COVID_KEYWORDS,
    mode: str = "token",
) -> DataFrame:
    """A profile of all rows beside one of the rows with a keyword, for every year."""
    matched = keyword_match(F.col("text"), keywords, mode) == 1
    every = profile_by_key(df, key, categories).withColumn("rows", F.lit("all"))
    some = profile_by_key(df.where(matched), key, categories).withColumn("rows", F.lit("keyword"))
    return every.unionByName(some)
