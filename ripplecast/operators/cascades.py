"""Re-share cascades: how fast, and through whom, a post spreads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplecast.functions.numeric import round_half_even
from ripplecast.functions.timeparts import MICROS_PER_DAY, micros_between
from ripplecast.functions.topics import TOPICS
from ripplecast.operators.ordering import positions

ORDER = ["timestamp", "tweet_id"]


def _middle() -> Column:
    return F.expr("n div 2")


def in_first_half() -> Column:
    """A lone re-share counts in both halves."""
    return (F.col("pos") < _middle()) | (F.col("n") == 1)


def in_second_half() -> Column:
    return F.col("pos") >= _middle()


def cascade_position(info: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    return positions(info, "ref_tweet_id", order)


def first_touch_half(info: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Add the half or halves each re-share belongs to."""
    return cascade_position(info, order).select(
        "*", in_first_half().alias("in_first"), in_second_half().alias("in_second")
    )


def _sums() -> list[Column]:
    return [
        F.sum("followers").alias("followers_sum"),
        F.count("followers").alias("followers_n"),
        F.sum("seniority").alias("seniority_sum"),
        F.count("seniority").alias("seniority_n"),
    ]


def cascade_sums(info: DataFrame) -> DataFrame:
    """One row per shared post with what plain means need, for which no order matters."""
    return info.where(F.col("ref_tweet_id").isNotNull()).groupBy("ref_tweet_id").agg(*_sums())


def cascade_facts(info: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """One row per shared post: size, sums, half means, middle and last time."""
    needed = list(dict.fromkeys(["ref_tweet_id", *order, "followers", "seniority"]))
    shares = info.where(F.col("ref_tweet_id").isNotNull()).select(*needed)
    placed = cascade_position(shares, order)
    followers, stamp = F.col("followers"), F.col("timestamp")
    return placed.groupBy("ref_tweet_id").agg(
        F.max("n").alias("n"),
        *_sums(),
        F.avg(F.when(in_first_half(), followers)).alias("first_followers"),
        F.avg(F.when(in_second_half(), followers)).alias("second_followers"),
        F.max(F.when(F.col("pos") == _middle(), stamp)).alias("middle_at"),
        F.max(stamp).alias("last_at"),
    )


def _with_cascade(posts: DataFrame, facts: DataFrame) -> DataFrame:
    """Posts that have a cascade; both sides have about one row per post."""
    return posts.join(facts, posts["tweet_id"] == facts["ref_tweet_id"])


def _days(one: str, other: str) -> Column:
    return micros_between(F.col(one), F.col(other)).cast("double")


def _mean_days(name: str) -> Column:
    return F.coalesce(F.avg(name) / F.lit(float(MICROS_PER_DAY)), F.lit(0.0))


def cascade_times(posts: DataFrame, facts: DataFrame) -> DataFrame:
    """Microseconds to the middle re-share, from it to the last one, and to the last one."""
    total = _days("timestamp", "last_at")
    lone = F.col("n") == 1
    return _with_cascade(posts, facts).select(
        "*",
        F.when(lone, total).otherwise(_days("timestamp", "middle_at")).alias("to_half"),
        F.when(lone, total).otherwise(_days("middle_at", "last_at")).alias("from_half"),
        total.alias("to_last"),
    )


def _time_measures() -> dict[str, Column]:
    ratio = F.try_divide(F.avg("to_half"), F.avg("to_last"))
    return {
        "half_time_days": round_half_even(_mean_days("to_half")),
        "second_half_time_days": round_half_even(_mean_days("from_half")),
        "total_time_days": round_half_even(_mean_days("to_last")),
        "pct_time_to_half": round_half_even(
            F.coalesce(round_half_even(ratio) * 100, F.lit(0.0))
        ),
    }


def _mean_of_sums(name: str) -> Column:
    mean = F.try_divide(
        F.sum(f"{name}_sum").cast("double"), F.sum(f"{name}_n").cast("double")
    )
    return round_half_even(F.coalesce(mean, F.lit(0.0)))


def _measures() -> dict[str, Column]:
    def mean(name: str) -> Column:
        return round_half_even(F.coalesce(F.avg(name), F.lit(0.0)))

    return {
        "followers_mean": _mean_of_sums("followers"),
        "first_half_followers_mean": mean("first_followers"),
        "second_half_followers_mean": mean("second_followers"),
        **_time_measures(),
        "account_age_mean": _mean_of_sums("seniority"),
    }


def _grouped(df: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    chosen = _measures()
    return df.groupBy(*by).agg(*[chosen[name].alias(name) for name in names])


def cascade_avg_followers(posts: DataFrame, facts: DataFrame, by: Sequence[str]) -> DataFrame:
    return _grouped(_with_cascade(posts, facts), by, ["followers_mean"])


def cascade_avg_age(posts: DataFrame, facts: DataFrame, by: Sequence[str]) -> DataFrame:
    return _grouped(_with_cascade(posts, facts), by, ["account_age_mean"])


def cascade_timing(posts: DataFrame, facts: DataFrame, by: Sequence[str]) -> DataFrame:
    return _grouped(cascade_times(posts, facts), by, list(_time_measures()))


def cascade_follower_halves(posts: DataFrame, facts: DataFrame, by: Sequence[str]) -> DataFrame:
    names = ["first_half_followers_mean", "second_half_followers_mean"]
    return _grouped(_with_cascade(posts, facts), by, names)


def retweeter_characteristics(
    posts: DataFrame,
    info: DataFrame,
    above: int = 0,
    order: Sequence[str] = ORDER,
    topics: Sequence[str] = TOPICS,
) -> DataFrame:
    """Cascade measures per year and topic over posts re-shared more than ``above`` times.

    A topic seen in a year with no such post has zeros. ``ord`` is the topic's report order.
    Above zero few posts are left, so only their re-shares are ordered.
    """
    cells = ["year", "topics_cleaned"]
    known = posts.where(F.col("topics_cleaned").isNotNull())
    popular = known.where(F.col("retweet_count") > above).select(
        *cells, "tweet_id", F.col("timestamp")
    )
    if above > 0:
        wanted = popular.select(F.col("tweet_id").alias("ref_tweet_id"))
        info = info.join(wanted, "ref_tweet_id", "left_semi")
    facts = cascade_facts(info, order)
    names = list(_measures())
    measured = _grouped(cascade_times(popular, facts), cells, names)
    ranks = F.array_position(F.array(*[F.lit(t) for t in topics]), F.col("topics_cleaned")) - 1
    return (
        known.select(*cells)
        .distinct()
        .join(measured, cells, "left")
        .fillna(0.0, names)
        .select(
            F.col("year").cast("string").alias("year"),
            F.col("topics_cleaned").alias("topic"),
            ranks.cast("int").alias("ord"),
            *names,
        )
    )
