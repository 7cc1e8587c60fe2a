"""Stratified sampling of a table of posts: a few hours a day, the first rows of each."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplecast.operators.ordering import running_sums

# First hour of each one-hour window, rows per request at least and at most.
WINDOW_HOURS = [0, 7, 13, 18, 21]
REQUEST_MIN = 10
REQUEST_MAX = 100

def daily_limit(parts: int, total: float) -> tuple[int, int]:
    """Rows per request and number of requests when ``total`` rows are split over ``parts``."""
    share = total / parts
    return int(min(max(share, REQUEST_MIN), REQUEST_MAX)), math.ceil(share / REQUEST_MAX)


def window_cap(days: int, total: float) -> int:
    """Rows each window of a day may yield."""
    per_day, requests = daily_limit(days, total)
    per_window, window_requests = daily_limit(len(WINDOW_HOURS), per_day * requests)
    return per_window * window_requests


def sampling_plan(spark: SparkSession, start: str, end: str, total: float, hours: Sequence[int] = WINDOW_HOURS) -> DataFrame:
    """(date, hour, cap): every sampled window of the days from ``start`` to ``end``, both included.

    The days share the total; a day's share is split over its windows, and a window is capped at
    what its requests may yield, so the cap follows from the number of days alone.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    days = spark.range(1).select(F.explode(F.sequence(first, last)).alias("date"))
    cap = window_cap((date.fromisoformat(end) - date.fromisoformat(start)).days + 1, total)
    windows = F.explode(F.array(*[F.lit(hour) for hour in hours])).alias("hour")
    return days.select("date", windows).withColumn("cap", F.lit(cap))


def stratified_sample(posts: DataFrame, plan: DataFrame, stamp: str = "timestamp", key: str = "tweet_id") -> DataFrame:
    """The first posts of every window of the plan, up to its cap; adds ``date``, ``hour``, ``cap``.

    A busy window is numbered in ranges, so it never meets in one task, whatever the cap.
    """
    timed = posts.withColumns({"date": F.to_date(stamp), "hour": F.hour(stamp)})
    picked = timed.join(plan, ["date", "hour"])
    numbered = running_sums(picked, [stamp, key], {"_k": F.lit(1).cast("long")}, by=["date", "hour"])
    return numbered.where(F.col("_k") < F.col("cap")).drop("_k")


def plan_yield(posts: DataFrame, plan: DataFrame, stamp: str = "timestamp", key: str = "tweet_id") -> DataFrame:
    """(date, hour, cap, found, taken) of every window of the plan, empty ones too."""
    found = (
        posts.groupBy(F.to_date(stamp).alias("date"), F.hour(stamp).alias("hour"))
        .agg(F.count(key).alias("found"))
    )
    return plan.join(found, ["date", "hour"], "left").select(
        "date", "hour", "cap", F.coalesce("found", F.lit(0)).alias("found"),
        F.least(F.coalesce("found", F.lit(0)), F.col("cap")).alias("taken"),
    )
