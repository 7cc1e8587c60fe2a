"""Golden cascades and reach."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ripplecast.operators import cascades, reach

START = datetime(2020, 1, 1)
INFO = "ref_tweet_id long, tweet_id long, timestamp timestamp, followers long, seniority int"


def info(spark, sizes):
    """Post i has sizes[i] re-shares, one a day; re-share j has (j + 1) * 10 followers."""
    rows = [
        (post, post * 100 + j, START + timedelta(days=j + 1), (j + 1) * 10, j)
        for post, size in sizes.items()
        for j in range(size)
    ]
    return spark.createDataFrame(rows, INFO)


def test_sizes_zero_to_four(spark):
    sizes = {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}
    posts = spark.createDataFrame([(i, START) for i in sizes], "tweet_id long, timestamp timestamp")
    facts = cascades.cascade_facts(info(spark, sizes))
    day = 86_400_000_000
    rows = {
        r["tweet_id"]: (r["to_half"] / day, r["from_half"] / day, r["to_last"] / day)
        for r in cascades.cascade_times(posts, facts).collect()
    }
    assert rows == {1: (1, 1, 1), 2: (2, 0, 2), 3: (2, 1, 3), 4: (3, 1, 4)}
    halves = {
        r["ref_tweet_id"]: (r["first_followers"], r["second_followers"]) for r in facts.collect()
    }
    assert halves == {1: (10, 10), 2: (10, 20), 3: (10, 25), 4: (15, 35)}


def test_halves_cover_the_cascade(spark):
    rows = cascades.first_touch_half(info(spark, {1: 1, 2: 5})).collect()
    for row in rows:
        if row["n"] == 1:
            assert row["in_first"] and row["in_second"]
        else:
            assert row["in_first"] != row["in_second"]


def test_topic_without_popular_posts_has_zeros(spark):
    posts = spark.createDataFrame(
        [(1, START, 2020, "News", 1), (2, START, 2020, "Book", 0), (3, START, 2020, None, 5)],
        "tweet_id long, timestamp timestamp, year int, topics_cleaned string, retweet_count long",
    )
    rows = cascades.retweeter_characteristics(posts, info(spark, {1: 2, 3: 2})).collect()
    got = {r["topic"]: r for r in rows}
    assert set(got) == {"News", "Book"}
    assert got["News"]["followers_mean"] == 15 and got["News"]["pct_time_to_half"] == 100
    assert got["Book"]["followers_mean"] == 0 and got["Book"]["total_time_days"] == 0
    assert got["Book"]["ord"] == 11


def test_reach_sums_both_references_once(spark):
    tweets = spark.createDataFrame(
        [(1, 7, 1, 0, True), (2, 7, 1, 1, True), (3, 8, 1, 3, True), (1000, 8, 0, 1, True),
         (4, 9, 2, 1, False)],
        "tweet_id long, user_id long, retweet_count long, own_ref long, topical boolean",
    )
    users = spark.createDataFrame([(7, 100), (8, 200)], "user_id long, followers long")
    shares = spark.createDataFrame([(1, 5), (1, 6), (2, 70), (3, 900)],
                                   "ref_tweet_id long, followers long")
    got = reach.tweet_reach(tweets, users, shares, F.col("topical"))
    assert {r["tweet_id"]: r["reach"] for r in got.collect()} == {
        1: 111,  # author and own re-shares
        2: 181,  # also those of the post it refers to
        3: 1100,  # refers to itself: counted once
        1000: 200,  # never re-shared
        4: 0,  # unknown author, no topic
    }
