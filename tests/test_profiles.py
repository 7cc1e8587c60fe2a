"""Profiles: spine, rates, shares."""

import pytest

from ripplecast.operators import filters, profiles

SCHEMA = (
    "year int, topics_cleaned string, sentiment string, retweet_count long, like_count long, "
    "followers long, reach long, text string, day_of_week string"
)


@pytest.fixture(scope="module")
def posts(spark):
    rows = [
        (2020, "News", "Neutral", 0, 1, 10, 5, "lockdown", "Monday"),
        (2020, "News", "Positive", 2, 0, 30, 7, "x", "Monday"),
        (2020, "Rare", "Positive", 5, 5, 30, 7, "x", "Friday"),
        (2020, None, "Positive", 5, 5, 30, 7, "x", None),
        (2021, None, "Negative", 1, 1, 1, 1, "x", "Monday"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_every_category_in_every_year(posts):
    rows = profiles.profile_by_key(posts, "topics_cleaned", ["Book", "News"]).collect()
    got = {(r["year"], r["topics_cleaned"]): r for r in rows}
    assert len(got) == 4
    news = got[2020, "News"]
    assert (news["count"], news["pct"], news["pct_with_retweets"]) == (2, 100.0, 50.0)
    assert got[2020, "Book"]["count"] is None and got[2021, "News"]["pct"] is None


def test_no_hits_is_null_not_zero(posts):
    rows = profiles.profile_by_key(posts, "sentiment", ["Neutral"]).where("year = 2020").collect()
    assert rows[0]["pct_with_retweets"] is None and rows[0]["pct_with_likes"] == 100.0


def test_shares_of_a_year_sum_to_100(posts):
    rows = profiles.profile_by_two_keys(posts, "sentiment", "topics_cleaned").collect()
    assert {r["year"] for r in rows} == {2020}
    assert sum(r["pct"] for r in rows) == pytest.approx(100)


def test_characteristics_count_known_and_shared(posts):
    row = profiles.data_characteristics(posts).first()
    assert tuple(row) == (2, 3, 60.0, 2, 80.0)


def test_shared_and_not(posts):
    rows = profiles.shared_vs_not(posts, ["News"]).where("year = '2020'").collect()
    assert rows[0]["shared_followers_mean"] == 30 and rows[0]["not_shared_followers_mean"] == 10


def test_keyword_counts(posts):
    got = {r["year"]: r["matches"] for r in profiles.keyword_year_counts(posts).collect()}
    assert got == {2020: 1, 2021: 0}


def test_empty_ratio_is_null(posts):
    assert filters.popular_share(posts.where("retweet_count < 0")).first()[0] is None


def test_outlier_report_of_nothing_is_null(posts):
    row = filters.outlier_report(posts.where("year = 1900"), {"followers": 5}).first()
    assert row["pct_kept"] is None and row["rows_kept"] == 0
