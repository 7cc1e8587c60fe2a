"""Physical plans: no Python, no nested loops, filters and columns at the scan."""

import pytest
from pyspark.sql import functions as F

from ripplecast import adapters
from ripplecast.catalogue import data
from ripplecast.functions import sentiment
from ripplecast.operators import filters, ordering, profiles, stats
from ripplecast.plans import analyse, process


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["retweeter_characteristics", "tweet_reach", "profile_by_key", "profile_by_two_keys",
     "cascade_position", "analysis_projection", "keyword_match", "sentiment_score", "sentiment_rules",
     "corr_kendall", "boxplot_by_topic", "stratified_sample"],
)
def test_no_python_and_no_products(spark, folder, name):
    plan = plan_of(data.QUERIES[name](spark, folder))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_enriching_touches_the_users_once(spark, folder):
    plan = plan_of(adapters.proc(spark, folder))
    assert plan.count("customer.parquet") == 1


def test_repeated_profiles_change_nothing(spark, folder):
    tweets, users, lexicon = adapters.tw(spark, folder), adapters.us(spark, folder), adapters.lexicon(spark)
    shares, sharers = adapters.rt(spark, folder), adapters.rtu(spark, folder)
    found = []
    for times in (1, 2):
        many, more = [df if times == 1 else df.unionByName(df) for df in (users, sharers)]
        posts, info = process.process(tweets, many, shares, more, lexicon)
        found.append((posts.agg(F.count("*"), F.sum("reach")).first(), info.count()))
    assert found[0] == found[1]


def test_year_filter_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "2019 + id % 2 as year").write.partitionBy("year").parquet(path)
    plan = plan_of(filters.year_slice(spark.read.parquet(path), 2020))
    assert "PartitionFilters: [isnotnull(year" in plan


def test_profiles_aggregate_before_the_shuffle(spark, folder):
    plan = plan_of(profiles.profile_by_two_keys(adapters.proc(spark, folder), "month", "sentiment"))
    assert "partial_count" in plan


def test_sentiment_needs_no_shuffle(spark, folder):
    plan = plan_of(sentiment.sentiment_score(adapters.tw(spark, folder).select("tweet_id", "text"), adapters.lexicon(spark)))
    assert "Generate" not in plan
    texts = spark.createDataFrame([(1, "so good")], "tweet_id long, text string")
    plan = plan_of(sentiment.sentiment_score(texts, adapters.lexicon(spark)))
    assert "Exchange" not in plan and "Generate" not in plan


def test_joins_have_one_plan(spark, folder):
    """The operators leave the choice of the join to the engine: no hints, salts or size questions."""
    for name in ("tweets_join_users", "retweets_join_retweeters", "reach_author", "tweet_reach", "cascade_join"):
        df = data.QUERIES[name](spark, folder)
        logical = df._jdf.queryExecution().analyzed().toString()
        assert "ResolvedHint" not in logical and "salt" not in logical


def test_reports_scan_the_posts_few_times(spark, folder, tmp_path, monkeypatch):
    adapters.proc(spark, folder).write.parquet(str(tmp_path / "posts"))
    posts, scans = spark.read.parquet(str(tmp_path / "posts")), []

    def spied(module):
        cut = module.cut_lineage

        def spy(df):
            scans.append(plan_of(df).count("FileScan parquet"))
            return cut(df)

        monkeypatch.setattr(module, "cut_lineage", spy)

    for module in (analyse, profiles, stats, ordering):
        spied(module)
    reports = analyse.tweet_reports(posts)
    scans += [plan_of(report).count("FileScan parquet") for report in reports.values()]
    assert sum(scans) <= 8


def test_reports_run(spark, folder):
    posts = adapters.proc(spark, folder).persist()
    reports = analyse.tweet_reports(posts)
    assert len(reports) == 4 + 4 * 5 + 5 + 1 + 3
    for name in ("characteristics", "by_month", "by_hashtags_and_topic", "by_topics_cleaned_kendall"):
        assert reports[name].count() > 0
    info = adapters.rti(spark, folder)
    for report in analyse.retweet_reports(posts, info, adapters.RESHARE_ORDER).values():
        assert report.count() > 0
    posts.unpersist()


def test_reach_is_at_least_the_authors_followers(spark, folder):
    rows = adapters.proc(spark, folder)
    assert rows.where("reach < followers").count() == 0
