"""Queries for sources, sinks, joins, aggregates, ordered operators and column functions."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplecast import adapters as ad
from ripplecast import schemas
from ripplecast.functions import numeric as nm
from ripplecast.functions import text as tx
from ripplecast.functions import timeparts as tp
from ripplecast.functions import topics as tg
from ripplecast.functions.sentiment import SENTIMENTS, Rules, sentiment_class, sentiment_score, with_compound
from ripplecast.models import features as ft
from ripplecast.operators import cascades as cs
from ripplecast.operators import filters as fl
from ripplecast.operators import joins as jn
from ripplecast.operators import ordering as od
from ripplecast.operators import profiles as pf
from ripplecast.operators import reach as rc
from ripplecast.operators import sampling as sp
from ripplecast.operators import stats as st
from ripplecast.plans import process as pr
from ripplecast.session import scratch_path
from ripplecast.sources import api, csvfiles, tables
from ripplecast.streaming import ingest

PAGE = 100
SAMPLE_TOTAL = 600
BOX_COLUMNS = ["like_count", "retweet_count", "followers", "following", "seniority"]


def stamp_text(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


def joined(items: Column) -> Column:
    return F.array_join(items, "|")


def _years(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("timestamp"))


def processed(spark: SparkSession, d: str) -> DataFrame:
    return fl.outlier_filter(ad.proc(spark, d))


# -- sources ------------------------------------------------------------------------------


def _tweet_columns(tweets: DataFrame) -> DataFrame:
    first_ref = F.try_element_at("referenced_tweets", F.lit(1))["id"]
    return tweets.select(
        "tweet_id", "text", "user_id", stamp_text(F.col("timestamp")).alias("timestamp"),
        "tweet_type", "like_count", "reply_count", "retweet_count", "quote_count", "device",
        "lang", joined(F.col("topics_ids")).alias("topics_ids"),
        joined(F.col("topics")).alias("topics"),
        F.coalesce(first_ref, F.lit(-1)).alias("first_ref"),
    )


def _user_columns(users: DataFrame) -> DataFrame:
    return users.select(
        "user_id", "name", "username", "followers", "following", "tweet_count", "verified",
        stamp_text(F.col("created_at")).alias("created_at"),
    )


def scan_tweets(spark, d):
    path = scratch_path(spark, "tweets")
    csvfiles.sink_tweets(ad.tw(spark, d), path)
    return _tweet_columns(csvfiles.scan_tweets(spark, path))


def scan_users(spark, d):
    path = scratch_path(spark, "users")
    csvfiles.sink_users(ad.us(spark, d), path)
    return _user_columns(csvfiles.scan_users(spark, path))


def _edges(spark, d):
    """Every re-sharer follows the author of the post it shared."""
    lines = ad.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"
    )
    posts = ad.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return jn.lookup_join(lines, posts, "o_orderkey").select(
        F.col("o_custkey").alias("account_id"), (F.col("l_suppkey") + 1000000).alias("follower_id")
    )


def scan_follows(spark, d):
    path = scratch_path(spark, "follows")
    csvfiles.sink_follows(_edges(spark, d), path)
    return csvfiles.scan_follows(spark, path)


def load_datasets(spark, d):
    tweets_path, users_path = scratch_path(spark, "tweets"), scratch_path(spark, "users")
    users = ad.us(spark, d).withColumn("ordinal", F.col("user_id") * 2)
    again = users.withColumns(
        {"ordinal": F.col("ordinal") + 1, "followers": F.col("followers") + 1}
    )
    csvfiles.sink_tweets(ad.tw(spark, d), tweets_path)
    csvfiles.sink_users(again.unionByName(users), users_path)
    tweets, first = csvfiles.load_datasets(spark, tweets_path, users_path)
    return jn.lookup_join(tweets, first.select("user_id", "followers"), "user_id").select(
        "tweet_id", "user_id", "followers", stamp_text(F.col("timestamp")).alias("timestamp")
    )


def scan_years(spark, d):
    path = scratch_path(spark, "years")
    posts = _years(ad.tw(spark, d)).select(
        "year", "tweet_id", stamp_text(F.col("timestamp")).alias("timestamp"), "retweet_count"
    )
    posts.write.partitionBy("year").option("header", True).csv(path)
    schema = "tweet_id long, timestamp timestamp, retweet_count long"
    read = csvfiles.scan_years(spark, path, spark.createDataFrame([], schema).schema)
    return read.select(
        "tweet_id", stamp_text(F.col("timestamp")).alias("timestamp"), "retweet_count"
    )


def _api_tweet() -> Column:
    metrics = [F.col(n) for n in ("like_count", "reply_count", "retweet_count", "quote_count")]
    notes = F.transform(
        F.arrays_zip("topics_ids", "topics"),
        lambda t: F.struct(
            F.struct(t["topics_ids"].alias("id"), t["topics"].alias("name")).alias("domain")
        ),
    )
    refs = F.transform(
        "referenced_tweets",
        lambda r: F.struct(r["id"].cast("string").alias("id"), r["type"].alias("type")),
    )
    return F.struct(
        F.col("tweet_id").cast("string").alias("id"),
        "text",
        F.col("user_id").cast("string").alias("author_id"),
        stamp_text(F.col("timestamp")).alias("created_at"),
        "source",
        "lang",
        refs.alias("referenced_tweets"),
        F.struct(*metrics).alias("public_metrics"),
        notes.alias("context_annotations"),
    )


def _api_user(users: DataFrame) -> DataFrame:
    metrics = F.struct(
        F.col("followers").alias("followers_count"),
        F.col("following").alias("following_count"),
        "tweet_count",
    )
    user = F.struct(
        F.col("user_id").cast("string").alias("id"), "name", "username", "verified",
        stamp_text(F.col("created_at")).alias("created_at"), metrics.alias("public_metrics"),
    )
    return users.select("user_id", user.alias("user"))


def tweet_pages(spark, d) -> DataFrame:
    """Pages of at most 100 posts with their authors."""
    authors = _api_user(ad.us(spark, d))
    posts = ad.tw(spark, d).select("user_id", "tweet_id", _api_tweet().alias("tweet"))
    both = jn.lookup_join(posts, authors, "user_id", "left")
    page = F.floor(F.col("tweet_id") / PAGE)  # ids are unique, so a page holds at most 100
    users = F.array_distinct(F.collect_list("user"))
    return both.groupBy(page.alias("page")).agg(
        F.collect_list("tweet").alias("data"), F.struct(users.alias("users")).alias("includes")
    ).select("data", "includes")


def user_pages(spark, d) -> DataFrame:
    page = F.floor(F.col("user_id") / PAGE)
    return (
        _api_user(ad.us(spark, d))
        .groupBy(page.alias("page"))
        .agg(F.collect_list("user").alias("data"))
        .select("data")
    )


def normalize_api(spark, d):
    path = scratch_path(spark, "pages")
    tweet_pages(spark, d).write.json(path)
    return _tweet_columns(api.normalize_api(api.read_tweet_pages(spark, path))[0])


def normalize_users(spark, d):
    path = scratch_path(spark, "pages")
    user_pages(spark, d).write.json(path)
    return _user_columns(api.normalize_users(api.read_user_pages(spark, path)))


def include_user_match(spark, d):
    path = scratch_path(spark, "pages")
    tweet_pages(spark, d).write.json(path)
    matched = api.include_user_match(api.read_tweet_pages(spark, path))
    return matched.select(
        F.col("tweet.id").cast("long").alias("tweet_id"),
        F.coalesce(F.col("user.name"), F.lit("none")).alias("author"),
    )


def train_test_scan(spark, d):
    path = scratch_path(spark, "table")
    tables.sink_by_year(_years(ad.tw(spark, d)).select("tweet_id", "year"), path)
    train, test = tables.train_test_scan(spark, path)
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )


# -- sinks --------------------------------------------------------------------------------


def sink_tweets(spark, d):
    path = scratch_path(spark, "tweets")
    broken = F.concat(F.col("text"), F.lit("\r\n"), F.col("source"))
    csvfiles.sink_tweets(ad.tw(spark, d).withColumn("text", broken), path)
    return _tweet_columns(csvfiles.scan_tweets(spark, path))


def sink_users(spark, d):
    path = scratch_path(spark, "users")
    csvfiles.sink_users(ad.us(spark, d), path)
    return spark.read.option("header", True).csv(path)


def _wide(spark, d) -> DataFrame:
    place = F.struct(F.col("place_country").alias("country"))
    tag = F.struct(F.array(F.lit("promo")).alias("hashtags"))
    return ad.tw(spark, d).select(
        "tweet_id",
        "text",
        F.col("tweet_id").alias("conversation_id"),
        "referenced_tweets",
        F.transform(
            "topics", lambda t: F.struct(F.struct(t.alias("name")).alias("domain"))
        ).alias("context_annotations"),
        F.when(F.col("lang") == "en", place).alias("geo"),
        F.when(tx.has_hashtag(F.col("text")), tag).alias("entities"),
    )


def sink_nested(spark, d):
    path = scratch_path(spark, "nested")
    csvfiles.sink_nested(_wide(spark, d), path)
    return spark.read.option("header", True).option("escape", '"').csv(path).fillna("none")


def _accounts(spark, d) -> DataFrame:
    sharer = F.col("l_suppkey") + 1000000
    return ad.table(spark, d, "lineitem").select(
        sharer.alias("user_id"),
        F.array(F.col("l_partkey"), F.col("l_orderkey")).alias("followers_ids"),
        F.array(F.col("l_orderkey")).alias("followings_ids"),
    )


def follow_edges(spark, d):
    return csvfiles.follow_edges(_edges(spark, d), _accounts(spark, d))


def sink_follows(spark, d):
    path = scratch_path(spark, "follows")
    csvfiles.sink_follows(follow_edges(spark, d), path)
    return csvfiles.scan_follows(spark, path)


def sink_by_year(spark, d):
    posts, info = scratch_path(spark, "posts"), scratch_path(spark, "info")
    pr.process_and_save(
        ad.tw(spark, d), ad.us(spark, d), ad.rt(spark, d), ad.rtu(spark, d), ad.lexicon(spark),
        posts, info,
    )
    kinds = {"posts": posts, "info": info}
    parts = [
        tables.scan_table(spark, path).select(
            F.lit(kind).alias("kind"), "year", "user_id", "followers", "seniority"
        )
        for kind, path in kinds.items()
    ]
    return tables.union_years(parts).groupBy("kind", "year").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("followers").alias("followers"),
        F.sum("seniority").alias("seniority"),
    )


def encoded_years(spark, d):
    """The encodings that the yearly tables of processed posts carry."""
    posts, info = scratch_path(spark, "posts"), scratch_path(spark, "info")
    pr.process_and_save(
        ad.tw(spark, d), ad.us(spark, d), ad.rt(spark, d), ad.rtu(spark, d), ad.lexicon(spark),
        posts, info,
    )
    held = tables.scan_table(spark, posts)
    ones = {"positive": "sentiment_Positive", "monday": "day_of_week_Monday", "verified_one": "verified_True"}
    return held.select(
        "tweet_id", *[f"{column}_enc" for column in ft.LABELLED],
        *[F.col(f"`{column}`").alias(name) for name, column in ones.items()],
    )


def unreadable_values(spark, d):
    """Rows of a file of users whose follower count is no number in every seventh."""
    path = scratch_path(spark, "users")
    broken = F.when(F.col("user_id") % 7 == 0, F.lit("many")).otherwise(F.col("followers").cast("string"))
    users = ad.us(spark, d).withColumns({"followers": broken, "created_at": stamp_text(F.col("created_at"))})
    users.write.option("header", True).csv(path)
    return csvfiles.unreadable(spark, path, schemas.USERS)


def incremental_ingest(spark, d):
    """Two drops of pages, the second ending between its two tables and being run again."""
    drop, target, marks = (scratch_path(spark, name) for name in ("drop", "ingested", "marks"))
    pages = tweet_pages(spark, d).withColumn("_half", F.xxhash64(F.array_min(F.col("data")["id"])) % 2 == 0)
    pages.where("_half").select("data", "includes").write.mode("append").json(drop)
    ingest.incremental_ingest(spark, drop, target, marks)
    pages.where("NOT _half").select("data", "includes").write.mode("append").json(drop)
    ended = []

    def ends(number: int) -> None:
        ended.append(number)
        raise RuntimeError("ended between the tables")

    try:
        ingest.incremental_ingest(spark, drop, target, marks, between=ends)
    except StreamingQueryException:
        if not ended:
            raise
    ingest.incremental_ingest(spark, drop, target, marks)
    stored_posts = spark.read.parquet(f"{target}/tweets").select(
        F.lit("post").alias("kind"), F.col("tweet_id").alias("id"), F.col("retweet_count").alias("number")
    )
    stored_users = spark.read.parquet(f"{target}/users").select(
        F.lit("user").alias("kind"), F.col("user_id").alias("id"), F.col("followers").alias("number")
    )
    return stored_posts.unionByName(stored_users)


def append_state(spark, d):
    path = scratch_path(spark, "state")
    posts = _years(ad.tw(spark, d)).select("year", "tweet_id", "retweet_count")
    tables.append_state(posts, path)
    tables.append_state(posts.withColumn("retweet_count", F.col("retweet_count") + 1), path)
    return tables.scan_table(spark, path).select("year", "tweet_id", "retweet_count")


def union_years(spark, d):
    """The posts beside the re-shares, which have other columns."""
    posts = ad.tw(spark, d).select("user_id", "like_count", "retweet_count")
    shares = ad.rt(spark, d).select("user_id", "like_count", "line")
    return tables.union_years([posts, shares]).fillna(-1)


# -- filters and projections ----------------------------------------------------------------


def extract_tweet(spark, d):
    posts = ad.tw(spark, d).select(_api_tweet().alias("tweet"))
    return _tweet_columns(api.extract_tweet(posts))


def extract_user(spark, d):
    return _user_columns(api.extract_user(_api_user(ad.us(spark, d))))


def collection_filter(spark, d):
    linked = F.when(F.col("reply_count") == 3, F.concat(F.col("text"), F.lit(" https://x.org")))
    posts = ad.tw(spark, d).withColumn("text", F.coalesce(linked, F.col("text")))
    return fl.collection_filter(posts).select("tweet_id", "text")


def share_candidates(spark, d):
    return fl.share_candidates(ad.tw(spark, d)).select("tweet_id", "retweet_count")


def known_topic(spark, d):
    posts = pr.topic_columns(ad.tw(spark, d))
    return fl.known_topic(posts).select(
        "tweet_id", "topics_ids", tx.popularity(F.col("retweet_count")).alias("popularity")
    )


def outlier_filter(spark, d):
    return processed(spark, d).select("tweet_id", "followers", "like_count", "seniority")


def outlier_trials(spark, d):
    posts = ad.proc(spark, d)
    kept = [nm.all_below(bounds).cast("int").alias(f"kept_{i}")
            for i, bounds in enumerate(fl.OUTLIER_TRIALS)]
    return posts.select("tweet_id", *kept)


def retweets_with_ref(spark, d):
    shares = ad.rt(spark, d).withColumn(
        "referenced_tweets", F.when(F.col("line") != 2, F.col("referenced_tweets"))
    )
    return fl.retweets_with_ref(shares).select("user_id", "part_id", "line", "like_count")


def popular_filter(spark, d):
    posts = pr.time_parts(ad.tw(spark, d))
    marked = [fl.popular_filter(posts, k).withColumn("above", F.lit(k)) for k in (0, 10)]
    return tables.union_years(marked).select("tweet_id", "year", "retweet_count", "above")


def split_xy(spark, d):
    x, y = ft.split_xy(processed(spark, d).select("tweet_id", "followers", "popularity"))
    return x.join(y, "tweet_id")


def year_slice(spark, d):
    posts = pr.time_parts(ad.tw(spark, d))
    parts = [fl.year_slice(posts, y) for y in (1997, 1998, 1999)]
    return tables.union_years(parts).select("tweet_id", "year")


def analysis_projection(spark, d):
    return fl.analysis_projection(ad.proc(spark, d)).fillna("none", ["topics_cleaned"])


# -- joins --------------------------------------------------------------------------------


def tweets_join_users(spark, d):
    return jn.author_join(ad.tw(spark, d).drop("tweet_count"), ad.us(spark, d)).select(
        "tweet_id", "user_id", stamp_text(F.col("timestamp")).alias("timestamp"), "followers",
        "following", "tweet_count", "verified",
    )


def retweets_join_retweeters(spark, d):
    return ad.rti(spark, d).select(
        "ref_tweet_id", "user_id", "part_id", "line", "like_count", "followers", "following",
        "seniority", stamp_text(F.col("timestamp")).alias("timestamp"),
    )


def reach_author(spark, d):
    reached = rc.author_followers(ad.tw(spark, d), ad.us(spark, d))
    return reached.select("tweet_id", "author_followers")


def tweet_reach(spark, d):
    first_ref = F.try_element_at("referenced_tweets", F.lit(1))["id"]
    posts = ad.tw(spark, d).withColumn("own_ref", F.coalesce(first_ref, F.lit(0)))
    reached = rc.tweet_reach(posts, ad.us(spark, d), ad.rti(spark, d), F.size("topics") > 0)
    return reached.select("tweet_id", "reach")


def cascade_join(spark, d):
    posts = ad.tw(spark, d).select("tweet_id", F.col("timestamp").alias("posted_at"))
    pairs = jn.cascade_join(posts, ad.rti(spark, d))
    return pairs.select(
        "ref_tweet_id", "user_id", "part_id", "line", "like_count", "followers",
        stamp_text(F.col("posted_at")).alias("posted_at"),
    )


def category_spine(spark, d):
    posts = pr.time_parts(pr.topic_columns(ad.tw(spark, d)))
    listed = ["News", "Unheard of", "Brand", "Book"]
    measures = {"count": F.count(F.lit(1))}
    return pf.on_spine(posts, "topics_cleaned", listed, measures).fillna(-1)


# -- aggregates ---------------------------------------------------------------------------


def _profile(key, categories):
    def query(spark, d):
        profile = pf.profile_by_key(ad.proc(spark, d), key, categories)
        return profile.withColumn("pct", F.round("pct", 6)).fillna(-1)

    return query


def _profile_two(key):
    def query(spark, d):
        profile = pf.profile_by_two_keys(ad.proc(spark, d), key, "topics_cleaned")
        return profile.withColumn("pct", F.round("pct", 6)).fillna(-1)

    return query


def engagement_rate(spark, d):
    return ad.tw(spark, d).groupBy("device", "lang").agg(
        nm.engagement_rate(F.col("retweet_count")).alias("pct_with_retweets"),
        nm.engagement_rate(F.col("like_count")).alias("pct_with_likes"),
    )


def reach_by_topic(spark, d):
    reports = pf.reach_by_topic(ad.proc(spark, d), tg.TOPICS)
    return reports.withColumn("pct", F.round("pct", 6)).fillna(-1)


def shared_vs_not(spark, d):
    means = ["followers_mean", "shared_followers_mean", "not_shared_followers_mean"]
    return pf.shared_vs_not(ad.proc(spark, d), tg.TOPICS).withColumns(
        {name: F.round(F.coalesce(name, F.lit(-1.0)), 4) for name in means}
    )


def data_characteristics(spark, d):
    return pf.data_characteristics(ad.proc(spark, d))


def outlier_report(spark, d):
    return fl.outlier_report(ad.proc(spark, d))


def value_counts(spark, d):
    return pf.value_counts(ad.proc(spark, d), "topics_cleaned").withColumn(
        "share", F.round("share", 9)
    )


def popular_share(spark, d):
    return fl.popular_share(ad.tw(spark, d)).withColumn("pct_popular", F.round("pct_popular", 6))


def keyword_year_counts(spark, d):
    return pf.keyword_year_counts(pr.time_parts(ad.tw(spark, d)))


def keyword_profiles(spark, d):
    posts = ad.proc(spark, d)
    parts = [
        pf.keyword_profiles(posts, key, categories).withColumnRenamed(key, "category")
        for key, categories in (("month", tp.MONTHS), ("sentiment", SENTIMENTS))
    ]
    return tables.union_years(parts).withColumn("pct", F.round("pct", 6)).fillna(-1)


def _cascade_parts(spark, d, ordered: bool):
    posts = pr.time_parts(pr.topic_columns(ad.tw(spark, d))).select(
        "tweet_id", "timestamp", "year", "topics_cleaned"
    )
    info = ad.rti(spark, d)
    return posts, cs.cascade_facts(info, ad.RESHARE_ORDER) if ordered else cs.cascade_sums(info)


def _cascade(operator, ordered: bool = True):
    def query(spark, d):
        posts, facts = _cascade_parts(spark, d, ordered)
        return operator(posts, facts, ["year", "topics_cleaned"]).fillna("none")

    return query


def dedup_keep_first(spark, d):
    events = ad.table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return od.keep_first(events, "user_id", "event_id")


def retweeter_characteristics(spark, d, above=0):
    """Flagship: how each topic's posts spread, per year."""
    posts = pr.time_parts(pr.topic_columns(ad.tw(spark, d)))
    return cs.retweeter_characteristics(posts, ad.rti(spark, d), above, ad.RESHARE_ORDER)


def distinct_values(spark, d):
    posts = pr.time_parts(pr.topic_columns(ad.tw(spark, d)))
    rows = None
    for kind, column in (("year", "year"), ("topic", "topics_cleaned")):
        place = {"place": F.lit(1).cast("long")}
        values = od.running_sums(od.distinct_values(posts, column), [column], place).select(
            F.lit(kind).alias("kind"), F.col("place").cast("int").alias("place"),
            F.col(column).cast("string").alias("value"),
        )
        rows = values if rows is None else rows.unionByName(values)
    return rows


def boxplot_stats(spark, d):
    events = ad.table(spark, d, "events")
    both = st.boxplot_stats(ad.proc(spark, d), BOX_COLUMNS).unionByName(
        st.boxplot_stats(events, ["value"])
    )
    numbers = [name for name in both.columns if name != "variable"]
    return both.withColumns({name: F.round(name, 6) for name in numbers})


def boxplot_by_topic(spark, d):
    found = st.boxplot_stats(ad.proc(spark, d), BOX_COLUMNS, by=["topics_cleaned"])
    numbers = [name for name in found.columns if name not in ("variable", "topics_cleaned")]
    return found.withColumns({name: F.round(name, 6) for name in numbers})


def corr_pearson(spark, d):
    return st.corr_pearson(ad.tw(spark, d), "retweet_count", "like_count").select(
        F.round("pearson", 9).alias("pearson")
    )


def corr_spearman(spark, d):
    return st.corr_spearman(ad.tw(spark, d), "retweet_count", "like_count").select(
        F.round("spearman", 9).alias("spearman")
    )


def corr_kendall(spark, d):
    return st.corr_kendall(ad.tw(spark, d), "retweet_count", "like_count").select(
        F.round("kendall", 9).alias("kendall")
    )


def class_balance(spark, d):
    return st.class_balance(fl.known_topic(processed(spark, d)))


# -- order --------------------------------------------------------------------------------


def _cascade_row(spark, d, operator, *extra):
    placed = operator(ad.rti(spark, d), ad.RESHARE_ORDER)
    return placed.select(
        "ref_tweet_id", stamp_text(F.col("timestamp")).alias("timestamp"), "user_id", "part_id",
        "line", "pos", "n", *extra,
    )


def cascade_position(spark, d):
    return _cascade_row(spark, d, cs.cascade_position)


def first_touch_half(spark, d):
    return _cascade_row(spark, d, cs.first_touch_half, "in_first", "in_second")


def share_of_total(spark, d):
    cells = (
        pr.time_parts(ad.tw(spark, d)).groupBy("year", "device").agg(F.count("*").alias("count"))
    )
    return pf.share_of_total(cells).withColumn("pct", F.round("pct", 6))


def _sampled(spark, d) -> tuple[DataFrame, DataFrame]:
    """Events and a plan that begins some days before them and ends after them."""
    events = ad.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.to_date("ts")
    first, last = events.agg(F.date_sub(F.min(day), 4), F.date_add(F.max(day), 3)).first()
    return events, sp.sampling_plan(spark, str(first), str(last), SAMPLE_TOTAL)


def stratified_sample(spark, d):
    events, plan = _sampled(spark, d)
    picked = sp.stratified_sample(events, plan, "ts", "event_id")
    return picked.select("event_id", F.col("date").cast("string").alias("date"), "hour", "cap")


def sampling_plan(spark, d):
    """What every window of the plan finds and takes."""
    events, plan = _sampled(spark, d)
    found = sp.plan_yield(events, plan, "ts", "event_id")
    return found.withColumn("date", F.col("date").cast("string"))


def sort_by_time(spark, d):
    return od.sort_by_time(ad.tw(spark, d)).select(
        "tweet_id", stamp_text(F.col("timestamp")).alias("timestamp")
    )


def category_order(spark, d):
    posts = pr.time_parts(ad.tw(spark, d))
    measures = {"count": F.count(F.lit(1))}
    return pf.on_spine(posts, "month", tp.MONTHS, measures).fillna(0).orderBy("year", "ord")


def top_k_features(spark, d):
    scores = ad.table(spark, d, "part").select(
        F.col("p_retailprice").alias("score"), F.col("p_partkey").cast("string").alias("feature")
    )
    return od.top_k(scores, 10)


# -- column functions -----------------------------------------------------------------------


def device_class(spark, d):
    return ad.tw(spark, d).select("tweet_id", tx.device_class(F.col("source")).alias("device"))


def tweet_type(spark, d):
    key = F.col("o_orderkey")
    kinds = F.array(F.lit("quoted"), F.lit("replied_to"), F.lit("retweeted"), F.lit("liked"))

    def ref(place):
        kind = F.element_at(kinds, (place % 4 + 1).cast("int"))
        return F.struct(key.alias("id"), kind.alias("type"))

    refs = F.when(key % 7 != 0, F.array(ref(key), ref(F.col("o_custkey"))))
    return ad.table(spark, d, "orders").select(
        key.alias("tweet_id"), tx.tweet_type(refs).alias("tweet_type")
    )


def topic_arrays(spark, d):
    posts = ad.tw(spark, d).select("tweet_id", _api_tweet().alias("tweet"))
    notes = F.col("tweet.context_annotations")
    return posts.select(
        "tweet_id",
        joined(tx.topic_ids_of(notes)).alias("topics_ids"),
        joined(tx.topic_names_of(notes)).alias("topics"),
    )


def ref_list(spark, d):
    posts = ad.tw(spark, d).select("tweet_id", _api_tweet().alias("tweet"))
    refs = tx.ref_list(F.col("tweet.referenced_tweets"))
    shown = joined(F.transform(refs, lambda r: F.concat(r["id"].cast("string"), r["type"])))
    return posts.select("tweet_id", F.coalesce(shown, F.lit("none")).alias("refs"))


def ref_tweet_id(spark, d):
    stored = F.col("referenced_tweets")
    found = tx.ref_tweet_id(F.when(F.col("line") == 2, F.lit("nan")).otherwise(stored))
    return ad.rt(spark, d).select(
        "part_id", "line", "user_id", F.coalesce(found, F.lit(0)).alias("ref_tweet_id")
    )


def first_list_item(spark, d):
    stored = tx.list_text(F.array_append(F.array_append("topics", F.col("lang")), F.lit("x")))
    posts = ad.tw(spark, d).withColumn("stored", stored)
    return posts.select("tweet_id", tx.first_list_item(F.col("stored")).alias("item"))


def topic_group(spark, d):
    parts = ad.table(spark, d, "part").select(
        F.concat_ws(" ", F.lit("p"), "p_partkey").alias("key"),
        tg.topic_group(F.concat_ws(" ", "p_type", "p_brand", "p_name")).alias("topic"),
    )
    posts = ad.tw(spark, d).select(
        F.concat_ws(" ", F.lit("t"), "tweet_id").alias("key"),
        tg.topic_group(F.try_element_at("topics", F.lit(1))).alias("topic"),
    )
    return parts.unionByName(posts).fillna("none")


def topic_defaults(spark, d):
    return pr.topic_columns(ad.tw(spark, d)).select("tweet_id", "topics_ids", "topics")


def sentiment_class_query(spark, d):
    compound = F.col("value") / 50 - 1
    return ad.table(spark, d, "events").select(
        "event_id", sentiment_class(compound).alias("sentiment")
    )


def sentiment_score_query(spark, d):
    posts = ad.tw(spark, d)
    return sentiment_score(posts, ad.lexicon(spark)).select(
        "tweet_id", F.round("compound", 9).alias("compound")
    )


# Words of the given texts in the parts that the rules give to words.
RULED_WORDS = [("the", 0.25), ("and", -0.5), ("to", 1.5), ("of", -1.25), ("la", 0.75), ("le", -0.5), ("de", 0.375),
               ("great", 3.1), ("good", 1.9), ("est", 0.5)]
RULES = Rules(
    negators=("for", "not", "et"), boosters={"in": 0.293, "is": -0.293, "que": 0.293}, contrasts=("that", "un")
)


def sentiment_rules(spark, d):
    """All rules at work over every given text."""
    scored = with_compound(_texts(spark, d), dict(RULED_WORDS), rules=RULES)
    return scored.select("kind", "id", "part", F.round("compound", 9).alias("compound"))


def _texts(spark, d) -> DataFrame:
    """Every text the driver ships, beside the posts' own."""
    documents = ad.table(spark, d, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("part"), "text"
    )
    turns = ad.table(spark, d, "conversations").select(
        F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("part"), "text"
    )
    posts = ad.tw(spark, d).select(
        F.lit("post").alias("kind"), F.col("tweet_id").alias("id"), F.lit(0).cast("long").alias("part"), "text"
    )
    return documents.unionByName(turns).unionByName(posts)


def has_hashtag(spark, d):
    return _texts(spark, d).select("kind", "id", "part", tx.has_hashtag(F.col("text")).alias("hashtags"))


def flatten_newlines(spark, d):
    flat = tx.flatten_newlines(F.col("text"))
    return _texts(spark, d).select("kind", "id", "part", F.md5(flat).alias("digest"))


def keyword_match(spark, d):
    matched = tx.keyword_match(F.col("text"), tx.COVID_KEYWORDS)
    return _texts(spark, d).select("kind", "id", "part", matched.alias("matched"))


def popularity(spark, d):
    return ad.tw(spark, d).select(
        "tweet_id", tx.popularity(F.col("retweet_count")).alias("popularity")
    )


def popularity_rt_quote(spark, d):
    label = tx.popularity_rt_quote(F.col("retweet_count"), F.col("quote_count"))
    return ad.tw(spark, d).select("tweet_id", label.alias("popularity"))


def _events(spark, d):
    return ad.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def day_phase(spark, d):
    return _events(spark, d).select("event_id", tp.day_phase(F.col("ts")).alias("day_phase"))


def time_parts(spark, d):
    return pr.time_parts(ad.tw(spark, d)).select("tweet_id", "year", "month", "day_of_week")


def week_index(spark, d):
    return ad.tw(spark, d).select("tweet_id", tp.week_index(F.col("timestamp")).alias("week_idx"))


def seniority(spark, d):
    return ad.proc(spark, d).select("tweet_id", "seniority")


def date_only(spark, d):
    return _events(spark, d).select(
        "event_id", tp.date_only(F.col("ts")).cast("string").alias("date")
    )


def days_between(spark, d):
    posts = ad.tw(spark, d).select("tweet_id", F.col("timestamp").alias("posted_at"))
    pairs = jn.cascade_join(posts, ad.rti(spark, d))
    days = tp.days_between(F.col("posted_at"), F.col("timestamp"))
    return pairs.select("ref_tweet_id", "user_id", "part_id", "line", F.round(days, 6).alias("days"))


def round_half_even(spark, d):
    price = F.col("l_quantity") / 8
    return ad.table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", nm.round_half_even(price).alias("rounded")
    )


def clean_nulls(spark, d):
    posts = ad.proc(spark, d)
    found = ft.vocabularies(posts, ["sentiment", "hashtags"])
    coded = ft.one_hot(posts, found).select("tweet_id", "sentiment_Neutral", "hashtags_True")
    plain = posts.select((-F.col("tweet_id") - 1).alias("tweet_id"))
    both = tables.union_years([coded, plain])
    return ft.clean_nulls(both, ft.encoded_columns(both))


def one_hot(spark, d):
    posts = ad.proc(spark, d)
    found = ft.vocabularies(posts, ft.ONE_HOT)
    coded = ft.one_hot(posts, found)
    names = [f"{column}_{value}" for column, values in found.items() for value in values[1:]]
    sums = coded.agg(*[F.sum(F.col(f"`{name}`")).alias(name) for name in names])
    cells = [F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("ones")) for n in names]
    return sums.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def label_encode(spark, d):
    posts = ad.proc(spark, d)
    coded = ft.label_encode(posts, ft.vocabularies(posts, ft.LABELLED))
    return coded.select("tweet_id", *[f"{column}_enc" for column in ft.LABELLED])


def to_utc(spark, d):
    text = F.concat(
        stamp_text(F.col("ts")), F.when(F.col("user_id") % 2 == 0, "+02:00").otherwise("Z")
    )
    return _events(spark, d).select(
        "event_id", stamp_text(tp.to_utc(text)).alias("utc")
    )


QUERIES = {
    "scan_tweets": scan_tweets,
    "scan_users": scan_users,
    "scan_follows": scan_follows,
    "load_datasets": load_datasets,
    "scan_years": scan_years,
    "normalize_api": normalize_api,
    "normalize_users": normalize_users,
    "train_test_scan": train_test_scan,
    "sink_tweets": sink_tweets,
    "sink_users": sink_users,
    "sink_nested": sink_nested,
    "sink_follows": sink_follows,
    "sink_by_year": sink_by_year,
    "encoded_years": encoded_years,
    "unreadable_values": unreadable_values,
    "incremental_ingest": incremental_ingest,
    "append_state": append_state,
    "extract_tweet": extract_tweet,
    "extract_user": extract_user,
    "collection_filter": collection_filter,
    "share_candidates": share_candidates,
    "known_topic": known_topic,
    "outlier_filter": outlier_filter,
    "outlier_trials": outlier_trials,
    "retweets_with_ref": retweets_with_ref,
    "popular_filter": popular_filter,
    "split_xy": split_xy,
    "year_slice": year_slice,
    "analysis_projection": analysis_projection,
    "tweets_join_users": tweets_join_users,
    "retweets_join_retweeters": retweets_join_retweeters,
    "reach_author": reach_author,
    "tweet_reach": tweet_reach,
    "cascade_join": cascade_join,
    "category_spine": category_spine,
    "include_user_match": include_user_match,
    "profile_by_key": _profile("day_of_week", tp.WEEK_DAYS),
    "profile_by_day_phase": _profile("day_phase", tp.DAY_PHASES),
    "profile_by_month": _profile("month", tp.MONTHS),
    "profile_by_sentiment": _profile("sentiment", SENTIMENTS),
    "profile_by_topic": _profile("topics_cleaned", tg.TOPICS),
    "profile_by_two_keys": _profile_two("day_of_week"),
    "profile_by_day_phase_and_topic": _profile_two("day_phase"),
    "profile_by_month_and_topic": _profile_two("month"),
    "profile_by_hashtags_and_topic": _profile_two("hashtags"),
    "profile_by_sentiment_and_topic": _profile_two("sentiment"),
    "engagement_rate": engagement_rate,
    "reach_by_topic": reach_by_topic,
    "shared_vs_not": shared_vs_not,
    "data_characteristics": data_characteristics,
    "outlier_report": outlier_report,
    "value_counts": value_counts,
    "popular_share": popular_share,
    "keyword_year_counts": keyword_year_counts,
    "keyword_profiles": keyword_profiles,
    "cascade_avg_followers": _cascade(cs.cascade_avg_followers, ordered=False),
    "cascade_avg_age": _cascade(cs.cascade_avg_age, ordered=False),
    "cascade_timing": _cascade(cs.cascade_timing),
    "cascade_follower_halves": _cascade(cs.cascade_follower_halves),
    "dedup_keep_first": dedup_keep_first,
    "retweeter_characteristics": retweeter_characteristics,
    "popular_retweeter_characteristics": lambda spark, d: retweeter_characteristics(spark, d, 10),
    "distinct_values": distinct_values,
    "boxplot_stats": boxplot_stats,
    "boxplot_by_topic": boxplot_by_topic,
    "corr_pearson": corr_pearson,
    "corr_spearman": corr_spearman,
    "corr_kendall": corr_kendall,
    "class_balance": class_balance,
    "cascade_position": cascade_position,
    "share_of_total": share_of_total,
    "first_touch_half": first_touch_half,
    "stratified_sample": stratified_sample,
    "sampling_plan": sampling_plan,
    "sort_by_time": sort_by_time,
    "category_order": category_order,
    "top_k_features": top_k_features,
    "union_years": union_years,
    "follow_edges": follow_edges,
    "device_class": device_class,
    "tweet_type": tweet_type,
    "topic_arrays": topic_arrays,
    "ref_list": ref_list,
    "ref_tweet_id": ref_tweet_id,
    "first_list_item": first_list_item,
    "topic_group": topic_group,
    "topic_defaults": topic_defaults,
    "sentiment_class": sentiment_class_query,
    "sentiment_score": sentiment_score_query,
    "sentiment_rules": sentiment_rules,
    "has_hashtag": has_hashtag,
    "popularity": popularity,
    "popularity_rt_quote": popularity_rt_quote,
    "day_phase": day_phase,
    "time_parts": time_parts,
    "week_index": week_index,
    "seniority": seniority,
    "date_only": date_only,
    "flatten_newlines": flatten_newlines,
    "keyword_match": keyword_match,
    "days_between": days_between,
    "round_half_even": round_half_even,
    "clean_nulls": clean_nulls,
    "one_hot": one_hot,
    "label_encode": label_encode,
    "to_utc": to_utc,
}
