"""The driver's tables seen as posts, authors, re-shares and re-sharers.

Post = order, author = customer, re-share = line item, re-sharer = supplier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplecast.functions import text as tx
from ripplecast.plans import process
from ripplecast.session import prepare

SOURCES = {
    "1": "App for iPhone", "2": "App for Android", "3": "Web App", "4": "App for iPad",
    "5": "SomeTool",
}
TEXTS = [
    "great sale #promo", "ticket #12345 is late", "a#b no tag, lockdown today",
    "Pandemic news, not good at all",
]
TOPIC_NAMES = [
    "Brand Category", "Holiday", "Person", "Interests and Hobbies", "Sports League", "TV Shows",
    "Travel", "Video Game", "Entities", "Political Body", "Music Genre", "Book", "News",
]
LEXICON = [("great", 3.1), ("good", 1.9), ("bad", -2.5)]

# A total order within a cascade.
RESHARE_ORDER = ["timestamp", "user_id", "part_id", "line", "like_count", "price"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def _pick(items: list[str], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(item) for item in items]), place.cast("int"))


def us(spark: SparkSession, folder: str) -> DataFrame:
    key, money = F.col("c_custkey"), F.abs("c_acctbal")
    days = ((key * 37) % 5400).cast("int")
    return table(spark, folder, "customer").select(
        key.alias("user_id"),
        F.col("c_name").alias("name"),
        F.lower("c_name").alias("username"),
        F.floor(money * 12).alias("followers"),
        F.floor(money * 4).alias("following"),
        (key % 5000).alias("tweet_count"),
        (key % 7 == 0).alias("verified"),
        F.date_add(F.lit("1980-01-01").cast("date"), days).cast("timestamp").alias("created_at"),
    )


def rtu(spark: SparkSession, folder: str) -> DataFrame:
    key, money = F.col("s_suppkey"), F.abs("s_acctbal")
    days = ((key * 53) % 3600).cast("int")
    return table(spark, folder, "supplier").select(
        (key + 1000000).alias("user_id"),
        F.col("s_name").alias("name"),
        F.lower("s_name").alias("username"),
        F.floor(money * 20).alias("followers"),
        F.floor(money * 5).alias("following"),
        ((key * 11) % 5000).alias("tweet_count"),
        (key % 5 == 0).alias("verified"),
        F.date_add(F.lit("1985-01-01").cast("date"), days).cast("timestamp").alias("created_at"),
    )


def rt(spark: SparkSession, folder: str) -> DataFrame:
    ref = F.concat(
        F.lit("[ReferencedTweet(id: "), F.col("l_orderkey").cast("string"),
        F.lit(", type: retweeted \n]"),
    )
    return table(spark, folder, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        (F.col("l_suppkey") + 1000000).alias("user_id"),
        F.col("l_quantity").cast("long").alias("like_count"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_extendedprice").alias("price"),
        ref.alias("referenced_tweets"),
    )


def tw(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    lines = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count(F.lit(1)).alias("_lines"))
    )
    topic = F.col("o_custkey") % 14
    none = F.array().cast("array<string>")
    own_ref = F.when((key % 10 == 0) & (key > 0), key - 1)
    refs = F.when(
        own_ref.isNotNull(),
        F.array(F.struct(own_ref.alias("id"), F.lit("quoted").alias("type"))),
    )
    source = F.element_at(
        F.create_map(*[F.lit(part) for pair in SOURCES.items() for part in pair]),
        F.substring("o_orderpriority", 1, 1),
    )
    stamp = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=key % 24)
    return (
        table(spark, folder, "orders")
        .join(lines, "o_orderkey", "left")
        .select(
            key.alias("tweet_id"),
            _pick(TEXTS, key % 4 + 1).alias("text"),
            F.col("o_custkey").alias("user_id"),
            stamp.alias("timestamp"),
            tx.tweet_type(refs).alias("tweet_type"),
            ((key * 31) % 450).alias("like_count"),
            (key % 5).alias("reply_count"),
            F.coalesce("_lines", F.lit(0).cast("long")).alias("retweet_count"),
            (key % 3).alias("quote_count"),
            source.alias("source"),
            tx.device_class(source).alias("device"),
            F.when(key % 6 == 0, "es").otherwise("en").alias("lang"),
            F.when(key % 5 == 0, "CA").otherwise("US").alias("place_country"),
            F.when(topic == 0, none).otherwise(F.array(topic.cast("string"))).alias("topics_ids"),
            F.when(topic == 0, none)
            .otherwise(F.array(_pick(TOPIC_NAMES, F.greatest(topic, F.lit(1)))))
            .alias("topics"),
            refs.alias("referenced_tweets"),
        )
    )


def lexicon(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{word}', {valence}D)" for word, valence in LEXICON)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS lexicon(word, valence)")


def rti(spark: SparkSession, folder: str) -> DataFrame:
    return process.reshare_info(rt(spark, folder), rtu(spark, folder))


def proc(spark: SparkSession, folder: str) -> DataFrame:
    """Enriched posts before the outlier filter."""
    return process.enrich(
        tw(spark, folder), us(spark, folder), rti(spark, folder), lexicon(spark)
    )
