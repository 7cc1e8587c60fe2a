"""CSV files of posts, users and follow edges.

Files written here hold one record per line, so Spark can split them; files written elsewhere
may break lines inside quotes and need ``multi_line=True``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplecast import schemas
from ripplecast.functions import text as tx
from ripplecast.operators.ordering import keep_first

ORDINAL = "ordinal"
_STAMP = "yyyy-MM-dd HH:mm:ss"
_FILE, _START = "_file", "_start"
_NEVER_NULL = ("device", "tweet_type")  # CSV cannot tell an unknown class, '', from null


def _raw(spark: SparkSession, path: str, multi_line: bool) -> DataFrame | None:
    """All columns as text, each row with its file and where its split begins."""
    reader = spark.read.option("header", True).option("escape", '"')
    try:
        rows = reader.option("multiLine", multi_line).csv(path)
        return rows.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_START))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _typed(name: str, kind: T.DataType) -> Column:
    value = F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.try_to_timestamp(value)
    if isinstance(kind, T.ArrayType):
        parse = tx.parse_list if isinstance(kind.elementType, T.StringType) else tx.parse_ref_list
        return parse(value)
    if name in _NEVER_NULL:
        return F.coalesce(value, F.lit(""))
    return value.try_cast(kind)


def _scan(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    """Declared columns in declared types, and ``ordinal`` where the file numbers its rows."""
    raw = _raw(spark, path, multi_line)
    if raw is None:
        return spark.createDataFrame([], schema)
    columns = [_typed(f.name, f.dataType).alias(f.name) for f in schema]
    for name in ("_c0", ORDINAL):  # an index column without a name, or one written here
        if name in raw.columns:
            columns.append(F.col(name).try_cast("long").alias(ORDINAL))
    return raw.select(*columns)


def unreadable(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """(column, rows, unreadable): per column, the rows with a value and those whose value became null."""
    raw = _raw(spark, path, multi_line)
    counts = "column string, rows long, unreadable long"
    if raw is None:
        return spark.createDataFrame([(f.name, 0, 0) for f in schema], counts)
    cells = []
    for f in schema:
        held = F.col(f.name).isNotNull()
        lost = held & _typed(f.name, f.dataType).isNull()
        cells.append(
            F.struct(F.lit(f.name).alias("column"), F.count_if(held).alias("rows"), F.count_if(lost).alias("unreadable"))
        )
    return raw.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def scan_tweets(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return _scan(spark, path, schemas.TWEETS, multi_line)


def scan_users(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return _scan(spark, path, schemas.USERS, multi_line)


def scan_follows(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return _scan(spark, path, schemas.FOLLOWS, multi_line)


def scan_years(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All yearly files below a folder or glob as one table; index columns are dropped."""
    return _scan(spark, path, schema, multi_line=False).drop(ORDINAL)


def load_datasets(
    spark: SparkSession, tweets_path: str, users_path: str
) -> tuple[DataFrame, DataFrame]:
    """Posts, and users with the first record of each by row number.

    Records of files that do not number their rows are ordered by file name, then by where they
    stand in the file. Posts are not sorted here: whatever needs their order sorts by
    ``timestamp`` itself.
    """
    raw, tweets = _raw(spark, users_path, False), scan_tweets(spark, tweets_path)
    if raw is None:
        return tweets, scan_users(spark, users_path)
    if ORDINAL in raw.columns or "_c0" in raw.columns:
        return tweets, keep_first(scan_users(spark, users_path), "user_id", ORDINAL)
    # a task reads a split from its begin to its end, so its row numbers rise within the split
    place = F.struct(_FILE, _START, F.monotonically_increasing_id().alias("row"))
    users = raw.select(*[_typed(f.name, f.dataType).alias(f.name) for f in schemas.USERS], place.alias(ORDINAL))
    first = keep_first(users, "user_id", ORDINAL)
    return tweets, first.drop(ORDINAL)


def _stored(name: str, kind: T.DataType) -> Column:
    value = F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.date_format(value, _STAMP)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType):
            return tx.flatten_newlines(tx.list_text(value))
        return tx.flatten_newlines(tx.ref_list_text(value))
    if isinstance(kind, T.StringType):
        return tx.flatten_newlines(value)
    return value


def _sink(df: DataFrame, path: str, schema: T.StructType, mode: str = "overwrite") -> None:
    columns = [_stored(f.name, f.dataType).alias(f.name) for f in schema]
    if ORDINAL in df.columns:
        columns.append(F.col(ORDINAL))
    df.select(*columns).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def sink_tweets(tweets: DataFrame, path: str) -> None:
    _sink(tweets, path, schemas.TWEETS)


def sink_users(users: DataFrame, path: str) -> None:
    _sink(users, path, schemas.USERS)


def sink_follows(edges: DataFrame, path: str) -> None:
    _sink(edges, path, schemas.FOLLOWS)


def follow_edges(stored: DataFrame, accounts: DataFrame) -> DataFrame:
    """Stored edges, one per follower of an account and one per account it follows.

    ``accounts`` has user_id and the id arrays followers_ids and followings_ids; repeated edges
    are kept.
    """
    account, other = F.col("user_id"), F.col("_other")
    followers = accounts.select("user_id", F.explode("followers_ids").alias("_other")).select(
        account.alias("account_id"), other.alias("follower_id")
    )
    followings = accounts.select("user_id", F.explode("followings_ids").alias("_other")).select(
        other.alias("account_id"), account.alias("follower_id")
    )
    edges = stored.select("account_id", "follower_id")
    return edges.unionByName(followers).unionByName(followings)


def nested_as_text(posts: DataFrame) -> DataFrame:
    """Wide posts with nested columns as JSON text, null where there is nothing to tell."""
    as_text = {}
    for name in ("referenced_tweets", "context_annotations"):
        as_text[name] = F.when(F.size(name) > 0, F.to_json(name))
    for name in ("geo", "entities"):
        as_text[name] = F.to_json(name)
    return posts.withColumns(as_text)


def sink_nested(posts: DataFrame, path: str) -> None:
    flat = nested_as_text(posts).withColumn("text", tx.flatten_newlines(F.col("text")))
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
