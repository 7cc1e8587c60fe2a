"""Incremental ingest of API pages into yearly tables, one batch of files at a time.

Both tables are written from the same batch, under its number, and a batch that is run again
replaces what it wrote. So a run that ends between the two tables is repaired by the next one,
and every file is taken exactly once into both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplecast import schemas
from ripplecast.functions.text import flatten_newlines
from ripplecast.operators.ordering import keep_first
from ripplecast.sources.api import normalize_api

BATCH = "batch"


def ingest_tables(pages: DataFrame) -> dict[str, DataFrame]:
    """Posts and users of pages, as they are stored; users are not yet one for each id."""
    tweets, users = normalize_api(pages)
    tweets = tweets.withColumn("text", flatten_newlines(F.col("text"))).withColumn(
        "year", F.year("timestamp")
    )
    return {"tweets": tweets, "users": users}


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table with its batch numbers; empty before the first batch."""
    declared = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    try:
        return spark.read.schema(declared).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], declared)
        raise


def _replace(rows: DataFrame, path: str, number: int, by: list[str]) -> None:
    """Write a batch's rows in place of what an earlier run of the batch wrote."""
    numbered = rows.withColumn(BATCH, F.lit(number).cast("long"))
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH, *by).parquet(path)


def take_batch(pages: DataFrame, number: int, target: str, between: Callable[[int], None] | None = None) -> None:
    """Append a batch of pages: all its posts, and the users that no earlier batch has.

    Of a user's records in a batch, that of the first file by name stays. ``between`` is called with the
    batch's number when its posts are written and its users are not.
    """
    spark = pages.sparkSession
    tables = ingest_tables(pages)
    _replace(tables["tweets"], f"{target}/tweets", number, ["year"])
    if between is not None:
        between(number)
    placed = normalize_api(pages, keep=["file"])[1]
    users = keep_first(placed.where("user_id is not null"), "user_id", "file").drop("file")
    known = stored(spark, f"{target}/users", users.schema).where(F.col(BATCH) < number)
    _replace(users.join(known, "user_id", "left_anti"), f"{target}/users", number, [])


def incremental_ingest(
    spark: SparkSession, folder: str, target: str, checkpoints: str, files_per_batch: int = 1000,
    between: Callable[[int], None] | None = None,
) -> None:
    """Take every page file not seen before, then stop; ``between`` as in ``take_batch``."""
    pages = spark.readStream.schema(schemas.TWEET_PAGE).option("maxFilesPerTrigger", files_per_batch).json(folder)
    pages = pages.select("*", F.col("_metadata.file_path").alias("file"))
    query = (
        pages.writeStream.foreachBatch(lambda batch, number: take_batch(batch, number, target, between))
        .option("checkpointLocation", checkpoints)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ingested(spark: SparkSession, target: str, name: str, schema: T.StructType) -> DataFrame:
    """A table without its batch numbers."""
    return stored(spark, f"{target}/{name}", schema).drop(BATCH)
