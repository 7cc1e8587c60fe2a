"""Parquet tables partitioned by year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sink_by_year(df: DataFrame, path: str) -> None:
    """Replace the years present in ``df``; other years stay.

    The rebalance hint lets adaptive execution gather a small year into few files and split a
    large one.
    """
    df.hint("rebalance", F.col("year")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("year").parquet(path)


def append_state(df: DataFrame, path: str) -> None:
    """Add rows to a yearly table without reading what it holds; repeats are kept."""
    df.hint("rebalance", F.col("year")).write.mode("append").partitionBy("year").parquet(path)


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def train_test_scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All years but the last to train on, and the last; both empty below two years.

    The year list comes from the partition folders, so each side reads only its own files.
    """
    table = scan_table(spark, path)
    years = sorted(row[0] for row in table.select("year").distinct().collect())
    if len(years) < 2:
        return table.limit(0), table.limit(0)
    return table.where(F.col("year") < years[-1]), table.where(F.col("year") == years[-1])


def union_years(frames: list[DataFrame]) -> DataFrame:
    """Concatenate frames whose columns may differ."""
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole
