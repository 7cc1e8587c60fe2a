"""Positions, running totals and row numbers that no single task has to produce alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplecast.session import cut_lineage

_ROWS_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def keep_first(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The row with the lowest ordinal of every key, by partial aggregation.

    Rows without an ordinal come last; rows of equal ordinals are ordered by a hash of the row.
    """
    rest = [name for name in df.columns if name != key]
    place = F.struct(F.isnull(ordinal), F.col(ordinal), F.xxhash64(*rest))
    first = F.min_by(F.struct(*rest), place).alias("_first")
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(first)
    return kept.select(key, *[F.col("_first")[name].alias(name) for name in rest]).select(
        *df.columns
    )


def running_sums(
    df: DataFrame,
    order: Sequence[str],
    sums: dict[str, Column],
    by: Sequence[str] = (),
    whole: dict[str, str] | None = None,
) -> DataFrame:
    """Add, for every (name, weight), the sum of the weight over the earlier rows of the group.

    The rows are range-sorted by ``by`` and ``order``, so a large group lies in several ranges.
    Each range adds up its own rows and then the totals of the ranges before it; neither a group
    nor the table meets in one task. Rows that agree in all of ``order`` are put in some order.
    ``whole`` names columns for the total of a sum over the whole group. The sorted rows are
    checkpointed, because their partition numbers are used twice.
    """
    by, order, whole = list(by), [*order, "_tie"], whole or {}
    ranged = cut_lineage(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .withColumns({f"_w_{name}": weight for name, weight in sums.items()})
        .repartitionByRange(*by, *order)
        .withColumn("_range", F.spark_partition_id())
    )
    cell, zero = ["_range", *by], F.lit(0)
    group = Window.partitionBy(*by)  # one row per range that a group reaches into
    ahead = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*cell)
        .agg(*[F.sum(f"_w_{name}").alias(f"_s_{name}") for name in sums])
        .select(
            *[F.col(name).alias(f"_of_{name}") for name in cell],
            *[F.coalesce(F.sum(f"_s_{name}").over(ahead), zero).alias(f"_b_{name}") for name in sums],
            *[F.sum(f"_s_{of}").over(group).alias(name) for name, of in whole.items()],
        )
    )
    earlier = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumns(
        {f"_i_{name}": F.coalesce(F.sum(f"_w_{name}").over(earlier), zero) for name in sums}
    )
    same = [F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in cell]
    return inside.join(starts, same).select(
        *df.columns,
        *[(F.col(f"_i_{name}") + F.col(f"_b_{name}")).alias(name) for name in sums],
        *whole,
    )


def positions(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Add ``pos``, the 0-based place of a row within its key, and ``n``, the key's row count.

    Rows without a key are a group too.
    """
    one = F.lit(1).cast("long")
    return running_sums(df, order, {"pos": one}, by=[key], whole={"n": "pos"})


def row_index(df: DataFrame, order: Sequence[str | Column], name: str = "idx") -> DataFrame:
    """Add a 0-based row number over the whole table in the given order.

    The range sort splits any pile-up on the leading columns by the later ones. The sorted rows
    are checkpointed, because their partition numbers are used twice.
    """
    tagged = cut_lineage(
        df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", _ROWS_BITS))
    starts = (
        tagged.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_start", F.sum("_c").over(Window.orderBy("_part")) - F.col("_c"))
        .drop("_c")
    )  # one row per partition
    local = F.col("_at").bitwiseAND(F.lit((1 << _ROWS_BITS) - 1))
    return tagged.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + local).alias(name)
    )


def bucket_of(value: Column, cuts: Sequence[float]) -> Column:
    """Number of cut points below the value."""
    if not cuts:
        return F.lit(0)
    points = F.array(*[F.lit(float(cut)) for cut in cuts])
    return F.size(F.filter(points, lambda cut: cut < value.cast("double")))


def running_total(df: DataFrame, value: str, weight: str, name: str = "upto") -> DataFrame:
    """Add the inclusive running sum of ``weight`` in ascending order of distinct ``value``."""
    summed = running_sums(df, [value], {name: F.col(weight)})
    return summed.withColumn(name, F.col(name) + F.col(weight))


def sort_by_time(df: DataFrame, stamp: str = "timestamp", key: str = "tweet_id") -> DataFrame:
    return df.orderBy(stamp, key)


def top_k(scores: DataFrame, k: int, score: str = "score", name: str = "feature") -> DataFrame:
    return scores.orderBy(F.desc_nulls_last(score), F.asc(name)).limit(k)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The non-null values of a column, each once, in order."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
