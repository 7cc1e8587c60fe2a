"""Helpers shared by the operators: tables in the shared folder, running totals, Arrow slices, components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplecast.session import scratch_path

#: Characters between words, as a Java and Python character class.
BLANKS = r"[\x20\x09-\x0D]"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Texts are long, so a Python worker gets 1,000 rows at a time unless set otherwise."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """The rows, written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name the table does not have yet."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def running(
    df: DataFrame, order: Sequence[str], totals: dict[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Add, for every (name, weight), the sum of the weight over the rows before this one.

    The rows are range-sorted by ``by`` and ``order``; each range adds up its own rows and then
    the totals of the ranges before it, so neither a large group nor the whole table meets in one
    task. Rows that agree in all of ``order`` are put in some fixed order.
    """
    by, order = list(by), [*order, "_tie"]
    ranged = stored(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .withColumns({f"_w_{name}": weight for name, weight in totals.items()})
        .repartitionByRange(*by, *order)
        .withColumn("_part", F.spark_partition_id()),
        "ranged",
    )
    cell = ["_part", *by]
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    starts = (
        ranged.groupBy(*cell)
        .agg(*[F.sum(f"_w_{name}").alias(f"_s_{name}") for name in totals])
        .select(*cell, *[F.coalesce(F.sum(f"_s_{n}").over(ahead), zero).alias(f"_b_{n}") for n in totals])
    )
    inside = ranged.withColumns(
        {f"_i_{n}": F.coalesce(F.sum(f"_w_{n}").over(inner), zero) for n in totals}
    )
    same = [inside[name].eqNullSafe(starts[name]) for name in cell]
    return inside.join(starts, same).select(
        *[inside[name] for name in df.columns],
        *[(F.col(f"_i_{name}") + F.col(f"_b_{name}")).alias(name) for name in totals],
    )


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice holds about ``most`` bytes of a text or binary column."""
    for batch in batches:
        place = batch.schema.get_field_index(column)
        rows = max(1, min(batch.num_rows, int(batch.num_rows * most / max(1, batch.column(place).nbytes))))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of an undirected edge, the smallest node it can reach.

    Alternating large-star and small-star rounds: in each, a node's larger neighbours (then, its
    smaller ones) are hung under its smallest neighbour, until all that is left are stars: nodes
    that hang under one other, which hangs under none. Every round is a grouped minimum and a join
    whose hot side AQE splits; the edge list never grows beyond its start and one row a node, and
    each round is written to the shared folder. Nothing but the answer whether it is done reaches
    the driver.
    """
    spark = edges.sparkSession
    ends = [F.col(name).cast("long") for name in (a, b)]
    links = edges.select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v"), *ends)
    links = stored(links.dropna().where("u <> v").select("u", "v").distinct(), "links")

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("n"), F.least("u", "m").alias("m")
        )
        kept = both.where("v > u" if large else "v <= u")
        hung = kept.join(least, kept["u"] == least["n"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            hung = hung.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
        return hung.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

    def settled(pairs: DataFrame) -> bool:
        ends = F.array(*[F.struct(F.col(c).alias("node"), F.lit(c == "u").alias("hangs")) for c in "uv"])
        ends = pairs.select(F.explode(ends).alias("end")).select("end.*").groupBy("node")
        ends = ends.agg(F.count_if("hangs").alias("under"), F.count_if(~F.col("hangs")).alias("over"))
        return ends.where("under > 1 OR under = 1 AND over > 0").isEmpty()

    while not settled(links):
        links = stored(star(star(links, large=True), large=False).distinct(), "links")
    roots = links.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("v"))
    found = links.unionByName(roots).groupBy("u").agg(F.min("v").alias("v"))
    return spark.createDataFrame([], "u long, v long").unionByName(found).toDF("node", "component")
