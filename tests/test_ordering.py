"""Ordered operators against plain Python, with hot keys forced."""

import random

import pytest
from pyspark.sql import functions as F

from ripplecast.operators import joins, ordering, sampling


@pytest.fixture(scope="module")
def shares(spark):
    """One cascade holds a third of the rows, many of them at the same minute or wholly equal."""
    draw = random.Random(1)
    rows = []
    for i in range(900):
        key = 1 if i % 3 == 0 else draw.randrange(2, 40)
        rows.append((key, draw.randrange(50) * 37, draw.randrange(6), i))
    df = spark.createDataFrame(rows, "k long, s long, u long, i long")
    return df.withColumn("at", F.timestamp_seconds(F.col("s")))


def test_positions(spark, shares):
    got = ordering.positions(shares, "k", ["at", "u", "i"]).collect()
    by_key = {}
    for row in got:
        by_key.setdefault(row["k"], []).append(row)
    for rows in by_key.values():
        rows.sort(key=lambda r: (r["at"], r["u"], r["i"]))
        assert [r["pos"] for r in rows] == list(range(len(rows)))
        assert {r["n"] for r in rows} == {len(rows)}
    assert len(got) == 900


def test_a_cascade_of_one_moment_lies_in_several_ranges(spark):
    """All rows share a key and a time; the later order columns still split them."""
    df = spark.range(4000).selectExpr("1L as k", "timestamp'2020-01-01' as at", "id as i")
    seen = []
    cut = ordering.cut_lineage

    def spy(rows):
        made = cut(rows)
        if "_range" in made.columns:
            seen.append(made.select("_range").distinct().count())
        return made

    ordering.cut_lineage = spy
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = ordering.positions(df, "k", ["at", "i"]).collect()
    finally:
        ordering.cut_lineage = cut
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen[0] >= 3
    assert all(r["pos"] == r["i"] and r["n"] == 4000 for r in rows)


def test_running_sums_by_group_with_nulls(spark):
    rows = [(None, 2, 5), (None, 1, 7), ("a", 3, 1), ("a", None, 4), ("b", 1, 2)]
    df = spark.createDataFrame(rows, "g string, o int, w long")
    got = ordering.running_sums(df, ["o"], {"s": F.col("w")}, by=["g"], whole={"t": "s"}).collect()
    assert {(r["g"], r["o"]): (r["s"], r["t"]) for r in got} == {
        (None, 1): (0, 12), (None, 2): (7, 12), ("a", None): (0, 5), ("a", 3): (4, 5), ("b", 1): (0, 2),
    }


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_keeps_facts_without_a_key(spark, shares, how):
    with_nulls = shares.withColumn("k", F.when(F.col("i") % 7 != 0, F.col("k")))
    table = spark.createDataFrame([(k, k * 10) for k in range(1, 30)], "k long, v long")
    got = joins.lookup_join(with_nulls, table, "k", how)
    assert got.columns == [*shares.columns, "v"]
    rows = with_nulls.collect()
    want = [r for r in rows if how == "left" or (r["k"] is not None and r["k"] < 30)]
    assert sorted(r["i"] for r in got.collect()) == sorted(r["i"] for r in want)


def test_row_index_follows_the_whole_order(spark, shares):
    rows = ordering.row_index(shares, ["at", "i"]).collect()
    rows.sort(key=lambda r: (r["at"], r["i"]))
    assert [r["idx"] for r in rows] == list(range(900))


def test_running_total(spark, shares):
    counts = shares.groupBy("s").agg(F.count("*").alias("c"))
    total = 0
    rows = ordering.running_total(counts, "s", "c").orderBy("s").collect()
    for row in rows:
        total += row["c"]
        assert row["upto"] == total
    assert total == 900


def test_keep_first(spark):
    rows = [(1, "b", 2), (1, "a", 1), (2, None, 5), (None, "x", 0), (3, "n", None), (1, "z", None)]
    df = spark.createDataFrame(rows, "k long, v string, o long")
    got = ordering.keep_first(df, "k", "o").orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "a", 1), (2, None, 5), (3, "n", None)]


def test_distinct_values_have_no_limit(spark):
    df = spark.range(5000).selectExpr("cast(nullif(id % 2500, 7) as string) as v")
    got = [r["v"] for r in ordering.distinct_values(df, "v").collect()]
    assert got == sorted(got) and len(got) == 2499


def test_sampling_caps_each_window_of_the_plan(spark):
    rows = [(i, f"2020-01-0{1 + i % 2} {h:02d}:{i % 60:02d}:00") for i in range(50) for h in (7, 9)]
    df = spark.createDataFrame(rows, "tweet_id long, t string").select(
        "tweet_id", F.col("t").cast("timestamp").alias("timestamp")
    )
    plan = sampling.sampling_plan(spark, "2020-01-01", "2020-01-04", 300)
    assert plan.count() == 20 and {r["cap"] for r in plan.collect()} == {sampling.window_cap(4, 300)} == {15}
    small = sampling.stratified_sample(df, plan)
    counts = {(str(r["date"]), r["hour"], r["count"]) for r in small.groupBy("date", "hour").count().collect()}
    assert counts == {("2020-01-01", 7, 15), ("2020-01-02", 7, 15)}
    assert max(r["tweet_id"] for r in small.collect()) == 29  # the first of each window
    found = {(str(r["date"]), r["hour"]): (r["found"], r["taken"]) for r in sampling.plan_yield(df, plan).collect()}
    assert len(found) == 20 and found["2020-01-02", 7] == (25, 15) and found["2020-01-03", 0] == (0, 0)


def test_sampling_limits():
    assert sampling.daily_limit(2, 100) == (50, 1)
    assert sampling.daily_limit(5, 50) == (10, 1)
    assert sampling.daily_limit(1, 250) == (100, 3)
