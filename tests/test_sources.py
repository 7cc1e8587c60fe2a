"""Files from elsewhere, API pages, yearly tables, streamed pages."""

import json

import pytest
from pyspark.sql import functions as F

from ripplecast import schemas
from ripplecast.catalogue import data
from ripplecast.sources import api, csvfiles, tables
from ripplecast.streaming import ingest
from ripplecast.streaming.ingest import incremental_ingest, ingest_tables, ingested

FOREIGN = ''',tweet_id,text,user_id,timestamp,tweet_type,like_count,reply_count,retweet_count,quote_count,device,lang,topics_ids,topics,referenced_tweets
0,1,"one, ""two""",10,2020-05-01 10:00:00,Quote Tweet,1,2,3,4,,en,"['45', '46']","['News', 'Book']","[ReferencedTweet(id: 123, type: quoted 
, ReferencedTweet(id: 9, type: replied_to 
]"
1,2,plain,11,2020-05-02 11:00:00+00:00,Original Tweet,0,0,0,0,iPhone,en,[],[],
'''


def test_files_written_elsewhere(spark, tmp_path):
    path = tmp_path / "tweets.csv"
    path.write_text(FOREIGN)
    rows = csvfiles.scan_tweets(spark, str(path), multi_line=True).orderBy("tweet_id").collect()
    assert rows[0]["text"] == 'one, "two"' and rows[0]["device"] == ""
    assert rows[0]["topics"] == ["News", "Book"] and rows[0]["ordinal"] == 0
    assert [tuple(r) for r in rows[0]["referenced_tweets"]] == [(123, "quoted"), (9, "replied_to")]
    assert rows[1]["referenced_tweets"] is None and rows[1]["topics"] == []
    assert rows[1]["timestamp"].hour == 11


def test_missing_file_is_an_empty_table(spark, tmp_path):
    missing = str(tmp_path / "none.csv")
    assert csvfiles.scan_users(spark, missing).count() == 0
    assert csvfiles.scan_tweets(spark, missing).columns[0] == "tweet_id"


def test_users_keep_the_first_record(spark, tmp_path):
    users = tmp_path / "users.csv"
    users.write_text(
        ",user_id,name,username,followers,following,tweet_count,verified,created_at\n"
        "0,1,a,a,5,1,1,True,2010-01-01 00:00:00\n"
        "1,1,a,a,6,1,1,True,2010-01-01 00:00:00\n"
    )
    _, first = csvfiles.load_datasets(spark, str(tmp_path / "none"), str(users))
    assert [(r["followers"], r["verified"]) for r in first.collect()] == [(5, True)]


def page(ids, users):
    metrics = {"like_count": 1, "reply_count": 0, "retweet_count": 2, "quote_count": 0}
    data = [
        {"id": str(i), "text": f"t\n{i}", "author_id": str(i % 10), "lang": "en",
         "created_at": f"20{20 + i % 2}-01-01T00:00:00.000Z", "source": "Some Web App",
         "public_metrics": metrics, "context_annotations": None, "referenced_tweets": None}
        for i in ids
    ]
    counts = {"followers_count": 3, "following_count": 4, "tweet_count": 5}
    people = [
        {"id": str(u), "name": name, "username": f"n{u}", "verified": False,
         "created_at": "2015-01-01T00:00:00.000Z", "public_metrics": counts}
        for u, name in users
    ]
    return json.dumps({"data": data, "includes": {"users": people}})


def test_last_matching_user_wins_and_unknown_ones_are_null(spark, tmp_path):
    (tmp_path / "p.json").write_text(page([1, 2], [(1, "old"), (1, "new"), (5, "other")]))
    pages = api.read_tweet_pages(spark, str(tmp_path))
    got = {r["tweet"]["id"]: r["user"] for r in api.include_user_match(pages).collect()}
    assert got["1"]["name"] == "new" and got["2"] is None
    tweets, users = api.normalize_api(pages)
    row = tweets.orderBy("tweet_id").first()
    assert row["topics"] is None and row["tweet_type"] == "Original Tweet"
    assert row["device"] == "Web" and users.count() == 1


def test_page_without_data_has_no_rows(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"data": null, "includes": {"users": []}}')
    tweets, users = api.normalize_api(api.read_tweet_pages(spark, str(tmp_path)))
    assert tweets.count() == 0 and users.count() == 0


def test_users_of_files_without_row_numbers_follow_file_names(spark, tmp_path):
    folder = tmp_path / "users"
    folder.mkdir()
    head = "user_id,name,username,followers,following,tweet_count,verified,created_at\n"
    filler = "".join(f"{i},n,n,0,1,1,True,2010-01-01 00:00:00\n" for i in range(100, 400))
    (folder / "b.csv").write_text(head + "1,z,z,9,1,1,True,2010-01-01 00:00:00\n")
    (folder / "a.csv").write_text(head + filler + "".join(f"1,a,a,{k},1,1,True,2010-01-01 00:00:00\n" for k in (5, 6)))
    found = []
    for size in ("128MB", "600"):  # in one task, and in many splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        _, first = csvfiles.load_datasets(spark, str(tmp_path / "none"), str(folder))
        found.append(sorted(map(tuple, first.where("user_id = 1").select("followers", "name").collect())))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == [[(5, "a")], [(5, "a")]]


def test_unreadable_values_are_counted(spark, tmp_path):
    users = tmp_path / "users.csv"
    users.write_text(
        "user_id,name,username,followers,following,tweet_count,verified,created_at\n"
        "1,a,a,5,x,1,True,2010-01-01 00:00:00\n2,b,b,many,,1,maybe,some day\n"
    )
    rows = csvfiles.unreadable(spark, str(users), schemas.USERS).collect()
    got = {r["column"]: (r["rows"], r["unreadable"]) for r in rows}
    assert got["followers"] == (2, 1) and got["following"] == (1, 1) and got["user_id"] == (2, 0)
    assert got["verified"] == (2, 1) and got["created_at"] == (2, 1)


def test_two_drops_of_pages_equal_one_batch(spark, tmp_path):
    drop, target, marks = (tmp_path / name for name in ("in", "out", "marks"))
    drop.mkdir()
    (drop / "a.json").write_text(page(range(5), [(1, "a")]))
    incremental_ingest(spark, str(drop), str(target), str(marks))
    (drop / "b.json").write_text(page(range(5, 19), [(1, "late"), (6, "b")]))
    incremental_ingest(spark, str(drop), str(target), str(marks))
    incremental_ingest(spark, str(drop), str(target), str(marks))
    batch = ingest_tables(api.read_tweet_pages(spark, str(drop)))
    expected = batch["tweets"]
    got = ingested(spark, str(target), "tweets", expected.schema).select(expected.columns)
    assert sorted(got.collect(), key=str) == sorted(expected.collect(), key=str)
    users = ingested(spark, str(target), "users", batch["users"].schema).collect()
    assert sorted((r["user_id"], r["name"]) for r in users) == [(1, "a"), (6, "b")]


def test_a_run_that_ends_between_the_tables_is_repaired(spark, tmp_path, monkeypatch):
    drop, target, marks = (tmp_path / name for name in ("in", "out", "marks"))
    drop.mkdir()
    (drop / "a.json").write_text(page(range(5), [(1, "a")]))
    incremental_ingest(spark, str(drop), str(target), str(marks))
    (drop / "b.json").write_text(page(range(5, 9), [(6, "b"), (7, "c")]))
    whole, calls = ingest._replace, []

    def dies(*args):
        calls.append(args[1])
        if len(calls) == 2:
            raise RuntimeError("killed")
        whole(*args)

    monkeypatch.setattr(ingest, "_replace", dies)
    with pytest.raises(Exception, match="killed"):
        incremental_ingest(spark, str(drop), str(target), str(marks))
    assert spark.read.parquet(str(target / "tweets")).count() == 9  # the posts are there, the users are not
    assert spark.read.parquet(str(target / "users")).count() == 1
    monkeypatch.setattr(ingest, "_replace", whole)
    incremental_ingest(spark, str(drop), str(target), str(marks))
    assert spark.read.parquet(str(target / "tweets")).count() == 9
    assert sorted(r["user_id"] for r in spark.read.parquet(str(target / "users")).collect()) == [1, 6, 7]


def test_only_present_years_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.sink_by_year(spark.createDataFrame([(1, 2019), (2, 2020)], "id int, year int"), path)
    tables.sink_by_year(spark.createDataFrame([(3, 2020)], "id int, year int"), path)
    assert sorted(map(tuple, tables.scan_table(spark, path).collect())) == [(1, 2019), (3, 2020)]
    train, test = tables.train_test_scan(spark, path)
    assert [r["id"] for r in train.collect()] == [1] and [r["id"] for r in test.collect()] == [3]


def test_one_year_gives_no_split(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.sink_by_year(spark.createDataFrame([(1, 2019)], "id int, year int"), path)
    train, test = tables.train_test_scan(spark, path)
    assert train.count() == test.count() == 0


def test_append_keeps_repeats(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 2019)], "id int, year int")
    tables.append_state(rows, path)
    tables.append_state(rows, path)
    assert tables.scan_table(spark, path).count() == 2


def test_follow_edges_point_at_the_followed(spark):
    stored = spark.createDataFrame([(1, 2)], "account_id long, follower_id long")
    accounts = spark.createDataFrame(
        [(5, [6, 7], [8])], "user_id long, followers_ids array<long>, followings_ids array<long>"
    )
    got = sorted(map(tuple, csvfiles.follow_edges(stored, accounts).collect()))
    assert got == [(1, 2), (5, 6), (5, 7), (8, 5)]


def test_empty_nested_columns_are_null(spark):
    df = spark.sql(
        "select 1 id, array() referenced_tweets, array(named_struct('a', 1)) context_annotations,"
        " cast(null as struct<x:int>) geo, named_struct('u', 'v') entities"
    )
    row = csvfiles.nested_as_text(df).first()
    assert row["referenced_tweets"] is None and row["geo"] is None
    assert row["context_annotations"] == '[{"a":1}]' and row["entities"] == '{"u":"v"}'


def test_union_of_different_columns(spark):
    both = tables.union_years([spark.sql("select 1 a"), spark.sql("select 2 b")])
    assert both.where(F.col("a").isNull()).first()["b"] == 2


def test_pages_of_a_drop_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    orders = "id AS o_orderkey, id % 7 AS o_custkey, 1D AS o_totalprice, DATE '2020-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority"
    spark.range(1, 1200).selectExpr(*orders.split(", ")).write.parquet(f"{tmp_path}/in/orders.parquet")
    spark.range(7).selectExpr("id AS c_custkey", "'name' AS c_name", "double(id) AS c_acctbal").write.parquet(f"{tmp_path}/in/customer.parquet")
    spark.range(1, 1200).selectExpr("id AS l_orderkey").write.parquet(f"{tmp_path}/in/lineitem.parquet")
    monkeypatch.setattr(data, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    settings = {"spark.sql.shuffle.partitions": "3", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        made = data.incremental_ingest(spark, f"{tmp_path}/in").groupBy("kind").count().collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(list((tmp_path / "drop").glob("part-*.json"))) > 2
    assert dict(map(tuple, made)) == {"post": 1199, "user": 7}


def test_the_ingest_query_ends_its_second_drop_between_the_tables_and_runs_it_again(spark, tmp_path, monkeypatch):
    orders = "id AS o_orderkey, id % 7 AS o_custkey, 1D AS o_totalprice, DATE '2020-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority"
    spark.range(1, 1200).selectExpr(*orders.split(", ")).write.parquet(f"{tmp_path}/in/orders.parquet")
    spark.range(7).selectExpr("id AS c_custkey", "'name' AS c_name", "double(id) AS c_acctbal").write.parquet(f"{tmp_path}/in/customer.parquet")
    spark.range(1, 1200).selectExpr("id AS l_orderkey").write.parquet(f"{tmp_path}/in/lineitem.parquet")
    monkeypatch.setattr(data, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    whole, written = ingest._replace, []

    def noted(rows, path, number, by):
        written.append((number, path.rsplit("/", 1)[1]))
        whole(rows, path, number, by)

    monkeypatch.setattr(ingest, "_replace", noted)
    made = data.incremental_ingest(spark, f"{tmp_path}/in").groupBy("kind").count().collect()
    assert written == [(0, "tweets"), (0, "users"), (1, "tweets"), (1, "tweets"), (1, "users")]
    assert dict(map(tuple, made)) == {"post": 1199, "user": 7}
