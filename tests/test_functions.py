"""Golden values of the column expressions."""

import pytest
from pyspark.sql import functions as F

from ripplecast.functions import numeric as nm
from ripplecast.functions import text as tx
from ripplecast.functions import timeparts as tp
from ripplecast.functions import topics as tg
from ripplecast.functions.sentiment import mean_valences, sentiment_class, sentiment_score, valences


def apply(spark, values, kind, expression):
    rows = [(i, value) for i, value in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [row[0] for row in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_device_takes_the_first_fragment(spark):
    sources = ["App for iPad", "iOS App", "Web for Mac", "Mobile Web", "Toaster", "android"]
    expected = ["iPad", "iPhone", "Mac", "Mobile device", "", ""]
    assert apply(spark, sources, "string", tx.device_class) == expected


def test_last_recognised_reference_decides_the_type(spark):
    kind = "array<struct<id:long,type:string>>"
    refs = [
        [(1, "quoted"), (2, "replied_to")],
        [(1, "retweeted"), (2, "liked")],
        [(1, "liked")],
        [],
        None,
    ]
    expected = ["Reply Tweet", "Retweet Tweet", "", "", "Original Tweet"]
    assert apply(spark, refs, kind, tx.tweet_type) == expected


def test_topic_groups_take_the_first_rule(spark):
    topics = ["Brand Person", "Sports League", "TV Shows", "Travel", None, "esports", "Coach"]
    expected = ["Brand", "Sport", "TV and Movies", "Other", None, "Other", "Sport"]
    assert apply(spark, topics, "string", tg.topic_group) == expected


def test_hashtags_need_a_letter_and_a_word_break(spark):
    texts = ["#abc", "a#abc", "#12", "#1a", "#été", "see #x.", ""]
    expected = [True, False, False, True, True, True, False]
    assert apply(spark, texts, "string", tx.has_hashtag) == expected


def test_keywords_match_whole_tokens_only(spark):
    texts = ["the WHO said", "Lockdown now", "lockdown, now", "panic buying", "covid-19", None]
    token = apply(spark, texts, "string", lambda c: tx.keyword_match(c, tx.COVID_KEYWORDS))
    assert token == [0, 1, 0, 0, 1, 0]
    phrase = apply(
        spark, texts, "string", lambda c: tx.keyword_match(c, tx.COVID_KEYWORDS, "phrase")
    )
    assert phrase == [1, 1, 1, 1, 1, 0]


def test_reference_lists_survive_their_text_form(spark):
    kind = "array<struct<id:long,type:string>>"
    refs = [[(12, "quoted"), (7, "replied_to")], [], None]
    back = apply(spark, refs, kind, lambda c: tx.parse_ref_list(tx.ref_list_text(c)))
    assert back == refs
    first = apply(spark, refs, kind, lambda c: tx.ref_tweet_id(tx.ref_list_text(c)))
    assert first == [12, None, None]


def test_first_list_item(spark):
    stored = ["['a b', 'c']", "[]", None, "[\"Women's Sports\", 'News']", "no list"]
    items = apply(spark, stored, "string", tx.first_list_item)
    assert items == ["a b", None, None, "Women's Sports", None]


def test_lists_survive_their_text_form(spark):
    lists = [["Women's Sports", "News"], ["'\"", "a\\", "\\'", "x, y]", ""], [], None]
    back = apply(spark, lists, "array<string>", lambda c: tx.parse_list(tx.list_text(c)))
    assert back == lists


def test_newlines_are_flattened(spark):
    assert apply(spark, ["a\r\nb\rc\nd"], "string", tx.flatten_newlines) == ["a bc d"]


@pytest.mark.parametrize(
    "hour,phase",
    [(0, "Middle of the night"), (6, "Middle of the night"), (7, "Morning"), (12, "Morning"),
     (13, "Afternoon"), (16, "Dusk"), (19, "Dusk"), (20, "Night"), (23, "Night")],
)
def test_day_phases(spark, hour, phase):
    stamp = [f"2020-01-01 {hour:02d}:59:59"]
    assert apply(spark, stamp, "string", lambda c: tp.day_phase(tp.to_utc(c))) == [phase]


def test_week_of_the_old_year_keeps_the_calendar_year(spark):
    stamps = ["2021-01-01 00:00:00", "2020-02-05 00:00:00"]
    weeks = apply(spark, stamps, "string", lambda c: tp.week_index(tp.to_utc(c)))
    assert weeks == ["2021-53", "2020-06"]


def test_seniority_counts_whole_years_towards_zero(spark):
    created = ["2012-02-29", "2020-12-31", "2021-06-01"]
    years = apply(
        spark, created, "string", lambda c: tp.seniority(c.cast("date"), F.lit(2020))
    )
    assert years == [8, 0, 0]


def test_unreadable_time_is_null(spark):
    assert apply(spark, ["soon"], "string", tp.to_utc) == [None]


def test_sentiment_bounds_are_inclusive(spark):
    scores = [0.05, -0.05, 0.049, 0.0]
    expected = ["Positive", "Negative", "Neutral", "Neutral"]
    assert apply(spark, scores, "double", sentiment_class) == expected


def normal(total):
    return pytest.approx(total / (total**2 + 15) ** 0.5)


def test_sentiment_negation_reaches_three_tokens(spark):
    posts = spark.createDataFrame(
        [(1, "not at all good"), (2, "not one two three good"), (3, "good"), (4, "plain"), (5, None), (6, "isn't good")],
        "tweet_id long, text string",
    )
    lexicon = spark.createDataFrame([("good", 1.9)], "word string, valence double")
    got = dict(map(tuple, sentiment_score(posts, lexicon).collect()))
    assert got[1] == got[6] == normal(-0.74 * 1.9)
    assert got[2] == got[3] == normal(1.9)
    assert got[4] == got[5] == 0.0


def test_sentiment_of_punctuation_and_repeated_ids(spark):
    posts = spark.createDataFrame(
        [(1, "oh great,"), (2, "\"great\","), (3, "great"), (3, "great"), (4, ":) ."), (5, "")],
        "tweet_id long, text string",
    )
    words = [("great", 3.1), (":)", 2.0)]
    lexicon = spark.createDataFrame(words, "word string, valence double")
    rows = sentiment_score(posts, lexicon).collect()
    assert len(rows) == 6
    got = dict(map(tuple, rows))
    assert got[1] == got[2] == got[3] == normal(3.1)
    assert got[4] == normal(2) and got[5] == 0.0


def test_sentiment_rules(spark):
    cases = {
        "so good": 1.9 + 0.293,
        "so very good": 1.9 + 0.293 + 0.293 * 0.95,
        "really a b good": 1.9 + 0.293 * 0.9,
        "barely good": 1.9 - 0.293,
        "so bad": -2.5 - 0.293,
        "not so good": -0.74 * (1.9 + 0.293),
        "a GOOD day": 1.9 + 0.733,
        "GOOD": 1.9,  # all in capitals: no stress
        "SO good": 1.9 + 0.293 + 0.733,
        "good but bad": 1.9 * 0.5 - 2.5 * 1.5,
        "good but bad but bad": 1.9 * 0.5 - 2.5 * 3,
        "good!!!!!!": 1.9 + 4 * 0.292,
        "bad!": -2.5 - 0.292,
        "good?": 1.9,
        "good???": 1.9 + 3 * 0.18,
        "good?????": 1.9 + 0.96,
        "plain!": 0.0,
        "good bad good bad good": 3 * 1.9 - 2 * 2.5,
    }
    posts = spark.createDataFrame(list(enumerate(cases)), "tweet_id long, text string")
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5), ("bad", -2.5)], "word string, valence double")
    got = dict(map(tuple, sentiment_score(posts, lexicon).collect()))
    for i, (text, total) in enumerate(cases.items()):
        assert got[i] == normal(total), text


def test_sentiment_of_a_large_lexicon(spark):
    words = [(f"w{i}", (i % 17 - 8) / 2) for i in range(3000)]
    posts = spark.createDataFrame([(i, f"x w{i}") for i in range(0, 3000, 37)], "tweet_id long, text string")
    lexicon = spark.createDataFrame(words, "word string, valence double")
    got = dict(map(tuple, sentiment_score(posts, lexicon).collect()))
    assert all(got[i] == normal((i % 17 - 8) / 2) for i in got)
    with pytest.raises(ValueError, match="more than 100 words"):
        valences(lexicon, 100)


def test_words_of_a_literal_lexicon_are_lowered_by_tasks(spark):
    lexicon = spark.sql("SELECT * FROM VALUES ('Good', 1.0D), ('good', 2.0D), (null, 1.0D) AS l(word, valence)")
    plan = mean_valences(lexicon)._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(" in plan
    assert valences(lexicon) == {"good": 1.5}


def test_half_even_rounding(spark):
    rounded = apply(spark, [0.125, 0.375, -0.125], "double", nm.round_half_even)
    assert rounded == [0.12, 0.38, -0.12]


def test_missing_count_is_popular(spark):
    assert apply(spark, [0, 3, None], "long", tx.popularity) == [0, 1, 1]
