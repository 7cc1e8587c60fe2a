"""DuckDB SQL for the named queries, written from the definitions and not from the library."""

from __future__ import annotations

from ripplecast.adapters import LEXICON, SOURCES, TEXTS, TOPIC_NAMES

# Fixed values, written out here so that the SQL does not follow the library's own lists.
NEGATORS = ["not", "never", "no"]
SENTIMENTS = ["Negative", "Neutral", "Positive"]
MONTHS = [
    "January", "February", "March", "April", "May", "June", "July", "August", "September",
    "October", "November", "December",
]
WEEK_DAYS = [
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
]
DAY_PHASES = [
    "Morning", "Afternoon", "Dusk", "Night", "Middle of the night",
]
TOPICS = [
    "Brand", "Holiday", "Person", "Interest and Hobbies", "Sport", "TV and Movies", "Other",
    "Video Game", "Entities", "Political", "Music", "Book", "News",
]
COVID_KEYWORDS = [
    "Coronavirus", "Corona", "CDC", "Ncov", "Wuhan", "Outbreak", "China", "Koronavirus",
    "Wuhancoronavirus", "Wuhanlockdown", "N95", "Kungflu", "Epidemic", "Sinophobia", "Covid-19",
    "Corona virus", "Covid19", "Sars-cov-2", "COVID–19", "COVD", "Pandemic", "Coronapocalypse",
    "CancelEverything", "Coronials", "SocialDistancing", "Panic buying", "DuringMy14DayQuarantine",
    "Panic shopping", "InMyQuarantineSurvivalKit", "chinese virus", "stayhomechallenge",
    "DontBeASpreader", "lockdown", "shelteringinplace", "staysafestayhome", "trumppandemic",
    "flatten the curve", "GetMePPE", "covidiot", "epitwitter", "Pandemie", "PneumoniaWuhan",
    "CoronaVirusInfo", "V2019N", "CDCemergency", "CDCgov", "WHO", "HHSGov", "NIAIDNews",
]


def quoted(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return "'" + str(value).replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(quoted(i) for i in items) + "]"


def stamp(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S')"


def half_even(value: str) -> str:
    return f"(round_even(({value}) * 100.0, 0) / 100.0)"


_KEYWORDS = sql_list([w if w == "WHO" else w.lower() for w in COVID_KEYWORDS])
_MATCHED = f"CAST(list_has_any(string_split(lower(text), ' '), {_KEYWORDS}) AS INTEGER)"
# Fixed value: ASCII punctuation, as an SQL string.
_PUNCTUATION = """'!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"""

_HASHTAG = (
    r"regexp_matches(text, '(^|[^\p{L}\p{N}_])#[\p{L}\p{N}_]*[a-zA-Z][\p{L}\p{N}_]*')"
)


def device(source: str) -> str:
    def has(word):
        return f"contains({source}, '{word}')"

    return f"""CASE WHEN {has('iPhone')} OR {has('iOS')} THEN 'iPhone'
    WHEN {has('Android')} THEN 'Android' WHEN {has('Mobile')} THEN 'Mobile device'
    WHEN {has('Mac')} THEN 'Mac' WHEN {has('Windows')} THEN 'Windows'
    WHEN {has('Bot')} THEN 'Bot' WHEN {has('Web')} THEN 'Web'
    WHEN {has('Instagram')} THEN 'Instagram' WHEN {has('Blackberry')} THEN 'Blackberry'
    WHEN {has('iPad')} THEN 'iPad' WHEN {has('Foursquare')} THEN 'Foursquare' ELSE '' END"""


def group(topic: str) -> str:
    def has(*words):
        return " OR ".join(f"contains({topic}, '{word}')" for word in words)

    return f"""CASE WHEN {topic} IS NULL THEN NULL
    WHEN {has('Brand', 'Product')} THEN 'Brand'
    WHEN {has('Person')} THEN 'Person'
    WHEN {has('Sport', 'Athlete', 'Coach', 'Hockey', 'Football', 'NFL')} THEN 'Sport'
    WHEN {has('TV', 'Movie', 'Award', 'Actor', 'Fictional Character', 'Entertainment')}
      THEN 'TV and Movies'
    WHEN {has('Music', 'Musician', 'Concert', 'Song', 'Radio')} THEN 'Music'
    WHEN {has('Book')} THEN 'Book'
    WHEN {has('Hobbies')} THEN 'Interest and Hobbies'
    WHEN {has('Video Game', 'Esports', 'eSport')} THEN 'Video Game'
    WHEN {has('Political', 'Politicians')} THEN 'Political'
    WHEN {has('Holiday')} THEN 'Holiday'
    WHEN {has('News')} THEN 'News'
    WHEN {has('Entities')} THEN 'Entities'
    ELSE 'Other' END"""


def phase(hour: str) -> str:
    return f"""CASE WHEN {hour} <= 6 THEN 'Middle of the night' WHEN {hour} <= 12 THEN 'Morning'
    WHEN {hour} <= 15 THEN 'Afternoon' WHEN {hour} <= 19 THEN 'Dusk' ELSE 'Night' END"""


_SOURCE = (
    "CASE substr(o_orderpriority, 1, 1) "
    + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in SOURCES.items())
    + " END"
)

VIEWS = f"""WITH us AS (
  SELECT c_custkey AS user_id, c_name AS name, lower(c_name) AS username,
    CAST(floor(abs(c_acctbal) * 12) AS BIGINT) AS followers,
    CAST(floor(abs(c_acctbal) * 4) AS BIGINT) AS following,
    c_custkey % 5000 AS tweet_count, c_custkey % 7 = 0 AS verified,
    DATE '1980-01-01' + CAST((c_custkey * 37) % 5400 AS INTEGER) AS created_at
  FROM customer),
rtu AS (
  SELECT 1000000 + s_suppkey AS user_id,
    CAST(floor(abs(s_acctbal) * 20) AS BIGINT) AS followers,
    CAST(floor(abs(s_acctbal) * 5) AS BIGINT) AS following,
    DATE '1985-01-01' + CAST((s_suppkey * 53) % 3600 AS INTEGER) AS created_at
  FROM supplier),
rt AS (
  SELECT CAST(l_shipdate AS TIMESTAMP) AS timestamp, 1000000 + l_suppkey AS user_id,
    CAST(l_quantity AS BIGINT) AS like_count, l_orderkey AS ref, l_partkey AS part_id,
    l_linenumber AS line, l_extendedprice AS price
  FROM lineitem),
tw AS (
  SELECT o_orderkey AS tweet_id,
    CASE o_orderkey % 4 {" ".join(f"WHEN {i} THEN {quoted(t)}" for i, t in enumerate(TEXTS))} END
      AS text,
    o_custkey AS user_id,
    CAST(o_orderdate AS TIMESTAMP) + to_hours(o_orderkey % 24) AS timestamp,
    CASE WHEN o_orderkey % 10 = 0 AND o_orderkey > 0 THEN 'Quote Tweet' ELSE 'Original Tweet' END
      AS tweet_type,
    (o_orderkey * 31) % 450 AS like_count, o_orderkey % 5 AS reply_count,
    coalesce(lines, 0) AS retweet_count, o_orderkey % 3 AS quote_count,
    {_SOURCE} AS source,
    CASE WHEN o_orderkey % 6 = 0 THEN 'es' ELSE 'en' END AS lang,
    CASE WHEN o_orderkey % 5 = 0 THEN 'CA' ELSE 'US' END AS place_country,
    CASE WHEN o_custkey % 14 > 0 THEN CAST(o_custkey % 14 AS VARCHAR) END AS topic_id,
    CASE WHEN o_custkey % 14 > 0 THEN {sql_list(TOPIC_NAMES)}[o_custkey % 14] END AS topic,
    CASE WHEN o_orderkey % 10 = 0 AND o_orderkey > 0 THEN o_orderkey - 1 ELSE 0 END AS own_ref
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey)
    ON o_orderkey = l_orderkey),
twt AS (
  SELECT *, CAST(year(timestamp) AS INTEGER) AS year, monthname(timestamp) AS month,
    dayname(timestamp) AS day_of_week, {phase("hour(timestamp)")} AS day_phase,
    {device("source")} AS device, {group("topic")} AS topics_cleaned
  FROM tw),
rti AS (
  SELECT rt.*, rtu.followers, rtu.following,
    CAST(datesub('year', rtu.created_at, make_date(year(rt.timestamp), 12, 31)) AS INTEGER)
      AS seniority
  FROM rt JOIN rtu USING (user_id)),
arms AS (
  SELECT tweet_id, tweet_id AS ref FROM tw
  UNION SELECT tweet_id, own_ref FROM tw WHERE own_ref <> 0),
shared AS (
  SELECT arms.tweet_id, sum(followers) AS followers FROM arms JOIN rti ON rti.ref = arms.ref
  GROUP BY arms.tweet_id),
lexicon(word, valence) AS (VALUES {", ".join(f"({quoted(w)}, CAST({v} AS DOUBLE))" for w, v in LEXICON)}),
token_lists AS (
  SELECT tweet_id, [coalesce(nullif(trim(t, {_PUNCTUATION}), ''), t)
    FOR t IN regexp_split_to_array(lower(text), '\\s+')] AS tokens FROM tw),
places AS (SELECT tweet_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM token_lists),
hits AS (
  SELECT tweet_id, valence * CASE WHEN list_has_any(list_slice(tokens, greatest(i - 3, 1), i - 1),
      {sql_list(NEGATORS)}) AND i > 1 THEN -0.74 ELSE 1 END AS v
  FROM places JOIN lexicon ON tokens[i] = word),
scores AS (
  SELECT tweet_id, coalesce(s, 0.0) / sqrt(coalesce(s, 0.0) * coalesce(s, 0.0) + 15.0) AS compound
  FROM tw LEFT JOIN (SELECT tweet_id, sum(v) AS s FROM hits GROUP BY tweet_id) USING (tweet_id)),
proc AS (
  SELECT twt.*, us.followers, us.following, us.tweet_count, us.verified, us.created_at,
    us.followers + CASE WHEN topic IS NOT NULL AND retweet_count > 0
      THEN coalesce(shared.followers, 0) ELSE 0 END AS reach,
    CASE WHEN compound >= 0.05 THEN 'Positive' WHEN compound <= -0.05 THEN 'Negative'
      ELSE 'Neutral' END AS sentiment,
    {_HASHTAG} AS hashtags,
    CASE WHEN retweet_count = 0 THEN 0 ELSE 1 END AS popularity,
    CAST(datesub('year', us.created_at, make_date(year, 12, 31)) AS INTEGER) AS seniority
  FROM twt JOIN us USING (user_id) JOIN scores USING (tweet_id) LEFT JOIN shared USING (tweet_id)),
kept AS (
  SELECT * FROM proc WHERE followers < 100000 AND following < 30000 AND retweet_count < 1000
    AND like_count < 400 AND seniority < 17),
casc AS (
  SELECT *, row_number() OVER (PARTITION BY ref
      ORDER BY timestamp, user_id, part_id, line, like_count, price) - 1 AS pos,
    count(*) OVER (PARTITION BY ref) AS n
  FROM rti),
facts AS (
  SELECT ref, max(n) AS n, sum(followers) AS fs, count(followers) AS fn, sum(seniority) AS ss,
    count(seniority) AS sn,
    avg(followers) FILTER (WHERE n = 1 OR pos < n // 2) AS f1,
    avg(followers) FILTER (WHERE pos >= n // 2) AS f2,
    max(timestamp) FILTER (WHERE pos = n // 2) AS mid, max(timestamp) AS last
  FROM casc GROUP BY ref),
times AS (
  SELECT twt.*, facts.*,
    abs(epoch_us(twt.timestamp) - epoch_us(last)) AS t_all,
    CASE WHEN n = 1 THEN abs(epoch_us(twt.timestamp) - epoch_us(last))
      ELSE abs(epoch_us(twt.timestamp) - epoch_us(mid)) END AS t_one,
    CASE WHEN n = 1 THEN abs(epoch_us(twt.timestamp) - epoch_us(last))
      ELSE abs(epoch_us(mid) - epoch_us(last)) END AS t_two
  FROM twt JOIN facts ON tweet_id = ref),
texts AS (
  SELECT 'document' AS kind, doc_id AS id, CAST(0 AS BIGINT) AS part, text FROM documents
  UNION ALL SELECT 'turn', conv_id, CAST(turn AS BIGINT), text FROM conversations
  UNION ALL SELECT 'post', tweet_id, CAST(0 AS BIGINT), text FROM tw)
"""

_TWEET = f"""SELECT tweet_id, text, user_id, {stamp("timestamp")} AS timestamp, tweet_type,
  like_count, reply_count, retweet_count, quote_count, device, lang,
  coalesce(topic_id, '') AS topics_ids, coalesce(topic, '') AS topics,
  CASE WHEN own_ref = 0 THEN -1 ELSE own_ref END AS first_ref FROM twt"""
_USER = """SELECT user_id, name, username, followers, following, tweet_count, verified,
  strftime(created_at, '%Y-%m-%d 00:00:00') AS created_at FROM us"""
_EDGES = """SELECT o_custkey AS account_id, l_suppkey + 1000000 AS follower_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
_ALL_EDGES = f"""{_EDGES}
  UNION ALL SELECT l_suppkey + 1000000, l_partkey FROM lineitem
  UNION ALL SELECT l_suppkey + 1000000, l_orderkey FROM lineitem
  UNION ALL SELECT l_orderkey, l_suppkey + 1000000 FROM lineitem"""

_ENGAGEMENT = f"""count(*) AS count, {half_even("avg(retweet_count)")} AS retweets_mean,
  {half_even("avg(like_count)")} AS likes_mean,
  {half_even("nullif(count(*) FILTER (retweet_count > 0), 0) / count(*) * 100.0")}
    AS pct_with_retweets,
  {half_even("nullif(count(*) FILTER (like_count > 0), 0) / count(*) * 100.0")}
    AS pct_with_likes"""
_RATES = ["retweets_mean", "likes_mean", "pct_with_retweets", "pct_with_likes"]


def spine(categories) -> str:
    return ", ".join(f"({i}, {quoted(c)})" for i, c in enumerate(categories))


def profile(key: str, categories, source: str = "proc", measures=_ENGAGEMENT, rates=_RATES) -> str:
    columns = ", ".join(f"coalesce({rate}, -1) AS {rate}" for rate in rates)
    return f"""SELECT y.year, c.ord, c.{key}, coalesce(count, -1) AS count, {columns},
    coalesce(round(count * 100.0 / sum(count) OVER (PARTITION BY y.year), 6), -1) AS pct
  FROM (SELECT DISTINCT year FROM {source}) y
  CROSS JOIN (VALUES {spine(categories)}) c(ord, {key})
  LEFT JOIN (SELECT year, {key}, {measures} FROM {source} GROUP BY year, {key}) a
    ON a.year = y.year AND a.{key} = c.{key}"""


def profile_two(key: str) -> str:
    columns = ", ".join(f"coalesce({rate}, -1) AS {rate}" for rate in _RATES)
    return f"""SELECT year, {key}, topics_cleaned, count, {columns},
    round(count * 100.0 / sum(count) OVER (PARTITION BY year), 6) AS pct
  FROM (SELECT year, {key}, topics_cleaned, {_ENGAGEMENT} FROM proc
    WHERE topics_cleaned IS NOT NULL GROUP BY year, {key}, topics_cleaned)"""


_FOLLOWERS = half_even("coalesce(sum(fs) / sum(fn), 0.0)") + " AS followers_mean"
_AGE = half_even("coalesce(sum(ss) / sum(sn), 0.0)") + " AS account_age_mean"
_HALVES = f"""{half_even("coalesce(avg(f1), 0.0)")} AS first_half_followers_mean,
  {half_even("coalesce(avg(f2), 0.0)")} AS second_half_followers_mean"""
_PCT_TIME = half_even("avg(t_one) / nullif(avg(t_all), 0.0)")
_TIMES = f"""{half_even("coalesce(avg(t_one) / 86400000000.0, 0.0)")} AS half_time_days,
  {half_even("coalesce(avg(t_two) / 86400000000.0, 0.0)")} AS second_half_time_days,
  {half_even("coalesce(avg(t_all) / 86400000000.0, 0.0)")} AS total_time_days,
  {half_even(f"coalesce({_PCT_TIME} * 100.0, 0.0)")} AS pct_time_to_half"""


def cascade(measures: str) -> str:
    return f"""SELECT year, coalesce(topics_cleaned, 'none') AS topics_cleaned, {measures}
  FROM times GROUP BY ALL"""


def characteristics(above: int) -> str:
    names = [
        "followers_mean", "first_half_followers_mean", "second_half_followers_mean",
        "half_time_days", "second_half_time_days", "total_time_days", "pct_time_to_half",
        "account_age_mean",
    ]
    columns = ", ".join(f"coalesce({name}, 0.0) AS {name}" for name in names)
    return f"""SELECT CAST(a.year AS VARCHAR) AS year, a.topics_cleaned AS topic,
    CAST(list_position({sql_list(TOPICS)}, a.topics_cleaned) - 1 AS INTEGER) AS ord, {columns}
  FROM (SELECT DISTINCT year, topics_cleaned FROM twt WHERE topics_cleaned IS NOT NULL) a
  LEFT JOIN (SELECT year, topics_cleaned, {_FOLLOWERS}, {_AGE}, {_HALVES}, {_TIMES}
    FROM times WHERE retweet_count > {above} GROUP BY year, topics_cleaned) b
  ON a.year = b.year AND a.topics_cleaned = b.topics_cleaned"""


def box(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS variable, min(v) AS min, min(v) FILTER (v >= q1 - 1.5 * (q3 - q1))
    AS whisker_low, max(q1) AS q1, max(q2) AS median, max(q3) AS q3,
    max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)) AS whisker_high, max(v) AS max
  FROM (SELECT CAST({column} AS DOUBLE) AS v FROM {source}),
    (SELECT quantile_cont(CAST({column} AS DOUBLE), 0.25) AS q1,
      quantile_cont(CAST({column} AS DOUBLE), 0.5) AS q2,
      quantile_cont(CAST({column} AS DOUBLE), 0.75) AS q3 FROM {source})"""


def boxes() -> str:
    parts = [
        box(c, "proc")
        for c in ("like_count", "retweet_count", "followers", "following", "seniority")
    ] + [box("value", "events")]
    numbers = ["min", "whisker_low", "q1", "median", "q3", "whisker_high", "max"]
    rounded = ", ".join(f"round({n}, 6) AS {n}" for n in numbers)
    return f"SELECT variable, {rounded} FROM ({' UNION ALL '.join(parts)})"


def boxes_by_topic() -> str:
    columns = ["like_count", "retweet_count", "followers", "following", "seniority"]
    long = " UNION ALL ".join(
        f"SELECT topics_cleaned, '{c}' AS variable, CAST({c} AS DOUBLE) AS v FROM proc" for c in columns
    )
    return f""", long AS ({long}), box AS (
      SELECT topics_cleaned AS t, variable AS name, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2,
        quantile_cont(v, 0.75) AS q3 FROM long GROUP BY t, name)
    SELECT topics_cleaned, variable, round(min(v), 6) AS min,
      round(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low, round(max(q1), 6) AS q1,
      round(max(q2), 6) AS median, round(max(q3), 6) AS q3,
      round(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high, round(max(v), 6) AS max
    FROM long JOIN box ON variable = name AND topics_cleaned IS NOT DISTINCT FROM t
    GROUP BY topics_cleaned, variable"""


# At least 10 and at most 100 rows a request, five windows a day, 600 rows in all.
_PLAN = """, span AS (
  SELECT CAST(min(CAST(ts AS DATE)) - 4 AS DATE) AS a, CAST(max(CAST(ts AS DATE)) + 3 AS DATE) AS b FROM events),
daily AS (SELECT 600.0 / (date_diff('day', a, b) + 1) AS s FROM span),
quota AS (SELECT floor(least(greatest(s, 10), 100)) * ceil(s / 100) / 5.0 AS s FROM daily),
caps AS (SELECT CAST(floor(least(greatest(s, 10), 100)) * ceil(s / 100) AS INTEGER) AS cap FROM quota)"""

_RULED = f""", tokens AS (
  SELECT kind, id, part, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM (
    SELECT kind, id, part, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM texts)),
bared AS (
  SELECT *, CASE WHEN trim(w, {_PUNCTUATION}) = '' THEN w ELSE trim(w, {_PUNCTUATION}) END AS b FROM tokens),
lowered AS (SELECT *, lower(b) AS l, upper(b) = b AND lower(b) <> b AS loud FROM bared),
known(word, v) AS (VALUES ('the', 0.25), ('and', -0.5), ('to', 1.5), ('of', -1.25), ('la', 0.75), ('le', -0.5),
  ('de', 0.375), ('great', 3.1), ('good', 1.9), ('est', 0.5)),
boosts(word, s) AS (VALUES ('in', 0.293), ('is', -0.293), ('que', 0.293)),
whole AS (
  SELECT kind, id, part, bool_or(loud) AND NOT bool_and(loud) AS mixed,
    min(i) FILTER (l IN ('that', 'un')) AS turn FROM lowered GROUP BY kind, id, part),
described AS (
  SELECT kind, id, part, i, turn, CAST(v AS DOUBLE) AS v, s, CASE WHEN mixed AND loud THEN 0.733 ELSE 0.0 END AS stress,
    l IN ('for', 'not', 'et') OR suffix(l, 'n''t') AS denies
  FROM lowered JOIN whole USING (kind, id, part) LEFT JOIN known ON l = known.word LEFT JOIN boosts ON l = boosts.word),
boosted AS (
  SELECT *, v + sign(v) * stress AS u,
    CASE WHEN v IS NULL THEN coalesce(s + stress, 0.0) ELSE 0.0 END AS boost FROM described),
placed AS (
  SELECT *, lag(boost, 1, 0.0) OVER w + 0.95 * lag(boost, 2, 0.0) OVER w + 0.9 * lag(boost, 3, 0.0) OVER w AS boosts,
    lag(denies, 1, false) OVER w OR lag(denies, 2, false) OVER w OR lag(denies, 3, false) OVER w AS denied
  FROM boosted WINDOW w AS (PARTITION BY kind, id, part ORDER BY i)),
summed AS (
  SELECT kind, id, part, sum((u + sign(u) * boosts) * CASE WHEN denied THEN -0.74 ELSE 1.0 END
    * CASE WHEN turn IS NULL THEN 1.0 WHEN i < turn THEN 0.5 WHEN i > turn THEN 1.5 ELSE 0.0 END) AS s
  FROM placed GROUP BY kind, id, part),
marked AS (
  SELECT kind, id, part, coalesce(s, 0.0) AS s,
    least(len(text) - len(replace(text, '!', '')), 4) * 0.292 + CASE
      WHEN len(text) - len(replace(text, '?', '')) > 3 THEN 0.96
      WHEN len(text) - len(replace(text, '?', '')) > 1 THEN (len(text) - len(replace(text, '?', ''))) * 0.18
      ELSE 0.0 END AS e
  FROM texts LEFT JOIN summed USING (kind, id, part)),
total AS (SELECT *, coalesce(s + CASE WHEN abs(s) < 1e-9 THEN 0 ELSE sign(s) END * e, 0.0) AS t FROM marked)
SELECT kind, id, part, round(t / sqrt(t * t + 15.0), 9) AS compound FROM total"""

_SPEARMAN = """SELECT round(corr(rx, ry), 9) AS spearman FROM (
  SELECT rank() OVER (ORDER BY retweet_count) + (count(*) OVER (PARTITION BY retweet_count) - 1) / 2.0
      AS rx,
    rank() OVER (ORDER BY like_count) + (count(*) OVER (PARTITION BY like_count) - 1) / 2.0 AS ry
  FROM tw)"""
_KENDALL = """, cells AS (
  SELECT retweet_count AS x, like_count AS y, count(*) AS c FROM tw GROUP BY x, y),
pairs AS (
  SELECT sum(CAST(a.c * b.c AS DOUBLE) * sign(a.x - b.x) * sign(a.y - b.y)) / 2.0 AS s
  FROM cells a, cells b),
tx AS (SELECT sum(c * (c - 1) / 2.0) AS t FROM (SELECT sum(c) AS c FROM cells GROUP BY x)),
ty AS (SELECT sum(c * (c - 1) / 2.0) AS t FROM (SELECT sum(c) AS c FROM cells GROUP BY y)),
n AS (SELECT sum(c) * (sum(c) - 1) / 2.0 AS n0 FROM cells)
SELECT round(s / sqrt((n0 - tx.t) * (n0 - ty.t)), 9) AS kendall FROM pairs, tx, ty, n"""

ENCODED = ["day_phase", "day_of_week", "month", "year", "topics_cleaned", "sentiment", "verified",
           "hashtags"]


def value_text(column: str) -> str:
    """A value as it appears in the name of its 0/1 column."""
    if column in ("verified", "hashtags"):
        return f"CASE WHEN {column} THEN 'True' ELSE 'False' END"
    return f"coalesce(CAST({column} AS VARCHAR), 'None')"


def not_first(column: str, vocabulary: str) -> str:
    return f"{value_text(column)} <> (SELECT min({value_text(column)}) FROM {vocabulary})"


def ones(column: str) -> str:
    return f"""SELECT '{column}_' || {value_text(column)} AS feature, count(*) AS ones FROM proc
  WHERE {not_first(column, f"(SELECT * FROM proc WHERE {column} IS NOT NULL)")} GROUP BY 1"""


def rank_of(column: str) -> str:
    return f"""CAST((SELECT count(DISTINCT {column}) FROM proc q WHERE q.{column} < p.{column})
    AS INTEGER) AS {column}_enc"""


_LABELLED = ["day_phase", "day_of_week", "month", "year", "sentiment", "verified", "hashtags"]


def labels(rows: str = "proc", more: str = "") -> str:
    ranks = ", ".join(
        f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}_enc" for c in _LABELLED
    )
    return f"SELECT tweet_id, {ranks}{more} FROM {rows}"


_TRIALS = [
    "followers < 10000 AND following < 70000 AND retweet_count < 100 AND like_count < 500"
    " AND seniority < 17",
    "followers < 100000 AND following < 70000 AND retweet_count < 100 AND like_count < 500"
    " AND seniority < 17",
    "followers < 100000 AND following < 30000 AND retweet_count < 100 AND like_count < 400"
    " AND seniority < 17",
    "followers < 100000 AND following < 30000 AND retweet_count < 1000 AND like_count < 400"
    " AND seniority < 17",
    "followers < 5000 AND following < 5000 AND retweet_count < 1000 AND like_count < 400"
    " AND seniority < 17",
    "retweet_count < 5",
]

_NESTED = """SELECT CAST(tweet_id AS VARCHAR) AS tweet_id, text,
  CAST(tweet_id AS VARCHAR) AS conversation_id,
  CASE WHEN own_ref = 0 THEN 'none' ELSE '[{"id":' || own_ref || ',"type":"quoted"}]' END
    AS referenced_tweets,
  CASE WHEN topic IS NULL THEN 'none' ELSE '[{"domain":{"name":"' || topic || '"}}]' END
    AS context_annotations,
  CASE WHEN lang = 'en' THEN '{"country":"' || place_country || '"}' ELSE 'none' END AS geo,
  CASE WHEN contains(text, '#promo') THEN '{"hashtags":["promo"]}' ELSE 'none' END AS entities
  FROM tw"""

_KEYS = "ref AS ref_tweet_id, user_id, part_id, line"
_KIND = "CASE {} % 4 WHEN 0 THEN 'Quote Tweet' WHEN 1 THEN 'Reply Tweet' WHEN 2 THEN 'Retweet Tweet' END"


def keyword_profiles() -> str:
    parts = []
    for key, categories in (("month", MONTHS), ("sentiment", SENTIMENTS)):
        for rows, source in (("all", "proc"), ("keyword", "matched")):
            parts.append(
                f"SELECT *, '{rows}' AS rows FROM ("
                + profile(key, categories, source).replace(f"c.{key},", f"c.{key} AS category,")
                + ")"
            )
    return f", matched AS (SELECT * FROM proc WHERE {_MATCHED} = 1) " + " UNION ALL ".join(parts)


_BODY = {
    "scan_tweets": _TWEET,
    "scan_users": _USER,
    "scan_follows": _EDGES,
    "load_datasets": f"""SELECT tweet_id, user_id, followers, {stamp("timestamp")} AS timestamp
      FROM tw JOIN us USING (user_id)""",
    "scan_years": f"SELECT tweet_id, {stamp('timestamp')} AS timestamp, retweet_count FROM tw",
    "normalize_api": _TWEET,
    "normalize_users": _USER,
    "train_test_scan": """SELECT tweet_id, year, CASE WHEN year = (SELECT max(year) FROM twt)
      THEN 'test' ELSE 'train' END AS part FROM twt""",
    "sink_tweets": _TWEET.replace("text,", "text || ' ' || source AS text,", 1),
    "sink_users": f"""SELECT CAST(user_id AS VARCHAR) AS user_id, name, username,
      CAST(followers AS VARCHAR) AS followers, CAST(following AS VARCHAR) AS following,
      CAST(tweet_count AS VARCHAR) AS tweet_count, CAST(verified AS VARCHAR) AS verified,
      created_at FROM ({_USER})""",
    "sink_nested": _NESTED,
    "sink_follows": _ALL_EDGES,
    "sink_by_year": """SELECT 'posts' AS kind, year, count(*) AS rows, sum(followers) AS followers,
      sum(seniority) AS seniority FROM kept GROUP BY year
      UNION ALL SELECT 'info', CAST(year(timestamp) AS INTEGER) AS y, count(*), sum(followers),
      sum(seniority) FROM rti GROUP BY y""",
    "encoded_years": labels("kept", """, CAST(sentiment = 'Positive' AS INTEGER) AS positive,
      CAST(day_of_week = 'Monday' AS INTEGER) AS monday, CAST(verified AS INTEGER) AS verified_one"""),
    "unreadable_values": """SELECT c AS "column", count(*) AS rows,
      CAST(CASE WHEN c = 'followers' THEN sum(CAST(user_id % 7 = 0 AS INTEGER)) ELSE 0 END AS BIGINT) AS unreadable
      FROM us, (VALUES ('user_id'), ('name'), ('username'), ('followers'), ('following'), ('tweet_count'),
        ('verified'), ('created_at')) columns_(c) GROUP BY c""",
    "incremental_ingest": """SELECT 'post' AS kind, tweet_id AS id, retweet_count AS number FROM tw
      UNION ALL SELECT DISTINCT 'user', us.user_id, us.followers FROM us JOIN tw ON us.user_id = tw.user_id""",
    "append_state": """SELECT year, tweet_id, retweet_count FROM twt
      UNION ALL SELECT year, tweet_id, retweet_count + 1 FROM twt""",
    "extract_tweet": _TWEET,
    "extract_user": _USER,
    "collection_filter": """SELECT tweet_id, text FROM tw WHERE lang = 'en'
      AND place_country = 'US' AND reply_count <> 3""",
    "share_candidates": """SELECT tweet_id, retweet_count FROM tw
      WHERE topic IS NOT NULL AND retweet_count > 0""",
    "known_topic": """SELECT tweet_id, CAST(topic_id AS INTEGER) AS topics_ids,
      CASE WHEN retweet_count = 0 THEN 0 ELSE 1 END AS popularity
      FROM tw WHERE topic_id IS NOT NULL""",
    "outlier_filter": "SELECT tweet_id, followers, like_count, seniority FROM kept",
    "outlier_trials": "SELECT tweet_id, "
    + ", ".join(f"CAST({t} AS INTEGER) AS kept_{i}" for i, t in enumerate(_TRIALS))
    + " FROM proc",
    "retweets_with_ref": "SELECT user_id, part_id, line, like_count FROM rt WHERE line <> 2",
    "popular_filter": """SELECT tweet_id, year, retweet_count, above FROM twt,
      (VALUES (0), (10)) t(above) WHERE retweet_count > above""",
    "split_xy": "SELECT tweet_id, followers, popularity FROM kept",
    "year_slice": "SELECT tweet_id, year FROM twt WHERE year BETWEEN 1997 AND 1999",
    "analysis_projection": """SELECT text, year, day_phase, day_of_week, month, retweet_count,
      quote_count, like_count, reply_count, sentiment, hashtags,
      coalesce(topics_cleaned, 'none') AS topics_cleaned, reach FROM proc""",
    "tweets_join_users": f"""SELECT tweet_id, user_id, {stamp("timestamp")} AS timestamp,
      followers, following, tweet_count, verified FROM tw JOIN us USING (user_id)""",
    "retweets_join_retweeters": f"""SELECT {_KEYS}, like_count, followers, following, seniority,
      {stamp("timestamp")} AS timestamp FROM rti""",
    "reach_author": """SELECT tweet_id, coalesce(followers, 0) AS author_followers
      FROM tw LEFT JOIN us USING (user_id)""",
    "tweet_reach": "SELECT tweet_id, reach FROM proc",
    "cascade_join": f"""SELECT {_KEYS.replace("user_id", "rti.user_id")}, rti.like_count, followers,
      {stamp("tw.timestamp")} AS posted_at FROM rti JOIN tw ON tweet_id = ref""",
    "category_spine": """SELECT y.year, c.ord, c.topics_cleaned,
      coalesce(sum(a.count) OVER (PARTITION BY y.year), -1) AS total, coalesce(a.count, -1) AS count
      FROM (SELECT DISTINCT year FROM twt) y
      CROSS JOIN (VALUES (0, 'News'), (1, 'Unheard of'), (2, 'Brand'), (3, 'Book'))
        c(ord, topics_cleaned)
      LEFT JOIN (SELECT year, topics_cleaned, count(*) AS count FROM twt GROUP BY ALL) a
        ON a.year = y.year AND a.topics_cleaned = c.topics_cleaned""",
    "include_user_match": """SELECT tweet_id, coalesce(name, 'none') AS author
      FROM tw LEFT JOIN us USING (user_id)""",
    "profile_by_key": profile("day_of_week", WEEK_DAYS),
    "profile_by_day_phase": profile("day_phase", DAY_PHASES),
    "profile_by_month": profile("month", MONTHS),
    "profile_by_sentiment": profile("sentiment", SENTIMENTS),
    "profile_by_topic": profile("topics_cleaned", TOPICS),
    "profile_by_two_keys": profile_two("day_of_week"),
    "profile_by_day_phase_and_topic": profile_two("day_phase"),
    "profile_by_month_and_topic": profile_two("month"),
    "profile_by_hashtags_and_topic": profile_two("hashtags"),
    "profile_by_sentiment_and_topic": profile_two("sentiment"),
    "engagement_rate": f"""SELECT device, lang,
      {half_even("count(*) FILTER (retweet_count > 0) / count(*) * 100.0")} AS pct_with_retweets,
      {half_even("count(*) FILTER (like_count > 0) / count(*) * 100.0")} AS pct_with_likes
      FROM twt GROUP BY device, lang""",
    "reach_by_topic": profile(
        "topics_cleaned", TOPICS, "proc",
        f"count(*) AS count, {half_even('avg(reach)')} AS reach_mean", ["reach_mean"],
    ),
    "shared_vs_not": f"""SELECT CAST(y.year AS VARCHAR) AS year, c.ord, c.topics_cleaned,
      round(coalesce(m, -1), 4) AS followers_mean,
      round(coalesce(s, -1), 4) AS shared_followers_mean,
      round(coalesce(u, -1), 4) AS not_shared_followers_mean
      FROM (SELECT DISTINCT year FROM proc) y
      CROSS JOIN (VALUES {spine(TOPICS)}) c(ord, topics_cleaned)
      LEFT JOIN (SELECT year, topics_cleaned, avg(followers) AS m,
        avg(followers) FILTER (retweet_count > 0) AS s,
        avg(followers) FILTER (retweet_count = 0) AS u FROM proc GROUP BY ALL) a
      ON a.year = y.year AND a.topics_cleaned = c.topics_cleaned""",
    "data_characteristics": f"""SELECT
      (SELECT CAST(floor(avg(c)) AS BIGINT) FROM (SELECT count(*) AS c FROM proc GROUP BY day_of_week))
        AS mean_per_weekday,
      count(topics_cleaned) AS known_topic_rows,
      {half_even("count(topics_cleaned) / count(*) * 100.0")} AS pct_known_topic,
      count(*) FILTER (topics_cleaned IS NOT NULL AND retweet_count > 0)
        AS known_topic_shared_rows,
      {half_even("count(*) FILTER (retweet_count > 0) / count(*) * 100.0")} AS pct_with_retweets
      FROM proc""",
    "outlier_report": """SELECT round_even(k / r * 10000.0, 0) / 10000.0 * 100 AS pct_kept,
      round_even((1 - k / r) * 100 * 10000.0, 0) / 10000.0 AS pct_removed, k AS rows_kept,
      sk AS shared_kept,
      round_even((1 - sk / s) * 100 * 10000.0, 0) / 10000.0 AS pct_shared_removed
      FROM (SELECT count(*) AS r, count(*) FILTER (retweet_count > 0) AS s FROM proc),
        (SELECT count(*) AS k, count(*) FILTER (retweet_count > 0) AS sk FROM kept)""",
    "value_counts": """SELECT topics_cleaned, count(*) AS count,
      round(count(*) / (SELECT count(topics_cleaned) FROM proc), 9) AS share
      FROM proc WHERE topics_cleaned IS NOT NULL GROUP BY topics_cleaned""",
    "popular_share": """SELECT round(count(*) FILTER (retweet_count > 10) * 100.0
      / count(*) FILTER (retweet_count > 0), 6) AS pct_popular FROM tw""",
    "keyword_year_counts": f"SELECT year, sum({_MATCHED}) AS matches FROM twt GROUP BY year",
    "keyword_profiles": keyword_profiles(),
    "cascade_avg_followers": cascade(_FOLLOWERS),
    "cascade_avg_age": cascade(_AGE),
    "cascade_timing": cascade(_TIMES),
    "cascade_follower_halves": cascade(_HALVES),
    "dedup_keep_first": """SELECT user_id, event_id, event_type, value FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""",
    "retweeter_characteristics": characteristics(0),
    "popular_retweeter_characteristics": characteristics(10),
    "distinct_values": """SELECT 'year' AS kind,
        CAST(row_number() OVER (ORDER BY year) - 1 AS INTEGER) AS place,
        CAST(year AS VARCHAR) AS value FROM (SELECT DISTINCT year FROM twt)
      UNION ALL SELECT 'topic', CAST(row_number() OVER (ORDER BY topics_cleaned) - 1 AS INTEGER),
        topics_cleaned
      FROM (SELECT DISTINCT topics_cleaned FROM twt WHERE topics_cleaned IS NOT NULL)""",
    "boxplot_stats": boxes(),
    "boxplot_by_topic": boxes_by_topic(),
    "corr_pearson": "SELECT round(corr(retweet_count, like_count), 9) AS pearson FROM tw",
    "corr_spearman": _SPEARMAN,
    "corr_kendall": _KENDALL,
    "class_balance": """SELECT popularity, count(*) AS rows FROM kept WHERE topic IS NOT NULL
      GROUP BY popularity""",
    "cascade_position": f"SELECT {_KEYS}, {stamp('timestamp')} AS timestamp, pos, n FROM casc",
    "first_touch_half": f"""SELECT {_KEYS}, {stamp('timestamp')} AS timestamp, pos, n,
      (pos < n // 2 OR n = 1) AS in_first, pos >= n // 2 AS in_second FROM casc""",
    "share_of_total": """SELECT year, device, count(*) AS count,
      round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY year), 6) AS pct
      FROM twt GROUP BY year, device""",
    "stratified_sample": f"""{_PLAN} SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date,
      CAST(hour(ts) AS INTEGER) AS hour, cap FROM events, caps WHERE hour(ts) IN (0, 7, 13, 18, 21)
      QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), hour(ts) ORDER BY ts, event_id) <= cap""",
    "sampling_plan": f"""{_PLAN}, windows AS (
      SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day, cap FROM span, caps)
      SELECT CAST(day AS VARCHAR) AS date, h AS hour, cap, count(event_id) AS found,
        CAST(least(count(event_id), cap) AS BIGINT) AS taken
      FROM windows CROSS JOIN (VALUES (0), (7), (13), (18), (21)) hours(h)
      LEFT JOIN events ON CAST(ts AS DATE) = day AND hour(ts) = h GROUP BY day, h, cap""",
    "sort_by_time": f"""SELECT tweet_id, {stamp("timestamp")} AS timestamp FROM tw
      ORDER BY tw.timestamp, tweet_id""",
    "category_order": f"""SELECT y.year, c.ord, c.month,
      coalesce(sum(a.count) OVER (PARTITION BY y.year), 0) AS total, coalesce(a.count, 0) AS count
      FROM (SELECT DISTINCT year FROM twt) y CROSS JOIN (VALUES {spine(MONTHS)}) c(ord, month)
      LEFT JOIN (SELECT year, month, count(*) AS count FROM twt GROUP BY ALL) a
        ON a.year = y.year AND a.month = c.month ORDER BY y.year, c.ord""",
    "top_k_features": """SELECT p_retailprice AS score, CAST(p_partkey AS VARCHAR) AS feature
      FROM part ORDER BY score DESC, feature LIMIT 10""",
    "union_years": """SELECT user_id, like_count, retweet_count, -1 AS line FROM tw
      UNION ALL SELECT user_id, like_count, -1, line FROM rt""",
    "follow_edges": _ALL_EDGES,
    "device_class": "SELECT tweet_id, device FROM twt",
    "tweet_type": f"""SELECT o_orderkey AS tweet_id,
      CASE WHEN o_orderkey % 7 = 0 THEN 'Original Tweet' ELSE
        coalesce({_KIND.format("o_custkey")}, {_KIND.format("o_orderkey")}, '') END AS tweet_type
      FROM orders""",
    "topic_arrays": """SELECT tweet_id, coalesce(topic_id, '') AS topics_ids,
      coalesce(topic, '') AS topics FROM tw""",
    "ref_list": """SELECT tweet_id, CASE WHEN own_ref = 0 THEN 'none' ELSE own_ref || 'quoted' END
      AS refs FROM tw""",
    "ref_tweet_id": """SELECT part_id, line, user_id,
      CASE WHEN line = 2 THEN 0 ELSE ref END AS ref_tweet_id FROM rt""",
    "first_list_item": "SELECT tweet_id, coalesce(topic, lang) AS item FROM tw",
    "topic_group": f"""SELECT 'p ' || p_partkey AS key, coalesce({group("label")}, 'none') AS topic
      FROM (SELECT p_partkey, concat_ws(' ', p_type, p_brand, p_name) AS label FROM part)
      UNION ALL SELECT 't ' || tweet_id, coalesce(topics_cleaned, 'none') FROM twt""",
    "topic_defaults": """SELECT tweet_id, coalesce(CAST(topic_id AS INTEGER), -1) AS topics_ids,
      coalesce(topic, '') AS topics FROM tw""",
    "sentiment_class": """SELECT event_id, CASE WHEN value / 50 - 1 >= 0.05 THEN 'Positive'
      WHEN value / 50 - 1 <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS sentiment FROM events""",
    "sentiment_rules": _RULED,
    "sentiment_score": "SELECT tweet_id, round(compound, 9) AS compound FROM scores",
    "has_hashtag": f"SELECT kind, id, part, {_HASHTAG} AS hashtags FROM texts",
    "popularity": """SELECT tweet_id, CASE WHEN retweet_count = 0 THEN 0 ELSE 1 END AS popularity
      FROM tw""",
    "popularity_rt_quote": """SELECT tweet_id, CAST(retweet_count > 0 OR quote_count > 0 AS INTEGER)
      AS popularity FROM tw""",
    "day_phase": f"SELECT event_id, {phase('hour(ts)')} AS day_phase FROM events",
    "time_parts": "SELECT tweet_id, year, month, day_of_week FROM twt",
    "week_index": "SELECT tweet_id, year(timestamp) || '-' || strftime(timestamp, '%V') AS week_idx FROM tw",
    "seniority": "SELECT tweet_id, seniority FROM proc",
    "date_only": "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events",
    "flatten_newlines": """SELECT kind, id, part,
      md5(replace(replace(text, chr(10), ' '), chr(13), '')) AS digest FROM texts""",
    "keyword_match": f"SELECT kind, id, part, {_MATCHED} AS matched FROM texts",
    "days_between": f"""SELECT {_KEYS.replace("user_id", "rti.user_id")},
      round(abs(epoch_us(tw.timestamp) - epoch_us(rti.timestamp)) / 86400000000.0, 6) AS days
      FROM rti JOIN tw ON tweet_id = ref""",
    "round_half_even": f"""SELECT l_orderkey, l_partkey, l_suppkey,
      {half_even("l_quantity / 8")} AS rounded FROM lineitem""",
    "clean_nulls": """SELECT tweet_id, CAST(sentiment = 'Neutral' AS INTEGER) AS sentiment_Neutral,
      CAST(hashtags AS INTEGER) AS hashtags_True FROM proc
      UNION ALL SELECT -tweet_id - 1, 0, 0 FROM proc""",
    "one_hot": " UNION ALL ".join(ones(column) for column in ENCODED),
    "label_encode": labels(),
    "to_utc": """SELECT event_id, strftime(CASE WHEN user_id % 2 = 0 THEN ts - INTERVAL 2 HOUR
      ELSE ts END, '%Y-%m-%d %H:%M:%S') AS utc FROM events""",
}


def statements() -> dict[str, str]:
    from ripplecast.catalogue.oracle_learning import BODY as learning

    return {name: VIEWS + body for name, body in {**_BODY, **learning}.items()}
