"""DuckDB SQL for the feature, selection and evaluation queries."""

from __future__ import annotations

NUMERIC = ["followers", "following", "tweet_count", "seniority"]
CODED = ["topics_cleaned", "sentiment", "hashtags", "verified", "day_phase", "day_of_week", "month"]

# rows of a model: outliers removed, topic known; training rows are all years but the last
_ROWS = """, rows_ AS (SELECT * FROM kept WHERE topic IS NOT NULL),
train AS (SELECT * FROM rows_ WHERE year < (SELECT max(year) FROM rows_))
"""


def _value(column: str) -> str:
    if column in ("verified", "hashtags"):
        return f"CASE WHEN {column} THEN 'True' ELSE 'False' END"
    return f"CAST({column} AS VARCHAR)"


def _scaled(column: str) -> str:
    return f"""round(({column} - (SELECT avg({column}) FROM train))
    / (SELECT stddev_pop({column}) FROM train), 6) AS {column}"""


def _long(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, popularity, CAST({c} AS DOUBLE) AS v FROM {source}"
        for c in NUMERIC
    )


def _coded() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}_' || {_value(c)} AS feature, popularity FROM train
        WHERE {_value(c)} <> (SELECT min({_value(c)}) FROM train)"""
        for c in CODED
    )


def _anova(source: str) -> str:
    return f"""SELECT feature, (between_ / (k - 1)) / (within_ / (n - k)) AS score FROM (
    SELECT g.feature, count(*) AS k, sum(g.n) AS n,
      sum(g.n * (g.m - t.m) * (g.m - t.m)) AS between_, sum(g.ss) AS within_
    FROM (SELECT feature, popularity, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss
        FROM ({_long(source)}) GROUP BY feature, popularity) g
      JOIN (SELECT feature, avg(v) AS m FROM ({_long(source)}) GROUP BY feature) t USING (feature)
    GROUP BY g.feature)"""


_CHI2 = f"""SELECT feature, round(sum((o - e) * (o - e) / e), 6) AS score FROM (
  SELECT f.feature, c.popularity, coalesce(o, 0) AS o, total * c.share AS e
  FROM (SELECT feature, count(*) AS total FROM ({_coded()}) GROUP BY feature) f
  CROSS JOIN (SELECT popularity, count(*) / (SELECT count(*) FROM train) AS share FROM train
    GROUP BY popularity) c
  LEFT JOIN (SELECT feature, popularity, count(*) AS o FROM ({_coded()}) GROUP BY ALL) g
    ON g.feature = f.feature AND g.popularity = c.popularity)
GROUP BY feature ORDER BY score DESC, feature LIMIT 10"""


def _votes() -> str:
    scores = {
        "spread": f"SELECT feature, stddev_pop(v) AS score FROM ({_long('rows_')}) GROUP BY feature",
        "mean": f"SELECT feature, avg(v) AS score FROM ({_long('rows_')}) GROUP BY feature",
        "largest": f"SELECT feature, max(v) AS score FROM ({_long('rows_')}) GROUP BY feature",
        "anova": _anova("rows_"),
    }
    casts = " UNION ALL ".join(
        f"""SELECT feature, row_number() OVER (ORDER BY score DESC, feature) <= 3 AS kept_
        FROM ({score})"""
        for score in scores.values()
    )
    return f"""SELECT feature, count(*) FILTER (NOT kept_) AS discards,
      count(*) FILTER (NOT kept_) < 2 AS keep FROM ({casts}) GROUP BY feature"""


_GUESS = "CASE WHEN followers % 3 = 0 AND like_count > 200 THEN 0 ELSE 1 END"
_REPORT = f""", guessed AS (SELECT popularity AS t, {_GUESS} AS p FROM rows_),
labels_ AS (SELECT DISTINCT t AS c FROM guessed UNION SELECT DISTINCT p FROM guessed),
per AS (SELECT CAST(c AS VARCHAR) AS class,
  (SELECT count(*) FROM guessed WHERE t = c AND p = c) AS hits,
  (SELECT count(*) FROM guessed WHERE t = c) AS support,
  (SELECT count(*) FROM guessed WHERE p = c) AS g FROM labels_),
pr AS (SELECT class, hits, support, coalesce(hits / nullif(g, 0), 0.0) AS precision,
  coalesce(hits / nullif(support, 0), 0.0) AS recall FROM per),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM pr),
lines AS (
  SELECT class, precision, recall, f1, support FROM f
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
    sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f
  UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support),
    sum(hits) / sum(support), sum(support) FROM f)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
  CAST(support AS BIGINT) AS support FROM lines"""

_FOLD = """SELECT tweet_id, CAST(CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
    ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold
  FROM (SELECT tweet_id, row_number() OVER (ORDER BY timestamp, tweet_id) - 1 AS i,
    count(*) OVER () AS n FROM rows_)"""

_SCALED = ", ".join(_scaled(c) for c in NUMERIC)

BODY = {
    name: _ROWS + body
    for name, body in {
        "standardize": f"SELECT tweet_id, {_SCALED} FROM rows_",
        "chi2_top10": _CHI2,
        "anova_top3": f"""SELECT feature, round(score, 6) AS score FROM ({_anova("train")})
          ORDER BY score DESC, feature LIMIT 3""",
        "feature_vote": _votes(),
        "assemble_features": f"""SELECT tweet_id, popularity, {_SCALED},
          CAST(hashtags AS DOUBLE) AS hashtags_True, CAST(verified AS DOUBLE) AS verified_True,
          CAST(sentiment = 'Neutral' AS DOUBLE) AS sentiment_Neutral,
          CAST(sentiment = 'Positive' AS DOUBLE) AS sentiment_Positive FROM rows_""",
        "kfold_assign": _FOLD,
        "classification_report": _REPORT,
    }.items()
}
