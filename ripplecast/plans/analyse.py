"""Report tables over the processed posts and re-shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecast.functions.numeric import round_half_even
from ripplecast.functions.sentiment import SENTIMENTS
from ripplecast.functions.text import COVID_KEYWORDS, keyword_match
from ripplecast.functions.timeparts import DAY_PHASES, MONTHS, WEEK_DAYS
from ripplecast.functions.topics import TOPICS
from ripplecast.operators import cascades, filters, profiles, stats
from ripplecast.session import cut_lineage

CATEGORIES = {
    "day_phase": DAY_PHASES,
    "day_of_week": WEEK_DAYS,
    "month": MONTHS,
    "sentiment": SENTIMENTS,
    "topics_cleaned": TOPICS,
}
BY_TOPIC = ["day_phase", "day_of_week", "month", "hashtags", "sentiment"]
CASE_YEARS = [2019, 2020, 2021]
CASE_YEAR = 2020


def tweet_reports(posts: DataFrame, only_case_study: bool = False) -> dict[str, DataFrame]:
    """Every table of the post analysis.

    All profiles are cells of one grouped pass over ``posts``, the three correlations share the
    distinct pairs of another, and what follows from a profile reads its cells.
    """
    reports = {"characteristics": profiles.data_characteristics(posts)}
    reports |= stats.correlations(posts, "retweet_count", "like_count")
    if not only_case_study:
        measures = {**profiles.engagement(), "reach_mean": round_half_even(F.avg("reach"))}
        singles, pairs = [[key] for key in CATEGORIES], [[key, "topics_cleaned"] for key in BY_TOPIC]
        cells = profiles.grouped_cells(posts, [*singles, *pairs], measures)
        names = list(profiles.engagement())
        for key, categories in CATEGORIES.items():
            spread = profiles.cells_on_spine(cells[(key,)], key, categories, names, "count")
            profile = cut_lineage(profiles.with_share(spread))
            reports[f"by_{key}"] = profile
            for name, found in stats.correlations(profile, "retweets_mean", "likes_mean").items():
                reports[f"by_{key}_{name}"] = found
        for key in BY_TOPIC:
            both = cells[key, "topics_cleaned"].where(F.col(key).isNotNull() & F.col("topics_cleaned").isNotNull())
            reports[f"by_{key}_and_topic"] = profiles.share_of_total(both.drop("reach_mean"))
        reach = profiles.cells_on_spine(
            cells[("topics_cleaned",)], "topics_cleaned", TOPICS, ["count", "reach_mean"], "count"
        )
        reports["reach_by_topic"] = profiles.with_share(reach)
    case_rows = posts.where(posts["year"].isin(CASE_YEARS))
    reports["case_counts"] = profiles.keyword_year_counts(case_rows)
    return reports | case_reports(filters.year_slice(posts, CASE_YEAR))


def case_reports(posts: DataFrame, keys: Sequence[str] = ("month", "sentiment")) -> dict[str, DataFrame]:
    """Profiles of all rows beside those of the rows with a keyword, from one pass."""
    matched = posts.withColumn("_matched", keyword_match(F.col("text"), COVID_KEYWORDS) == 1)
    sets = [one for key in keys for one in ([key], [key, "_matched"])]
    cells, names = profiles.grouped_cells(matched, sets, profiles.engagement()), list(profiles.engagement())
    reports = {}
    for key in keys:
        kinds = {"all": cells[(key,)], "keyword": cells[key, "_matched"].where("_matched")}
        made = None
        for name, own in kinds.items():
            spread = profiles.cells_on_spine(own, key, CATEGORIES[key], names, "count")
            rows = profiles.with_share(spread).withColumn("rows", F.lit(name))
            made = rows if made is None else made.unionByName(rows)
        reports[f"case_by_{key}"] = made
    return reports


def retweet_reports(
    posts: DataFrame, info: DataFrame, order: Sequence[str] = cascades.ORDER
) -> dict[str, DataFrame]:
    """Every table of the re-share analysis."""
    return {
        "shared_vs_not": profiles.shared_vs_not(posts, TOPICS),
        "cascades": cascades.retweeter_characteristics(posts, info, 0, order),
        "popular_cascades": cascades.retweeter_characteristics(posts, info, 10, order),
        "popular_share": filters.popular_share(posts),
    }
