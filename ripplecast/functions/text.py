"""Text, list-literal and label expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device names and the source fragments that reveal them, tried in this order.
DEVICES = [
    ("iPhone", ["iPhone", "iOS"]),
    ("Android", ["Android"]),
    ("Mobile device", ["Mobile"]),
    ("Mac", ["Mac"]),
    ("Windows", ["Windows"]),
    ("Bot", ["Bot"]),
    ("Web", ["Web"]),
    ("Instagram", ["Instagram"]),
    ("Blackberry", ["Blackberry"]),
    ("iPad", ["iPad"]),
    ("Foursquare", ["Foursquare"]),
]

# Post kinds by reference type.
ORIGINAL = "Original Tweet"
REFERENCE_KINDS = {
    "quoted": "Quote Tweet",
    "replied_to": "Reply Tweet",
    "retweeted": "Retweet Tweet",
}

# Fixed value: a hashtag needs at least one Latin letter.
HASHTAG = r"(?U)\B#\w*[a-zA-Z]+\w*"

# Keywords of the pandemic case study, as published.
COVID_KEYWORDS = [
    "Coronavirus", "Corona", "CDC", "Ncov", "Wuhan", "Outbreak", "China", "Koronavirus",
    "Wuhancoronavirus", "Wuhanlockdown", "N95", "Kungflu", "Epidemic", "Sinophobia",
    "Covid-19", "Corona virus", "Covid19", "Sars-cov-2", "COVID–19", "COVD", "Pandemic",
    "Coronapocalypse", "CancelEverything", "Coronials", "SocialDistancing", "Panic buying",
    "DuringMy14DayQuarantine", "Panic shopping", "InMyQuarantineSurvivalKit", "chinese virus",
    "stayhomechallenge", "DontBeASpreader", "lockdown", "shelteringinplace", "staysafestayhome",
    "trumppandemic", "flatten the curve", "GetMePPE", "covidiot", "epitwitter", "Pandemie",
    "PneumoniaWuhan", "CoronaVirusInfo", "V2019N", "CDCemergency", "CDCgov", "WHO", "HHSGov",
    "NIAIDNews",
]
CASE_KEPT = ["WHO"]


def first_match(value: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Name of the first rule with a fragment contained in the value."""
    named = F
    for name, fragments in rules:
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | value.contains(fragment)
        named = named.when(hit, F.lit(name))
    return named.otherwise(F.lit(default))


def device_class(source: Column) -> Column:
    return first_match(source, DEVICES, "")


def tweet_type(refs: Column) -> Column:
    """Kind of post from its references; the last recognised reference decides."""
    kinds = F.create_map(*[F.lit(part) for pair in REFERENCE_KINDS.items() for part in pair])
    known = F.filter(refs, lambda ref: ref["type"].isin(*REFERENCE_KINDS))
    last = F.try_element_at(known, F.lit(-1))["type"]
    return F.when(refs.isNull(), F.lit(ORIGINAL)).otherwise(
        F.coalesce(F.try_element_at(kinds, last), F.lit(""))
    )


def topic_ids_of(annotations: Column) -> Column:
    return F.transform(annotations, lambda note: note["domain"]["id"])


def topic_names_of(annotations: Column) -> Column:
    return F.transform(annotations, lambda note: note["domain"]["name"])


def ref_list(refs: Column) -> Column:
    """Keep id and type of every reference; a missing list stays missing."""
    return F.transform(
        refs, lambda ref: F.struct(ref["id"].cast("long").alias("id"), ref["type"].alias("type"))
    )


def ref_list_text(refs: Column) -> Column:
    """The bracketed text form in which reference lists are stored in CSV."""
    items = F.transform(
        refs,
        lambda ref: F.concat(
            F.lit("ReferencedTweet(id: "), ref["id"].cast("string"),
            F.lit(", type: "), ref["type"], F.lit(" \n"),
        ),
    )
    return F.when(
        refs.isNotNull(), F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    )


def parse_ref_list(stored: Column) -> Column:
    """Inverse of :func:`ref_list_text`."""
    found = F.regexp_extract_all(stored, F.lit(r"id: (\d+), type: \w+"), F.lit(1))
    kinds = F.regexp_extract_all(stored, F.lit(r"id: \d+, type: (\w+)"), F.lit(1))
    pairs = F.transform(
        F.arrays_zip(found.alias("id"), kinds.alias("type")),
        lambda pair: F.struct(
            pair["id"].try_cast("long").alias("id"), pair["type"].alias("type")
        ),
    )
    return F.when(stored.isNotNull(), pairs)


def ref_tweet_id(stored: Column) -> Column:
    """First referenced id in the stored text form, null when there is none."""
    return F.nullif(F.regexp_extract(stored, r"id: (\d+)", 1), F.lit("")).try_cast("long")


_QUOTED = r"""'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+\""""


def list_text(items: Column) -> Column:
    """Quoted list-literal text of a list of strings.

    An item with an apostrophe stands in double quotes; backslashes, and quotes of the kind
    around the item, are escaped by a backslash.
    """

    def literal(item: Column) -> Column:
        mark = F.when(F.contains(item, F.lit("'")), F.lit('"')).otherwise(F.lit("'"))
        safe = F.replace(item, F.lit("\\"), F.lit("\\\\"))
        return F.concat(mark, F.replace(safe, mark, F.concat(F.lit("\\"), mark)), mark)

    quoted = F.transform(items, literal)
    return F.when(items.isNotNull(), F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")))


def parse_list(stored: Column) -> Column:
    """Inverse of :func:`list_text`, for either kind of quotes; null for text that is no list."""
    quoted = F.regexp_extract_all(stored, F.lit(_QUOTED), F.lit(0))
    items = F.transform(
        quoted,
        lambda item: F.regexp_replace(
            F.substring(item, F.lit(2), F.char_length(item) - 2), r"\\(.)", "$1"
        ),
    )
    return F.when(stored.rlike(rf"^\s*\[\s*(?:(?:{_QUOTED})\s*(?:,\s*|(?=\])))*+\]\s*$"), items)


def first_list_item(stored: Column) -> Column:
    return F.try_element_at(parse_list(stored), F.lit(1))


def has_hashtag(text: Column) -> Column:
    return text.rlike(HASHTAG)


def flatten_newlines(text: Column) -> Column:
    return F.translate(text, "\n\r", " ")


def prepared_keywords(keywords: Sequence[str]) -> list[str]:
    return [word if word in CASE_KEPT else word.lower() for word in keywords]


def keyword_match(text: Column, keywords: Sequence[str], mode: str = "token") -> Column:
    """1 where a keyword occurs, else 0.

    ``token``: a lower-cased token between single spaces equals a keyword.
    ``phrase``: the keyword, several words or punctuation allowed, stands between
    characters that are neither letters nor digits, whatever the case.
    """
    if mode == "token":
        wanted = F.array(*[F.lit(word) for word in prepared_keywords(keywords)])
        hit = F.arrays_overlap(F.split(F.lower(text), " "), wanted)
    elif mode == "phrase":
        escaped = "|".join(r"\Q" + word + r"\E" for word in keywords)
        hit = text.rlike(r"(?iu)(?<![\p{L}\p{N}])(?:" + escaped + r")(?![\p{L}\p{N}])")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.coalesce(hit.cast("int"), F.lit(0))


def popularity(retweets: Column) -> Column:
    return F.when(retweets == 0, F.lit(0)).otherwise(F.lit(1))


def popularity_rt_quote(retweets: Column, quotes: Column) -> Column:
    return F.when((retweets > 0) | (quotes > 0), F.lit(1)).otherwise(F.lit(0))
