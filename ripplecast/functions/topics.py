"""Topic groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ripplecast.functions.text import first_match

# Topic groups and the fragments that reveal them, tried in this order.
TOPIC_RULES = [
    ("Brand", ["Brand", "Product"]),
    ("Person", ["Person"]),
    ("Sport", ["Sport", "Athlete", "Coach", "Hockey", "Football", "NFL"]),
    ("TV and Movies",
     ["TV", "Movie", "Award", "Actor", "Fictional Character", "Entertainment"]),
    ("Music", ["Music", "Musician", "Concert", "Song", "Radio"]),
    ("Book", ["Book"]),
    ("Interest and Hobbies", ["Hobbies"]),
    ("Video Game", ["Video Game", "Esports", "eSport"]),
    ("Political", ["Political", "Politicians"]),
    ("Holiday", ["Holiday"]),
    ("News", ["News"]),
    ("Entities", ["Entities"]),
]

# Topic groups in report order.
TOPICS = [
    "Brand", "Holiday", "Person", "Interest and Hobbies", "Sport", "TV and Movies", "Other",
    "Video Game", "Entities", "Political", "Music", "Book", "News",
]


def topic_group(topic: Column) -> Column:
    return F.when(topic.isNotNull(), first_match(topic, TOPIC_RULES, "Other"))


def topic_id_or_default(topic_id: Column) -> Column:
    return F.coalesce(topic_id.try_cast("int"), F.lit(-1))


def topic_or_default(topic: Column) -> Column:
    return F.coalesce(topic, F.lit(""))
