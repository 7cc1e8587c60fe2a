"""Time expressions; every input is a UTC timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories in report order.
MONTHS = [
    "January", "February", "March", "April", "May", "June", "July", "August", "September",
    "October", "November", "December",
]
WEEK_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
DAY_PHASES = ["Morning", "Afternoon", "Dusk", "Night", "Middle of the night"]

# First hour after the end of each phase.
PHASE_ENDS = [
    (7, "Middle of the night"), (13, "Morning"), (16, "Afternoon"), (20, "Dusk"), (24, "Night"),
]

MICROS_PER_DAY = 86_400_000_000


def to_utc(stamp: Column) -> Column:
    """Timestamp text to timestamp; unreadable text becomes null."""
    return F.try_to_timestamp(stamp)


def day_phase(stamp: Column) -> Column:
    phase = F
    for end, name in PHASE_ENDS:
        phase = phase.when(F.hour(stamp) < end, F.lit(name))
    return phase


def month_name(stamp: Column) -> Column:
    return F.date_format(stamp, "MMMM")


def weekday_name(stamp: Column) -> Column:
    return F.date_format(stamp, "EEEE")


def week_index(stamp: Column) -> Column:
    """Calendar year and ISO week, which may belong to the year before."""
    week = F.lpad(F.weekofyear(stamp).cast("string"), 2, "0")
    return F.concat(F.year(stamp).cast("string"), F.lit("-"), week)


def date_only(stamp: Column) -> Column:
    return F.to_date(stamp)


def seniority(created: Column, year: Column) -> Column:
    """Whole years from account creation to the last day of the year, towards zero."""
    year_end = F.make_date(year, F.lit(12), F.lit(31))
    return F.timestamp_diff("YEAR", created, year_end).cast("int")


def micros_between(one: Column, other: Column) -> Column:
    return F.abs(F.timestamp_diff("MICROSECOND", one, other))


def days_between(one: Column, other: Column) -> Column:
    return micros_between(one, other) / F.lit(float(MICROS_PER_DAY))
