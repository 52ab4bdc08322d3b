"""Posting times: relative text, absolute dates, window labels, snippet age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .base import DAY, capture, filled, found, let, lookup, replace, strip, text

UNIT_DAYS = {"second": 0, "minute": 0, "hour": 0, "day": 1, "week": 7, "month": 30, "year": 365}
AGO = r"(\d+)\s*(second|minute|hour|day|week|month|year)s?\s+ago"


def relative_epoch(raw: Column, as_of: Column) -> Column:
    """Epoch of "3 days ago", "just now", "today", "yesterday"; NULL otherwise.

    Seconds, minutes and hours count as zero days.
    """
    number = capture(raw, AGO, 1).try_cast("bigint")
    days = lookup({k: str(v) for k, v in UNIT_DAYS.items()}, F.lower(capture(raw, AGO, 2))).cast("bigint")
    now = as_of.cast("bigint")
    return (
        F.when(found(raw, AGO), now - number * days * DAY)
        .when(found(raw, r"\bjust now\b"), now)
        .when(found(raw, r"\btoday\b"), now - 3600)
        .when(found(raw, r"\byesterday\b"), now - DAY)
    )


#: Shape of a date text -> datetime pattern. Testing the shape first keeps the
#: parser off its exception path on the many rows that hold no date.
DATE_SHAPES = [
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}[+-]\d\d:\d\d$", "yyyy-M-d'T'H:m:sXXX"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}[+-]\d{4}$", "yyyy-M-d'T'H:m:sXX"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}[+-]\d\d:\d\d$", "yyyy-M-d'T'H:m:s.SSSSSSXXX"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
]


def absolute_epoch(raw: Column) -> Column:
    """Epoch of an absolute date text (UTC when it names no zone), else NULL."""
    cleaned = F.replace(
        replace(strip(raw), r"^(?:posted|published|updated|date)\s*:?\s*"), F.lit("Z"), F.lit("+00:00")
    )
    return F.coalesce(*[F.when(cleaned.rlike(shape), utc_seconds(cleaned, pattern)) for shape, pattern in DATE_SHAPES])


def utc_seconds(c: Column, pattern: str) -> Column:
    """Epoch of a text; one without a zone is UTC, whatever the session's zone is."""
    if "X" not in pattern:
        c, pattern = F.concat(c, F.lit(" +00:00")), pattern + " XXX"
    return F.unix_seconds(F.try_to_timestamp(c, F.lit(pattern)))


def listed_epoch(
    known: Column, listed: Column, epoch: Column, listed_date: Column, as_of: Column
) -> Column:
    """Posting time: the known value, else the first of the three raw fields."""
    raw = strip(text(F.coalesce(filled(listed), filled(listed_date))))
    parsed = F.coalesce(relative_epoch(raw, as_of), absolute_epoch(raw))
    from_number = F.when(filled(listed).isNull() & (epoch != 0), epoch.cast("bigint"))
    return F.coalesce(known.cast("bigint"), from_number, parsed)


def iso_older_than(iso: Column, days: int, as_of: Column) -> Column:
    """Whether an ISO date lies more than ``days`` back; unreadable dates pass."""
    cleaned = F.replace(text(iso), F.lit("Z"), F.lit("+00:00"))
    readable = cleaned.rlike(
        r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?([+-]\d\d:\d\d)?)?$"
    )
    zoned = F.when(cleaned.rlike(r":.*[+-]\d\d:\d\d$"), cleaned).when(
        F.contains(cleaned, F.lit(":")), F.concat(cleaned, F.lit("+00:00"))
    ).otherwise(F.concat(cleaned, F.lit("T00:00:00+00:00")))
    at = F.when(readable, F.unix_micros(zoned.try_cast("timestamp")))
    return F.coalesce((as_of.cast("double") - at / 1e6) / DAY > days, F.lit(False))


SNIPPET_UNITS = [
    (r"(\d+)\s+(?:year|yr)s?\s+ago", 365),
    (r"(\d+)\s+months?\s+ago", 30),
    (r"(\d+)\s+weeks?\s+ago", 7),
    (r"(\d+)\s+days?\s+ago", 1),
]
SNIPPET_LEAD = r"(?:posted|published|updated)\s+"


def snippet_older_than(snippet: Column, days: int, as_of: Column) -> Column:
    """Whether a snippet states an age above ``days``.

    The first number of each unit counts, bare and after a "posted" word; then
    one "posted: jan 5, 2024" date, in the current year when it names none.
    """
    return let(F.lower(text(snippet)), lambda low: _stated_age_above(low, days, as_of))


def _stated_age_above(low: Column, days: int, as_of: Column) -> Column:
    stated = [
        capture(low, lead + pattern, 1, False).try_cast("bigint") * unit > days
        for lead in ("", SNIPPET_LEAD)
        for pattern, unit in SNIPPET_UNITS
    ]
    months = "|".join(fixed.MONTHS + fixed.MONTH_NAMES)
    dated = r"(?:posted|published|updated|date)\s*:\s*(" + months + r")\s+(\d{1,2})(?:,?\s*(\d{4}))?"
    month = F.array_position(
        F.array(*[F.lit(m) for m in fixed.MONTHS]), F.substring(capture(low, dated, 1, False), 1, 3)
    ).cast("int")
    year = F.coalesce(
        capture(low, dated, 3, False).try_cast("int"),
        F.year(F.timestamp_seconds(as_of)),
    )
    day = capture(low, dated, 2, False).try_cast("int")
    # An out-of-range day rolls over into the next month, as calendars do here.
    posted = F.date_add(F.make_date(year, month, F.lit(1)), day - 1)
    age = (as_of.cast("double") - F.unix_date(posted).cast("double") * DAY) / DAY
    def any_of(flags: list[Column]) -> Column:
        out = F.lit(False)
        for flag in flags:
            out = out | F.coalesce(flag, F.lit(False))
        return out

    # One scan each tells whether the patterns have anything to find.
    spoken = F.when(F.contains(low, F.lit("ago")), any_of(stated)).otherwise(F.lit(False))
    return spoken | F.when(low.rlike(dated), any_of([age > days])).otherwise(F.lit(False))


def is_relative(raw: Column) -> Column:
    return F.coalesce(found(raw, r"\d+\s+(second|minute|hour|day|week|month|year)s?\s+ago"), F.lit(False))


# Window labels of the sources for a number of days.


def time_limit(days: Column) -> Column:
    return (
        F.when(F.coalesce(days, F.lit(0)) == 0, "").when(days <= 1, "d").when(days <= 7, "w").otherwise("m")
    )


def date_posted_flag(days: Column) -> Column:
    return F.when(days <= 7, "week").when(days <= 30, "month").otherwise("any")


def age_flag(days: Column) -> Column:
    d = F.greatest(F.lit(1), days)
    return F.when(d >= 14, 14).when(d >= 7, 7).when(d >= 3, 3).otherwise(1)


def window_label(days: Column) -> Column:
    return (
        F.when(F.coalesce(days, F.lit(0)) == 0, "week")
        .when(days <= 1, "today")
        .when(days <= 3, "3days")
        .when(days <= 7, "week")
        .otherwise("month")
    )


def window_epoch(label: Column, days: Column, as_of: Column) -> Column:
    """Oldest possible posting time under a source window, NULL when the window is looser than asked."""
    width = lookup({k: str(v) for k, v in fixed.WINDOW_DAYS.items()}, label).cast("bigint")
    asked = F.when(F.coalesce(days, F.lit(0)) == 0, 7).otherwise(days)
    return F.when(width <= asked, as_of.cast("bigint") - width * DAY + 120)
