"""Small column helpers shared by every family of functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\r\x0b\x0c"
DAY = 86400


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body reads it.

    The optimizer inlines a projected column that has one textual use, also
    when that use sits in a lambda or in a conditional branch that runs many
    times per row. Binding it as a lambda variable keeps it to one evaluation.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim whitespace of every kind, not blanks alone.

    One parameter only: a second one would receive the index inside ``transform``.
    """
    return F.trim(c, F.lit(SPACES))


def text(c: Column) -> Column:
    """Missing text is the empty string."""
    return F.coalesce(c, F.lit(""))


def filled(c: Column) -> Column:
    """The value, or NULL when it is empty: the step of a fallback chain."""
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[filled(c) for c in cols], F.lit(""))


def found(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    return c.rlike(("(?i)" if ignore_case else "") + pattern)


def found_any(c: Column, patterns: list[str], ignore_case: bool = True) -> Column:
    """One alternation, so the text is scanned by a single compiled pattern."""
    return found(c, "|".join(f"(?:{p})" for p in patterns), ignore_case)


def capture(c: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    """Captured group of the first match, NULL without a match or when empty."""
    return let(F.regexp_extract(c, ("(?i)" if ignore_case else "") + pattern, group), filled)


def replace(c: Column, pattern: str, by: str = "", ignore_case: bool = True) -> Column:
    return F.regexp_replace(c, ("(?i)" if ignore_case else "") + pattern, by)


def split(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.split(c, ("(?i)" if ignore_case else "") + pattern)


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words(values: list[str]) -> Column:
    """Constant array, written as one expression so that building the plan stays cheap."""
    return F.expr("array(" + ", ".join(quoted(v) for v in values) + ")")


def within(c: Column, values: list[str]) -> Column:
    return F.array_contains(words(values), c)


def lookup(values: dict[str, str], key: Column) -> Column:
    """Constant map lookup, NULL for an unknown key."""
    pairs = ", ".join(quoted(x) for kv in values.items() for x in kv)
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def title_case(c: Column) -> Column:
    """Upper-case each first letter of a run of letters, lower-case the rest."""
    spaced = F.regexp_replace(F.lower(c), r"(?<!\p{L})(\p{L})", "\u0001$1")
    upper = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))

    def joined(parts: Column) -> Column:
        rest = F.slice(parts, F.lit(2), F.size(parts))
        return F.concat(F.element_at(parts, 1), F.array_join(F.transform(rest, upper), ""))

    return let(F.split(spaced, "\u0001"), joined)


def java_escape(value: str) -> str:
    return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", value)


def tenths(x: Column) -> Column:
    """Round a non-negative double to one decimal, half to even on its exact binary value.

    ``20 * x`` is formed as ``16x + 4x`` together with its rounding error, so
    the comparison with the midpoint between two tenths is exact.
    """
    a, b = x * 16.0, x * 4.0
    s = a + b
    bb = s - a
    err = (a - (s - bb)) + (b - bb)
    k = F.floor(x * 10.0).cast("double")
    above = s - (k * 2.0 + 1.0)
    up = (above > 0) | ((above == 0) & (err > 0)) | ((above == 0) & (err == 0) & (k % 2 == 1))
    return F.when(up, k + 1.0).otherwise(k) / 10.0
