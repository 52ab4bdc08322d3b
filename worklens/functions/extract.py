"""Titles, companies and locations out of search-hit text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed, urls
from .base import capture, filled, found, let, replace, split, strip, text, title_case, within
from .places import city_in_text

def _first_segment(title: Column) -> Column:
    first = strip(F.get(split(title, r"\s*[-–|]\s*"), F.lit(0)))
    return F.coalesce(filled(first), strip(title))


def clean_board_title(title: Column) -> Column:
    return _first_segment(replace(replace(text(title), fixed.BOARD_SUFFIX), fixed.NOISE_SUFFIX))


def clean_web_title(title: Column) -> Column:
    """As the board form, with "X is hiring" cut off the front and a place off the end."""
    t = replace(replace(text(title), fixed.BOARD_SUFFIX), fixed.NOISE_SUFFIX)
    role = strip(replace(t, fixed.HIRING_LEAD))
    role = strip(replace(role, fixed.PLACE_AT_END, "", False))
    return _first_segment(F.when(found(t, fixed.HIRING_LEAD), role).otherwise(t))


def clean_portal_title(title: Column) -> Column:
    out = text(title)
    for pattern, ignore_case, trim in fixed.PORTAL_TITLE_REWRITES:
        out = replace(out, pattern, "", ignore_case)
        if trim:
            out = strip(out)
    return F.trim(out, F.lit(" ,-–"))


def title_from_slug(url: Column) -> Column:
    posting = capture(url, fixed.PORTAL_SLUG_TITLE, 1, False)
    listing = capture(url, r"naukri\.com/([^/]+?)(?:-jobs|$)", 1, False)

    def spoken(slug: Column) -> Column:
        return strip(title_case(F.replace(slug, F.lit("-"), F.lit(" "))))

    return F.coalesce(spoken(posting), strip(replace(spoken(listing), r"\s+In\s+\w.*", "", False)), F.lit(""))


def _guarded(snippet: Column, pattern: str, needs: str) -> Column:
    """Trimmed first capture. The patterns rescan long runs of letters from every
    start, so they run only where the part they cannot do without occurs."""
    return strip(F.when(found(snippet, needs), capture(snippet, pattern)))


def _name_in(snippet: Column, index: int) -> Column:
    name = _guarded(snippet, fixed.COMPANY_BY_TEXT[index], fixed.COMPANY_BY_TEXT_NEEDS[index])
    return let(name, _usable_name)


def _usable_name(name: Column) -> Column:
    head = F.lower(F.get(split(name, r"\s+", False), F.lit(0)))
    return F.when((F.length(name) >= 3) & ~within(head, fixed.STOP_WORDS), name)


def _phrase_in(snippet: Column, index: int) -> Column:
    return _guarded(snippet, fixed.LOCATION_BY_TEXT[index], fixed.LOCATION_BY_TEXT_NEEDS[index])


def company_from_text(url: Column, snippet: Column, title: Column) -> Column:
    s = text(snippet)
    return F.coalesce(
        *[_name_in(s, i) for i in range(len(fixed.COMPANY_BY_TEXT))],
        strip(capture(text(title), fixed.COMPANY_BY_TITLE)),
        urls.company_from_domain(url),
    )


def portal_company(url: Column, snippet: Column, title: Column, cleaned: Column) -> Column:
    s = text(snippet)
    return F.coalesce(
        *[_name_in(s, i) for i in range(len(fixed.COMPANY_BY_TEXT))],
        strip(capture(text(title), fixed.COMPANY_BY_TITLE)),
        strip(
            title_case(
                F.replace(
                    capture(url, fixed.PORTAL_SLUG_COMPANY, 1, False),
                    F.lit("-"),
                    F.lit(" "),
                )
            )
        ),
        strip(capture(cleaned, fixed.PORTAL_TITLE_COMPANY, 1, False)),
        F.lit("Naukri"),
    )


def site_company(body: Column, parts: Column) -> Column:
    """Company of a site-restricted hit: body text, else the second of three title parts."""
    second = F.when(F.size(parts) >= 3, strip(F.get(parts, F.lit(1))))
    head = F.lower(F.get(split(second, r"\s+", False), F.lit(0)))
    usable = (F.length(second) >= 3) & ~within(head, fixed.STOP_WORDS)
    named = let(
        strip(capture(text(body), fixed.SITE_COMPANY, 2)), lambda n: F.when(F.length(n) <= 50, _usable_name(n))
    )
    return F.coalesce(named, F.when(usable, second), F.lit("Unknown"))


def location_from_text(everything: Column, snippet: Column) -> Column:
    """A known city anywhere wins; a phrase counts only when it names a known city itself."""
    s = text(snippet)
    trusted = lambda phrase: F.when((F.length(phrase) < 40) & (city_in_text(phrase) != ""), phrase)
    tries = [let(city_in_text(everything), filled)]
    tries += [let(_phrase_in(s, i), trusted) for i in range(len(fixed.LOCATION_BY_TEXT))]
    return F.coalesce(*tries, F.lit("Remote / Unspecified"))


def portal_location(snippet: Column, asked: Column) -> Column:
    s = text(snippet)
    short = lambda phrase: F.when(F.length(phrase) < 30, phrase)
    tries = [let(_phrase_in(s, i), short) for i in range(len(fixed.LOCATION_BY_TEXT))]
    return F.coalesce(*tries, filled(asked), F.lit("India"))
