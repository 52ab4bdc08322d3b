"""Row gates: predicates that keep or drop a hit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed, urls
from .base import found, found_any, strip, text, within
from .words import long_tokens


def is_homepage(url: Column) -> Column:
    return strip(urls.path(url)).isin("", "/")


def is_search_page(title: Column, url: Column) -> Column:
    return found_any(text(title), fixed.SEARCH_PAGE_TITLES) | found(text(url), r"/search\?")


def is_non_posting_title(title: Column) -> Column:
    return found_any(text(title), fixed.NON_POSTING_TITLES)


def is_non_posting_url(url: Column) -> Column:
    return found_any(text(url), fixed.NON_POSTING_URLS)


def is_portal_aggregate(url: Column) -> Column:
    out = F.lit(False)
    for marker in fixed.PORTAL_NON_POSTING_PATHS:
        out = out | F.contains(text(url), F.lit(marker))
    return out


def is_relevant(title: Column, query: Column, location: Column) -> Column:
    """The title holds a token of the query or place, or names a role."""
    tokens = long_tokens(F.concat_ws(" ", text(query), text(location)))
    low = F.lower(text(title))
    return (
        (F.size(tokens) == 0)
        | F.exists(tokens, lambda t: F.contains(low, t))
        | found(text(title), fixed.RELEVANCE_ROLE_WORDS)
    )


def feed_term_match(title: Column, summary: Column, terms: Column) -> Column:
    low = F.lower(F.concat_ws(" ", text(title), text(summary)))
    return F.exists(terms, lambda t: F.contains(low, t))


def is_junk_title(title: Column) -> Column:
    t = strip(text(title))
    low = F.lower(t)
    commas = F.length(low) - F.length(F.replace(low, F.lit(","), F.lit("")))
    return (
        found(low, fixed.JUNK_TITLE)
        | found(low, fixed.URL_IN_TITLE)
        | ((commas >= 3) & ~found(t, fixed.FRAGMENT_ROLE_WORDS))
    )


def _has_dead_segment(path: Column) -> Column:
    return F.exists(F.split(F.lower(path), "/"), lambda s: within(s, fixed.DEAD_PATH_SEGMENTS))


def _is_root(path: Column) -> Column:
    return path.rlike(r"^(/?|/([a-z]{2}|[a-z]{2}-[a-z]{2})/?)$")


def is_alive(url: Column, status: Column, final_url: Column, body: Column) -> Column:
    """Verdict on a crawled posting: false only on a hard sign that it is gone. Markers are sought in the whole body."""
    went, asked = urls.path(final_url), urls.path(url)
    dead_text = F.lower(text(body)).rlike("|".join(fixed.DEAD_BODY_MARKERS))
    dead = (
        status.isin(404, 410)
        | (_has_dead_segment(went) & ~_has_dead_segment(asked))
        | ((status < 400) & _is_root(went) & ~_is_root(asked))
        | ((status == 200) & dead_text)
    )
    return ~F.coalesce(dead, F.lit(False))


def scorer_eligible(quality: Column, description: Column) -> Column:
    return F.lower(text(quality)).isin("full", "partial") | (F.length(strip(text(description))) >= 60)
