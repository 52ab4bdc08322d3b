"""Hosts, paths and canonical forms of URLs.

Hosts and paths are taken by pattern: landed URLs are loose, and the strict
parser rejects many of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .base import capture, filled, let, replace, strip, text, title_case, within

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(strip(text(url)), _AUTHORITY, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(strip(text(url)), _PATH, 1)


def query_value(url: Column, key: str) -> Column:
    """First decoded non-empty value of a query parameter."""
    value = capture(url, rf"\?(?:[^#]*&)?{key}=([^&#]+)", 1, False)
    return F.try_url_decode(value)


def company_from_host(url: Column) -> Column:
    """Company named by the posting's own host, '' when only a platform is named."""
    labels = F.filter(F.split(replace(host(url), r"^www\d*\.", "", False), r"\."), lambda x: x != "")
    last = F.size(labels) - 1

    def meaningful(x: Column) -> Column:
        return ~within(x, fixed.TLD_LABELS + fixed.GENERIC_HOST_LABELS) & ~x.rlike(r"^wd\d+$")

    named = F.filter(labels, lambda x, i: (i < last) & meaningful(x) & ~within(x, fixed.PLATFORM_LABELS))
    rest = F.filter(labels, meaningful)
    only_platforms = F.forall(rest, lambda x: within(x, fixed.PLATFORM_LABELS))
    return (
        F.when(F.size(named) > 0, title_case(F.get(named, F.lit(0))))
        .when(only_platforms, "")
        .otherwise(title_case(F.try_element_at(rest, F.lit(-1))))
    )


def company_from_domain(url: Column) -> Column:
    """First host label that is not a generic one."""
    labels = F.split(replace(host(url), r"^www\d*\.", "", False), r"\.")
    kept = F.filter(labels, lambda x: ~within(x, fixed.SKIP_DOMAIN_LABELS))
    return title_case(F.when(F.size(kept) > 0, F.get(kept, F.lit(0))).otherwise(F.get(labels, F.lit(0))))


def canonical_job_url(url: Column) -> Column:
    number = capture(strip(text(url)), r"/jobs/view/(?:[^/?#]*?)(\d{7,})(?:[?#]|$)", 1, False)
    return F.coalesce(
        F.concat(F.lit("https://www.linkedin.com/jobs/view/"), number), strip(text(url))
    )


def stable_apply_url(url: Column, apply_url: Column) -> Column:
    """Apply link; one that only lives inside a session is replaced by the posting page."""
    candidate = strip(F.coalesce(filled(apply_url), text(url)))
    number = capture(candidate, r"/job-apply/(\d+)", 1, False)
    return F.when(number.isNull(), candidate).otherwise(
        F.coalesce(filled(url), F.concat(F.lit("https://www.linkedin.com/jobs/view/"), number))
    )


def resolve_tracking_url(url: Column, domain: str = "in.indeed.com") -> Column:
    key = query_value(url, "jk")
    tracked = F.contains(url, F.lit("rc/clk")) | F.contains(url, F.lit("pagead/clk"))
    return F.when(
        tracked & key.isNotNull(), F.concat(F.lit(f"https://{domain}/viewjob?jk="), key)
    ).otherwise(url)


def unwrap_redirect(href: Column) -> Column:
    full = F.when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).otherwise(href)
    target = F.try_url_decode(query_value(full, "uddg"))
    return F.when(
        F.contains(host(full), F.lit("duckduckgo.com")) & target.isNotNull(), target
    ).otherwise(full)


def profile_handle(url: Column) -> Column:
    return capture(url, r"linkedin\.com/in/([^/]+)", 1, False)


def is_portal_posting(url: Column) -> Column:
    return F.contains(text(url), F.lit("/job-listings-"))


# Portal URL slugs: job-listings-<title>-<company>-<city>-...-<years>-<id>


def slug_parts(url: Column) -> Column:
    slug = capture(url, r"/job-listings-(.+?)-(\d+)$", 1, False)
    parts = F.coalesce(F.split(slug, "-"), F.array().cast("array<string>"))
    return F.filter(
        parts,
        lambda p: ~p.rlike(r"^\d+(?:\.\d+)?$")
        & ~F.lower(p).isin("to", "years", "year", "yrs", "yr", "fresher", "exp"),
    )


def company_from_slug(url: Column) -> Column:
    """Last words before the trailing cities; generic company words pull in the one before."""

    def company(parts: Column) -> Column:
        named = F.transform(parts, lambda p, i: F.when(~within(p, fixed.CITY_SLUGS), i + 1).otherwise(0))
        return let(F.coalesce(F.array_max(named), F.lit(0)), lambda last: ending(parts, last))

    def ending(parts: Column, last: Column) -> Column:
        at = lambda back: F.get(parts, (last - 1 - back).cast("int"))
        generic = lambda back: F.coalesce(within(at(back), fixed.GENERIC_COMPANY_WORDS), F.lit(False))
        take = (
            F.when(generic(0) & (last >= 2) & generic(1) & (last >= 3), 3)
            .when(generic(0) & (last >= 2), 2)
            .otherwise(1)
        )
        words = let(take, lambda n: F.slice(parts, F.greatest(last - n + 1, F.lit(1)), n))
        return F.when(last == 0, "").otherwise(title_case(F.array_join(words, " ")))

    return let(slug_parts(url), company)


def locations_from_slug(url: Column) -> Column:
    cities = F.filter(slug_parts(url), lambda p: within(p, fixed.CITY_SLUGS))
    return F.array_join(F.transform(cities, lambda p: title_case(F.replace(p, F.lit("-"), F.lit(" ")))), ", ")


def redact(c: Column) -> Column:
    """Hide userinfo and secret query values."""
    out = F.regexp_replace(text(c), fixed.URL_USERINFO, "$1***@")
    out = F.regexp_replace(out, fixed.BARE_USERINFO, "***@")
    return F.regexp_replace(out, "(?i)" + fixed.SECRET_QUERY_VALUE, "$1***")


def suffixes(domain: Column) -> Column:
    """The domain and every suffix of it that starts after a dot."""
    labels = F.split(domain, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def plain_domain(domain: Column) -> Column:
    return replace(F.lower(domain), r"^www\.", "", False)


