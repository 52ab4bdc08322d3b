"""Fields of a rendered posting page, read from its non-empty trimmed lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed, urls
from .base import capture, found, let, replace, strip, text, title_case, within
from .extract import clean_portal_title, title_from_slug


def plain(line: Column) -> Column:
    """Line without heading marks and emphasis."""
    return strip(F.trim(F.ltrim(line, F.lit("#")), F.lit("* ")))


def lines_of(page: Column) -> Column:
    """Non-empty trimmed lines, without the three preamble lines when there are any."""
    all_lines = F.filter(F.transform(F.split(text(page), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip), lambda s: s != "")

    def body(lines: Column) -> Column:
        first = F.lower(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))
        rest = F.slice(lines, F.lit(4), F.greatest(F.size(lines), F.lit(1)))
        return F.when(F.startswith(first, F.lit("title:")), rest).otherwise(lines)

    return let(all_lines, body)


def top_of(lines: Column, n: int = 60) -> Column:
    return F.array_join(F.slice(lines, 1, n), "\n")


def is_expired(page: Column) -> Column:
    """The page turned into a search listing."""
    head = F.lower(F.substring(text(page), 1, 1200))
    title = F.lower(capture(F.substring(text(page), 1, 600), r"(?m)^title:\s*(.+)$"))
    by_title = (F.contains(title, F.lit("vacanc")) & title.rlike(r"\d")) | title.rlike(r"jobs in .+ - \d+")
    return (
        F.contains(head, F.lit("job vacancies in"))
        | head.rlike(r"jobs in [a-z ,\-]+ - \d[\d,]*\s*(job )?vacanc")
        | F.coalesce(by_title, F.lit(False))
    )


def title(lines: Column, url: Column) -> Column:
    def named(line: Column, name: Column) -> Column:
        skip = (
            line.rlike(r"^(!|\*|- |#)")
            | (F.contains(line, F.lit("naukri.com")) & ~F.contains(line, F.lit("]")))
            | (name == "")
            | (F.length(name) > 120)
            | found(name, fixed.DESCRIPTION_HEADING)
            | found(name, fixed.STOP_HEADING)
        )
        return F.when(~skip, clean_portal_title(name)).otherwise("")

    def candidate(line: Column) -> Column:
        linked = capture(line, r"^\[([^\]]+)\]\([^)]+\)$", 1, False)
        return let(plain(F.coalesce(linked, line)), lambda name: named(line, name))

    names = F.filter(F.transform(F.slice(lines, 1, 12), candidate), lambda s: s != "")
    return F.coalesce(F.get(names, F.lit(0)), clean_portal_title(title_from_slug(url)))


def is_usable_title(c: Column) -> Column:
    t = F.lower(text(c))
    return ~(
        (F.length(t) < 2)
        | F.startswith(t, F.lit("#"))
        | F.contains(t, F.lit("job description"))
        | F.contains(t, F.lit("job details"))
        | found(t, fixed.TITLE_ARTIFACT)
        | found(t, fixed.DESCRIPTION_HEADING)
        | found(t, fixed.STOP_HEADING)
    )


def company(lines: Column, url: Column) -> Column:
    def name(line: Column) -> Column:
        pattern = r"^\[([^\]]+)\]\((https?://[^)\s]+)\)$"
        label = strip(F.trim(capture(line, pattern, 1, False), F.lit("*")))
        href = capture(line, pattern, 2, False)
        ok = F.contains(href, F.lit("naukri.com")) & ~href.rlike(r"naukri\.com/(jobs|job-listings)")
        return F.when(ok, F.substring(label, 1, 80)).otherwise("")

    names = F.filter(F.transform(F.slice(lines, 1, 20), name), lambda s: s != "")
    return F.coalesce(F.get(names, F.lit(0)), urls.company_from_slug(url))


def location(lines: Column, url: Column) -> Column:
    def place(line: Column) -> Column:
        return let(F.filter(F.transform(F.split(line, ","), strip), lambda s: s != ""), of_parts)

    def of_parts(parts: Column) -> Column:
        known = F.size(
            F.filter(parts, lambda t: within(F.replace(F.lower(t), F.lit("-"), F.lit(" ")), fixed.CITY_SLUGS))
        )
        shaped = F.forall(parts, lambda t: t.rlike(r"^[A-Za-z][A-Za-z &.\-]{0,30}$"))
        ok = (
            F.size(parts).between(1, 8)
            & shaped
            & (known > 0)
            & ((known >= F.size(parts)) | (F.size(parts) <= 3))
        )
        named = F.transform(parts, lambda t: title_case(F.replace(t, F.lit("-"), F.lit(" "))))
        return F.when(ok, F.array_join(named, ", ")).otherwise("")

    places = F.filter(F.transform(F.slice(lines, 1, 25), place), lambda s: s != "")
    return F.coalesce(F.get(places, F.lit(0)), urls.locations_from_slug(url))


def _first_index(lines: Column, pattern: str) -> Column:
    """1-based place of the first heading line, NULL when none."""
    flags = F.transform(lines, lambda s: found(plain(s), pattern))
    return F.nullif(F.array_position(flags, F.lit(True)).cast("int"), F.lit(0))


def _section(lines: Column, start: Column, stops) -> Column:
    """Lines after ``start`` up to the first for which ``stops`` holds."""
    rest = F.slice(lines, F.coalesce(start, F.lit(0)) + 1, F.greatest(F.size(lines), F.lit(1)))

    def cut(rest: Column) -> Column:
        stop = F.array_position(F.transform(rest, stops), F.lit(True)).cast("int")
        return let(stop, lambda at: F.when(at > 0, F.slice(rest, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(rest))

    return let(rest, cut)


def description(lines: Column) -> Column:
    """Text between the description heading and the next heading, whole."""
    return let(_first_index(lines, fixed.DESCRIPTION_HEADING), lambda start: _description_at(lines, start))


def _description_at(lines: Column, start: Column) -> Column:
    body = _section(lines, start, lambda s: found(plain(s), fixed.STOP_HEADING))
    kept = F.filter(body, lambda s: ~F.startswith(s, F.lit("![")))
    flat = replace(strip(F.array_join(kept, " ")), r"\s+", " ", False)
    return F.when(start.isNull(), "").otherwise(flat)


def salary(top: Column) -> Column:
    def number(pattern: str, group: int) -> Column:
        return F.replace(capture(top, pattern, group), F.lit(","), F.lit(""))

    def unit(pattern: str) -> Column:
        u = capture(top, pattern, 3)
        return F.when(F.lower(u) == "lpa", F.upper(u)).otherwise(u)

    ranged = F.concat(
        F.lit("₹"), number(fixed.PAGE_SALARY_UNIT, 1), F.lit("-"), number(fixed.PAGE_SALARY_UNIT, 2),
        F.lit(" "), unit(fixed.PAGE_SALARY_UNIT),
    )
    plain_one = F.concat(F.lit("₹"), number(fixed.PAGE_SALARY_PLAIN, 1))
    return (
        F.when(found(top, r"not\s+disclosed"), "Not Disclosed")
        .when(found(top, fixed.PAGE_SALARY_UNIT), ranged)
        .when(
            found(top, fixed.PAGE_SALARY_PLAIN),
            F.concat_ws(" ", plain_one, unit(fixed.PAGE_SALARY_PLAIN)),
        )
        .otherwise("")
    )


def experience(top: Column) -> Column:
    ranged = F.concat(
        capture(top, fixed.PAGE_EXPERIENCE_RANGE, 1), F.lit("-"),
        capture(top, fixed.PAGE_EXPERIENCE_RANGE, 2), F.lit(" Years"),
    )
    single = F.concat(capture(top, fixed.PAGE_EXPERIENCE_SINGLE, 1), F.lit(" Years"))
    return F.when(found(top, r"\bfresher\b"), "Fresher").otherwise(F.coalesce(ranged, single, F.lit("")))


def key_skills(lines: Column) -> Column:
    return let(_first_index(lines, fixed.SKILLS_HEADING), lambda start: _key_skills_at(lines, start))


def _key_skills_at(lines: Column, start: Column) -> Column:
    body = _section(
        lines, start, lambda s: found(plain(s), fixed.SKILLS_STOP) | F.startswith(s, F.lit("["))
    )
    kept = F.filter(body, lambda s: ~s.rlike(r"^(\*|-|!\[)"))
    names = F.filter(F.transform(kept, plain), lambda s: s != "")
    return F.when(start.isNull(), "").otherwise(F.array_join(names, ", "))


def listed(top: Column) -> Column:
    first = F.coalesce(capture(top, fixed.PAGE_LISTED_RELATIVE), capture(top, fixed.PAGE_LISTED_DATE))
    return text(strip(F.trim(strip(first), F.lit(":"))))


def apply_url(page: Column) -> Column:
    return F.coalesce(capture(page, fixed.PAGE_APPLY_LINK), capture(page, fixed.PAGE_APPLY_URL), F.lit(""))


def rendered_fields(page: Column, url: Column) -> Column:
    """All fields of one rendered page as a struct; NULL for an expired or empty page."""
    def of_lines(lines: Column) -> Column:
        return let(top_of(lines), lambda top: F.when(F.size(lines) > 0, _fields(page, url, lines, top)))

    return F.when(~is_expired(page), let(lines_of(page), of_lines))


def _fields(page: Column, url: Column, lines: Column, top: Column) -> Column:
    return F.struct(
        title(lines, url).alias("title"),
        company(lines, url).alias("company"),
        location(lines, url).alias("location"),
        description(lines).alias("description"),
        salary(top).alias("salary"),
        experience(top).alias("experience"),
        key_skills(lines).alias("keyskills"),
        listed(top).alias("listed"),
        apply_url(page).alias("apply_url"),
    )
