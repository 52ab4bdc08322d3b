"""Cities, regions and the remote flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .base import capture, found, let, lookup, quoted, split, strip, text, words

#: Phrase forms that contain an earlier listed form of the same city can never
#: be the first form found, so testing them changes nothing.
_SHADOWED = {
    key
    for i, (key, city) in enumerate(fixed.CITY_SYNONYMS)
    for earlier, same in fixed.CITY_SYNONYMS[:i]
    if same == city and earlier in key.replace("-", " ").split(" ")
}


def _one_word(key: str) -> str:
    return key.replace(" ", "0").replace("-", "1")


def _named_city(c: Column, exclude: list[str] = ()) -> Column:
    """Earliest named city; a specific one beats India and Remote. NULL when none is named.

    The text is cut into words once and reduced, by one hash intersection, to
    the place words in order of appearance. Order is worked out on those few
    alone: per city its first listed form counts, then the earliest city wins.
    """
    keys = [(i, k, v) for i, (k, v) in enumerate(fixed.CITY_SYNONYMS) if k not in exclude and k not in _SHADOWED]
    low = F.lower(text(c))
    for _, key, _city in keys:
        if _one_word(key) != key:
            low = F.regexp_replace(low, rf"(?<![a-z0-9]){key}(?![a-z0-9])", _one_word(key))
    named = F.array_intersect(F.split(low, "[^a-z0-9]+"), words([_one_word(k) for _, k, _ in keys]))
    table = F.expr(
        "map("
        + ", ".join(
            f"{quoted(_one_word(k))}, named_struct('form', {i}, 'generic', {int(v in fixed.GENERIC_PLACES)}, 'city', {quoted(v)})"
            for i, k, v in keys
        )
        + ")"
    )

    def earliest(found: Column) -> Column:
        known = F.transform(found, lambda w, at: F.struct(at.alias("at"), F.try_element_at(table, w).alias("k")))

        def first_forms(all_known: Column) -> Column:
            return F.filter(
                all_known,
                lambda x: ~F.exists(
                    all_known, lambda y: (y["k"]["city"] == x["k"]["city"]) & (y["k"]["form"] < x["k"]["form"])
                ),
            )

        order = F.transform(let(known, first_forms), lambda x: F.struct(x["k"]["generic"], x["at"], x["k"]["city"].alias("city")))
        return F.array_min(order)["city"]

    return F.get(F.transform(F.filter(F.array(named), lambda w: F.size(w) > 0), earliest), F.lit(0))


def city(location: Column) -> Column:
    """Canonical city of a location field, else its first capitalized word or two, else ''."""
    known = _named_city(strip(text(location)))
    word = capture(strip(text(location)), r"\b([A-Z][a-zA-Z]{2,}(?: [A-Z][a-zA-Z]+)?)\b", 1, False)
    usable = ~F.lower(word).isin("india", "remote") & (F.length(word) <= 25)
    return F.coalesce(known, F.when(usable, word), F.lit(""))


def city_in_text(c: Column) -> Column:
    """Canonical city named in free text, '' when none."""
    return F.coalesce(_named_city(c, fixed.FREE_TEXT_EXCLUDED), F.lit(""))


def region_of(city_name: Column) -> Column:
    regions: dict[str, str] = {}
    for region, cities in fixed.REGION_CITIES:
        for name in cities:
            regions.setdefault(name, region)
    return F.coalesce(lookup(regions, F.lower(city_name)), F.lit(""))


def region(location: Column) -> Column:
    return region_of(city(location))


def is_remote(location: Column, workplace: Column, description: Column) -> Column:
    named = F.concat_ws(" ", text(location), text(workplace))
    return found(named, fixed.REMOTE_WORDS) | F.contains(
        F.lower(F.substring(text(description), 1, 400)), F.lit("remote")
    )


def preference_parts(location: Column) -> Column:
    return split(text(location), fixed.LOCATION_SEPARATOR)


def preference_cities(location: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(preference_parts(location), city), lambda x: x != ""))


def preference_regions(location: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(preference_parts(location), region), lambda x: x != ""))


def source_location(location: Column) -> Column:
    """One place to ask a source for: the whole country when every part is a known one."""
    parts = F.filter(F.transform(preference_parts(location), strip), lambda p: p != "")
    covered = F.forall(parts, lambda p: (city(p) != "") & (region(p) != ""))
    return (
        F.when(F.size(parts) <= 1, strip(text(location)))
        .when(covered, "India")
        .otherwise(F.get(parts, F.lit(0)))
    )
