"""Tokens, match keys, skills and seniority levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .base import let, quoted, replace, strip, text, within, words

TOKEN = r"[a-z0-9+#.]+"


def tokenize(c: Column) -> Column:
    """Distinct lower-case tokens, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit(TOKEN), F.lit(0)))


def blank_terms(c: Column) -> Column:
    """Distinct lower-case words between blanks."""
    return F.array_distinct(F.filter(F.split(F.lower(text(c)), r"\s+"), lambda t: t != ""))


def significant_terms(c: Column) -> Column:
    """Terms that are no stop word and longer than one letter; all terms when none is."""
    terms = blank_terms(c)
    kept = F.filter(terms, lambda t: (F.length(t) > 1) & ~within(t, fixed.STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(terms)


def long_tokens(c: Column) -> Column:
    """Tokens of three characters or more that end at a word boundary."""
    found = F.regexp_extract_all(F.lower(text(c)), F.lit(TOKEN + r"\b"), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= 3)


def match_key(c: Column) -> Column:
    """Comparison form of a title or company: rank suffixes and punctuation removed."""
    low = strip(F.lower(text(c)))
    bare = replace(low, r"\b(ii|iii|iv|sr?|jr)\b", "", False)
    return strip(replace(replace(bare, r"[^a-z0-9\s]", "", False), r"\s+", " ", False))


def valid_query(c: Column) -> Column:
    """At least two words that say something."""
    terms = F.filter(F.split(F.lower(text(c)), r"\s+"), lambda t: (F.length(t) > 1) & ~within(t, fixed.STOP_WORDS))
    return F.size(terms) >= 2


# Skill matching. Two boundary rules exist and differ at the edges:
#
# * word rule, of scoring: both ends lie on a regex word boundary;
# * edge rule, of must-have skills: no [a-z0-9] touches either end.


def _pattern(form: Column, edges: bool) -> Column:
    head, tail = ("(?<![a-z0-9])", "(?![a-z0-9])") if edges else (r"\b", r"\b")
    return F.concat(F.lit(head + r"\Q"), form, F.lit(r"\E" + tail))


def needles(skills: Column, variants: bool) -> Column:
    """Per skill: the skill and its written forms, each with the pattern of its rule.

    Worked out once per profile. ``variants`` selects the edge rule and the
    synonyms that belong to it.
    """

    def one(s: Column) -> Column:
        forms = skill_variants(s) if variants else F.array(s)
        pairs = F.transform(forms, lambda v: F.struct(v.alias("plain"), _pattern(v, variants).alias("pattern")))
        return F.struct(s.alias("skill"), pairs.alias("forms"))

    return F.transform(skills, one)


def hits(body: Column, skill_needles: Column) -> Column:
    """Skills found in ``body``, in their given order.

    A form's pattern runs only where the form occurs as a plain substring, so
    most (text, skill) pairs cost one substring search and no regex.
    """

    def search(low: Column) -> Column:
        found = F.filter(
            skill_needles,
            lambda n: F.exists(n["forms"], lambda v: F.contains(low, v["plain"]) & F.rlike(low, v["pattern"])),
        )
        return F.transform(found, lambda n: n["skill"])

    return let(F.lower(text(body)), search)


def skill_variants(skill: Column) -> Column:
    key = F.lower(strip(skill))
    pairs = ", ".join(
        f"{quoted(name)}, array({', '.join(quoted(v) for v in variants)})"
        for name, variants in fixed.SKILL_VARIANTS.items()
    )
    return F.coalesce(F.try_element_at(F.expr(f"map({pairs})"), key), F.array(key))


def level_from_years(years: Column) -> Column:
    return (
        F.when(years <= 1, "entry")
        .when(years <= 4, "mid")
        .when(years <= 8, "senior")
        .when(years.isNotNull(), "staff")
    )


def level_from_title(title: Column) -> Column:
    tokens = tokenize(title)
    out = None
    for level, names in fixed.SENIORITY_WORDS:
        hit = F.arrays_overlap(tokens, words(names))
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out


def years_of_experience(c: Column) -> Column:
    """Largest number of years stated in a resume text."""
    low = F.lower(text(c))

    def largest(pattern: str) -> Column:
        hits = F.regexp_extract_all(low, F.lit(pattern), F.lit(1))
        return F.array_max(F.transform(hits, lambda x: x.try_cast("bigint")))

    return F.coalesce(
        largest(r"(\d+)\+?\s*(?:years?|yrs?|yr)\s*(?:of)?\s*(?:experience|exp|work)?"),
        largest(r"(?:experience|exp)\s*(?:of|:)?\s*(\d+)"),
    )
