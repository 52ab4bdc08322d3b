"""Profiles from repositories, web hits and resume answers; defaults of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.base import capture, filled, lookup, split, strip, text, within
from .rank import first_n


def repository_skills(repos: DataFrame, enough: int | None = None) -> DataFrame:
    """Skills per profile: language first, then listed topics, repository by repository.

    With ``enough``, reading stops after the repository that brings the count to it.
    Each distinct skill is reduced to its first place by partial aggregation;
    what is left per profile is bounded by the fixed skill tables.
    ``repos`` holds profile_id, repo_no, language, topics.
    """
    language = lookup(fixed.LANGUAGE_SKILLS, F.lower(strip(text(F.col("language")))))
    topics = F.filter(F.transform("topics", strip), lambda t: within(t, fixed.TOPIC_SKILLS))
    named = F.concat(F.array_compact(F.array(language)), topics)
    flat = repos.select("profile_id", "repo_no", F.posexplode(named).alias("at", "skill"))
    first = flat.groupBy("profile_id", "skill").agg(F.min(F.struct("repo_no", "at")).alias("place"))
    lists = first.groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("place", "skill"))).alias("found"))
    kept = F.col("found")
    if enough is not None:
        last = F.get(F.col("found"), F.lit(enough - 1))["place"]["repo_no"]
        kept = F.filter("found", lambda x: last.isNull() | (x["place"]["repo_no"] <= last))
    return lists.select("profile_id", F.transform(kept, lambda x: x["skill"]).alias("suggested"))


def add_skills(skills: Column, more: Column) -> Column:
    """Append the skills not already there, whatever their case."""
    have = F.transform(skills, F.lower)
    return F.concat(skills, F.filter(more, lambda s: ~F.array_contains(have, s)))


def top_repositories(repos: DataFrame, newest: int | None = None, most: int | None = None) -> DataFrame:
    """Repositories of each profile by stars, with ``star_rank``; ``newest`` and ``most`` limit them to the newest and to the best."""
    recent = repos if newest is None else first_n(repos, newest, ["profile_id"], [F.asc("repo_no")], "_n").drop("_n")
    return first_n(recent, 2**31 - 1 if most is None else most, ["profile_id"], [F.desc("stars"), F.asc("repo_no")], "star_rank")


def profile_from_hit(title: Column, snippet: Column, handle: Column) -> Column:
    """Struct(name, headline) out of a profile page's search hit."""
    dash = F.contains(title, F.lit(" - "))
    name = F.when(dash, strip(F.get(split(title, " - ", False), F.lit(0)))).otherwise(handle)
    front = F.get(split(title, r" \| ", False), F.lit(0))
    # Without a dash before the bar the whole front part stays.
    between = strip(F.regexp_replace(front, r"(?s)^.*? - ", ""))
    role = strip(capture(snippet, fixed.PROFILE_ROLE))
    experience = strip(capture(snippet, r"Experience:\s*([^·]+)", 1, False))
    base = F.when(dash & F.contains(title, F.lit(" | ")), between).otherwise("")
    return F.struct(name.alias("name"), F.coalesce(role, experience, base).alias("headline"))


def run_defaults(title: Column, headline: Column, location: Column, set_query: Column, set_location: Column,
                 last_query: Column, last_location: Column, last_days: Column, set_days: Column) -> Column:
    """Query, location and days of a run by precedence: profile, settings, last run."""
    first = lambda *c: F.coalesce(*[filled(x) for x in c], F.lit(""))
    return F.struct(
        first(title, headline, set_query, last_query).alias("query"),
        first(location, set_location, last_location).alias("location"),
        F.coalesce(last_days, set_days, F.lit(7)).alias("days"),
    )


def supplement(df: DataFrame, extra_skills: Column, title: Column, experience: Column, headline: Column) -> DataFrame:
    """Append comma-separated skills and fill the empty fields of a profile."""
    more = F.filter(F.transform(split(text(extra_skills), ",", False), strip), lambda s: s != "")
    new_title = F.coalesce(filled(strip(F.col("p_title"))), title)
    return df.withColumns(
        {
            "p_skills": F.concat("p_skills", more),
            "p_title": new_title,
            "p_experience": F.coalesce(filled(strip(F.col("p_experience"))), experience),
            "p_headline": F.coalesce(filled(F.col("p_headline")), filled(headline), new_title),
        }
    )
