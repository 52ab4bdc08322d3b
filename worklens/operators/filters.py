"""The fixed five-stage filter: quality, age, must-skills, location, salary.

One pass marks each row with the first stage that fails it, so the kept rows
are a filter and the whole report is one aggregation over the same marks.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, gates, places, words
from ..functions.base import DAY, found, strip, text, within

STAGES = ["quality", "age", "must-skills", "location", "salary"]


PROFILE_TYPES = {
    "title": "string", "headline": "string", "location": "string", "experience": "string",
    "remote_preference": "string", "skills": "array<string>", "must_have_skills": "array<string>",
    "min_salary": "int",
}


def prepare(profiles: DataFrame, prefix: str = "p_") -> DataFrame:
    """Add what scoring and filtering derive from a profile alone, once per profile."""
    c = lambda n: F.col(prefix + n)
    clean = lambda n: F.filter(F.transform(F.coalesce(c(n), F.array().cast("array<string>")), strip), lambda s: s != "")
    mine = F.transform(clean("skills"), F.lower)
    many = F.array_distinct(F.filter(mine, lambda s: F.size(F.split(s, r"\s+")) > 1))
    years = strip(text(c("experience"))).try_cast("double")
    return profiles.withColumns(
        {
            prefix + "cities": places.preference_cities(strip(text(c("location")))),
            prefix + "regions": places.preference_regions(strip(text(c("location")))),
            prefix + "skill_needles": words.needles(mine, False),
            prefix + "phrase_needles": words.needles(many, False),
            prefix + "must_needles": words.needles(clean("must_have_skills"), True),
            prefix + "title_tokens": words.tokenize(F.concat_ws(" ", text(c("title")), text(c("headline")))),
            prefix + "place": F.lower(strip(text(c("location")))),
            prefix + "place_tokens": words.tokenize(strip(text(c("location")))),
            prefix + "preference": F.lower(strip(text(c("remote_preference")))),
            prefix + "level": words.level_from_years(years),
        }
    )


PREPARED = [
    "cities", "regions", "skill_needles", "phrase_needles", "must_needles", "title_tokens", "place",
    "place_tokens", "preference", "level", "min_salary",
]


def _literal(value) -> Column:
    """Literal of a prepared value; empty arrays keep their element type."""
    if isinstance(value, list):
        if not value:
            return F.array()
        return F.array(*[_literal(v) for v in value])
    if hasattr(value, "asDict"):
        return F.struct(*[_literal(v).alias(k) for k, v in value.asDict().items()])
    return F.lit(value)


_NEEDLES = "array<struct<skill:string,forms:array<struct<plain:string,pattern:string>>>>"
_ARRAYS = {
    "cities": "array<string>", "regions": "array<string>", "title_tokens": "array<string>",
    "place_tokens": "array<string>", "skill_needles": _NEEDLES, "phrase_needles": _NEEDLES,
    "must_needles": _NEEDLES, "level": "string", "min_salary": "int",
}


@dataclass(frozen=True)
class ProfileColumns:
    """Prepared profile values: literals for one profile, or columns of a joined row."""

    cities: Column
    regions: Column
    skill_needles: Column
    phrase_needles: Column
    must_needles: Column
    title_tokens: Column
    place: Column
    place_tokens: Column
    preference: Column
    level: Column
    min_salary: Column

    @staticmethod
    def of(prefix: str = "p_") -> "ProfileColumns":
        return ProfileColumns(*[F.col(prefix + n) for n in PREPARED])


@dataclass(frozen=True)
class Profile:
    """One candidate as job parameters."""

    title: str = ""
    headline: str = ""
    location: str = ""
    experience: str = ""
    remote_preference: str = ""
    skills: tuple[str, ...] = ()
    must_have_skills: tuple[str, ...] = ()
    min_salary: int = 0
    summary: str = ""

    def columns(self, spark: SparkSession) -> ProfileColumns:
        """Prepared values as literals of the plan, so one profile costs no join at all."""
        plain = {f.name: getattr(self, f.name) for f in fields(self)}
        one = _prepared(Profile(**{k: tuple(v) if isinstance(v, list) else v for k, v in plain.items()}))
        values = {n: _literal(one["p_" + n]) for n in PREPARED}
        return ProfileColumns(**{n: v.cast(_ARRAYS[n]) if n in _ARRAYS else v for n, v in values.items()})


@lru_cache(maxsize=256)
def _prepared(profile: Profile) -> Row:
    """Prepared values of a profile: a small job the first time a driver meets it, remembered for its later plans."""
    schema = ", ".join(f"p_{n} {t}" for n, t in PROFILE_TYPES.items())
    row = [list(v) if isinstance(v, tuple) else v for v in (getattr(profile, n) for n in PROFILE_TYPES)]
    return prepare(SparkSession.active().createDataFrame([row], schema)).first()


@dataclass(frozen=True)
class FilterOptions:
    days: int | None = 7
    strict_age: bool = False
    min_must_matches: int = 1
    soft_must_skills: bool = False
    remote: bool = False
    min_salary: int = 0
    drop_unknown_salary: bool = False
    strict_location: bool = False


def _quality_passes() -> Column:
    title, company = F.lower(strip(F.col("title"))), F.lower(strip(F.col("company")))
    url = strip(F.col("url"))
    both_placeholder = (within(title, fixed.PLACEHOLDERS) | F.startswith(title, F.lit("naukri"))) & within(company, fixed.PLACEHOLDERS)
    return ~(
        (title == "")
        | gates.is_junk_title(F.col("title"))
        | both_placeholder
        | ((company != "") & (title == company) & ~F.contains(title, F.lit(" ")))
        | (url == "")
        | (found(url, fixed.TRACKING_URL) & (text(F.col("job_key")) == ""))
    )


def _location_decision(p: ProfileColumns, o: FilterOptions) -> Column:
    """keep, drop, remote (remote dropped), unknown (no city)."""
    city, region, remote = F.col("city"), F.col("region"), F.col("remote_ok")
    if o.remote:
        return F.when(remote, "keep").otherwise("drop")
    cities, regions, preference = p.cities, p.regions, p.preference
    remote_fine = (
        preference.isin("remote", "hybrid") | (F.size(cities) == 0) | F.array_contains(cities, "Remote")
    )
    return (
        F.when(remote, F.when(remote_fine, "keep").otherwise("remote"))
        .when(F.size(cities) == 0, "keep")
        .when(F.array_contains(cities, "India") & (city != ""), "keep")
        .when((city != "") & F.array_contains(cities, city), "keep")
        .when((city != "") & (region != "") & F.array_contains(regions, region), "keep")
        .when(city == "", "unknown")
        .otherwise("drop")
    )


def mark_stages(df: DataFrame, p: ProfileColumns, o: FilterOptions, as_of: Column) -> DataFrame:
    """Add ``drop_stage`` (0 = kept, else the number of the first failing stage) and the row tags.

    ``df`` is normalized. A stage whose option is not a number passes all rows
    and shows up as failed in the report.
    """
    days = _whole(o.days if o.days is not None else 7)
    width = None if days is None else (max(0, days) * DAY or 86399)
    epoch, salary = F.col("listed_epoch"), F.col("salary_int")
    floor_option = _whole(o.min_salary or 0)
    floor = F.when(F.coalesce(p.min_salary, F.lit(0)) != 0, p.min_salary).otherwise(F.lit(floor_option or 0))

    df = df.withColumns(
        {
            "_hits": F.when(
                F.size(p.must_needles) > 0,
                F.size(words.hits(F.concat_ws(" ", "title", "description"), p.must_needles)),
            ),
            "_floor": floor,
        }
    )
    df = df.withColumn("_where", _location_decision(p, o))
    need = _whole(o.min_must_matches or 1)
    passes = {
        1: _quality_passes(),
        2: F.lit(True) if width is None else F.when(epoch.isNull(), F.lit(not o.strict_age)).otherwise(
            epoch >= as_of.cast("double") - width
        ),
        3: F.lit(True) if need is None else (
            F.col("_hits").isNull() | (F.col("_hits") >= max(1, need)) | F.lit(o.soft_must_skills)
        ),
        4: (F.col("_where") == "keep") | ((F.col("_where") == "unknown") & F.lit(not o.strict_location)),
        5: F.lit(True) if floor_option is None else (
            (F.col("_floor") <= 0)
            | F.when(salary.isNull(), F.lit(not o.drop_unknown_salary)).otherwise(salary >= F.col("_floor"))
        ),
    }
    stage = F.lit(0)
    for number in reversed(range(1, 6)):
        stage = F.when(~passes[number], number).otherwise(stage)
    df = df.withColumn("drop_stage", stage)
    at = F.col("drop_stage")
    placeholder = within(F.lower(strip(F.col("company"))), fixed.PLACEHOLDERS)
    reached = lambda n: (at == 0) | (at >= n)
    return df.withColumns(
        {
            "data_quality": F.when(reached(2) & placeholder, F.coalesce(F.col("data_quality"), F.lit("partial")))
            .otherwise(F.col("data_quality")),
            "age": F.when(reached(2) & epoch.isNull(), "unknown"),
            "must_skills_soft": reached(4)
            & F.coalesce(F.col("_hits") < max(1, need or 1), F.lit(False))
            & F.lit(o.soft_must_skills),
            "loc_tag": F.when(reached(4) & (F.col("_where") == "unknown"), "unknown"),
            "salary_tag": F.when(reached(5) & salary.isNull() & (F.col("_floor") > 0), "unknown"),
        }
    )


def _whole(value) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def kept(marked: DataFrame) -> DataFrame:
    return marked.filter(F.col("drop_stage") == 0).drop("_hits", "_floor", "_where", "drop_stage")


def report(marked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per stage (and per ``by`` group): kept, dropped, unknown, reason.

    Counts are partial sums before the shuffle, so its size does not depend on
    the number of postings; the unpivot works on one row per group.
    """
    by = by or []
    at = F.col("drop_stage")
    sums = [F.count(F.lit(1)).alias("n"), F.first("_floor").alias("floor"), F.max(F.col("_hits").isNotNull()).alias("must")]
    sums += [F.count_if(at == i).alias(f"d{i}") for i in range(1, 6)]
    sums += [
        F.count_if(F.col("age") == "unknown").alias("u2"),
        F.count_if(F.col("salary_tag") == "unknown").alias("u5"),
        F.count_if((at == 4) & (F.col("_where") == "remote")).alias("remote_dropped"),
        F.count_if((at == 4) & (F.col("_where") == "unknown")).alias("place_dropped"),
    ]
    one = marked.groupBy(*by).agg(*sums)
    note = F.concat_ws(
        " | ",
        F.when(
            F.col("remote_dropped") > 0,
            F.concat(
                F.col("remote_dropped").cast("string"),
                F.lit(
                    " remote job(s) excluded — set filters.remote: true "
                    "or profile remote_preference: remote/hybrid to include them"
                ),
            ),
        ),
        F.when(
            F.col("place_dropped") > 0,
            F.concat(
                F.col("place_dropped").cast("string"),
                F.lit(
                    " unknown-location job(s) dropped "
                    "(strict_location) — unset filters.strict_location to keep them tagged [loc?]"
                ),
            ),
        ),
    )
    reasons = {
        3: F.when(~F.coalesce(F.col("must"), F.lit(False)), "no must-have skills set").otherwise(""),
        4: note,
        5: F.when(F.coalesce(F.col("floor"), F.lit(0)) <= 0, "no floor configured").otherwise(""),
    }
    rows = []
    left = F.col("n")
    for i, name in enumerate(STAGES, 1):
        left = left - F.col(f"d{i}")
        rows.append(
            F.struct(
                F.lit(i).alias("stage"), F.lit(name).alias("name"), left.alias("kept"),
                F.col(f"d{i}").alias("dropped"),
                (F.col("u2") if i == 2 else F.col("u5") if i == 5 else F.lit(0)).cast("bigint").alias("unknown"),
                reasons.get(i, F.lit("")).alias("reason"),
            )
        )
    return one.select(*by, F.inline(F.array(*rows)))


def summary(reports: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Human line "age −142 · must-skills −21" and the actionable note, per group of five rows."""
    part = F.concat_ws(
        " · ",
        F.when(F.col("dropped") > 0, F.concat(F.col("name"), F.lit(" −"), F.col("dropped").cast("string"))),
        F.when(F.col("unknown") > 0, F.concat(F.col("name"), F.lit(" ?"), F.col("unknown").cast("string"))),
    )
    lines = F.array_sort(F.collect_list(F.struct("stage", part.alias("part"))))
    return reports.groupBy(*(by or [])).agg(
        F.array_join(F.filter(F.transform(lines, lambda x: x["part"]), lambda s: s != ""), " · ").alias("filter_summary"),
        F.max(F.when(F.col("name") == "location", F.col("reason"))).alias("filter_note"),
    )
