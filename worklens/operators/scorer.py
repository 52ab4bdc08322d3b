"""Tables around an external scorer: prompts, answers, query lists, the plug-in call."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import filled, let, replace, strip, tenths, text
from ..functions.words import valid_query


def _one_value(c: Column) -> Column:
    """The one JSON value of a text. Inside a list the parser cannot overlook what follows the value."""
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return let(
        listed,
        lambda v: F.when(
            F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant")
        ),
    )


def tolerant_json(c: Column) -> Column:
    """JSON object in a model answer: fences stripped, else first brace to last brace; NULL when none parses."""

    def parse(raw: Column) -> Column:
        fenced = replace(replace(raw, r"^```(?:json)?\s*", "", False), r"\s*```$", "", False)
        body = strip(F.when(F.startswith(raw, F.lit("```")), fenced).otherwise(raw))
        braces = filled(F.regexp_extract(body, r"(?s)\{.*\}", 0))
        return F.coalesce(_one_value(body), _one_value(braces))

    return let(strip(text(c)), parse)


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_get(v, path, "variant")), F.lit("VOID"))


def _is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def _texts(v: Column, path: str) -> Column:
    """Text items of a JSON list."""
    items = _get(v, path, "array<variant>")
    return F.transform(
        F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"),
        lambda x: F.try_variant_get(x, "$", "string"),
    )


def parse_score(answer: Column) -> Column:
    """Struct(score, reasons), or NULL when the answer holds no numeric score."""

    def read(v: Column) -> Column:
        numeric = _kind(v, "$.score").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        value = F.least(F.lit(100.0), F.greatest(F.lit(0.0), _get(v, "$.score", "double")))
        reasons = F.coalesce(_texts(v, "$.reasons"), F.array().cast("array<string>"))
        return F.when(_is_object(v) & numeric, F.struct(tenths(value).alias("score"), reasons.alias("reasons")))

    return let(tolerant_json(answer), read)


def parse_verdict(answer: Column) -> Column:
    """Struct(recommend, line), or NULL unless both are there in the right type."""

    def read(v: Column) -> Column:
        line = strip(_get(v, "$.line", "string"))
        ok = (_kind(v, "$.recommend") == "BOOLEAN") & (_kind(v, "$.line") == "STRING") & (line != "")
        return F.when(
            _is_object(v) & ok,
            F.struct(_get(v, "$.recommend", "boolean").alias("recommend"), line.alias("line")),
        )

    return let(tolerant_json(answer), read)


def parse_list(answer: Column, key: str, most: int | None = None) -> Column:
    """Trimmed non-empty text items under ``key`` (the first ``most``), NULL when there is no such list."""

    def read(v: Column) -> Column:
        items = F.filter(F.transform(_texts(v, f"$.{key}"), strip), lambda s: s != "")
        return F.when(_is_object(v) & (F.size(_get(v, f"$.{key}", "array<variant>")) > 0), items if most is None else F.slice(items, 1, most))

    return let(tolerant_json(answer), read)


def parse_profile(answer: Column) -> Column:
    """The six fields of an extracted profile with their defaults; a numeric experience becomes text."""

    def read(v: Column) -> Column:
        def word(name: str) -> Column:
            return F.coalesce(_get(v, f"$.{name}", "string"), F.lit("")).alias(name)

        skills = F.coalesce(_texts(v, "$.skills"), F.array().cast("array<string>"))
        return F.when(
            _is_object(v),
            F.struct(word("name"), word("title"), word("headline"), skills.alias("skills"), word("experience"), word("summary")),
        )

    return let(tolerant_json(answer), read)


def prompt_rows(df: DataFrame) -> DataFrame:
    """Add ``prompt_facts``: the profile and posting values a scorer is asked about, whole."""
    title = F.coalesce(filled(F.col("p_title")), F.col("p_headline"), F.lit(""))
    lines = [
        ("Current Title", title),
        ("Headline", F.coalesce(filled(F.col("p_headline")), title)),
        ("Skills", F.coalesce(filled(F.array_join("p_skills", ", ")), F.lit("None specified"))),
        ("Experience", F.concat(F.coalesce(filled(F.col("p_experience")), F.lit("Not specified")), F.lit(" years"))),
        ("Summary", text(F.col("p_summary"))),
        ("Preferred Location", text(F.col("p_location"))),
        ("Title", F.col("title")), ("Company", F.col("company")), ("Location", F.col("location")),
        ("Salary", text(F.col("salary"))),
        ("Description", text(F.col("description"))),
    ]
    return df.withColumn(
        "prompt_facts", F.concat_ws("\n", *[F.concat(F.lit(f"- {name}: "), value) for name, value in lines])
    )


Scorer = Callable[[pd.DataFrame], pd.Series]


def _answers(scorer: Scorer, frame: pd.DataFrame, retries: int) -> list[str | None]:
    """Answers of a call; one that keeps raising, or answers another number of rows, is split in halves down to the row that fails."""
    for _ in range(retries + 1):
        try:
            found = list(scorer(frame))
        except Exception:  # noqa: BLE001 - a failing scorer must not fail the job
            continue
        if len(found) == len(frame):
            return found
    if len(frame) == 1:
        return [None]
    middle = len(frame) // 2
    return _answers(scorer, frame.iloc[:middle], retries) + _answers(scorer, frame.iloc[middle:], retries)


def _frame(rows: pa.RecordBatch) -> pd.DataFrame:
    """Rows as a frame; times are local ones of the session."""
    frame = pa.Table.from_batches([rows]).to_pandas(maps_as_pydicts="strict")
    return frame.assign(**{c: frame[c].dt.tz_localize(None) for c in frame.select_dtypes("datetimetz").columns})


def call_scorer(work: DataFrame, scorer: Scorer, rows_per_call: int | None = None, at_once: int = 1, retries: int = 0) -> DataFrame:
    """Add ``answer``: a user scorer's text for every row of the work list, NULL where it failed, so that row keeps its heuristic score.

    ``scorer`` maps a frame with ``prompt_facts`` to answer texts. A task calls it with ``rows_per_call`` rows (an
    Arrow batch by default), up to ``at_once`` calls at a time, and takes further rows only as calls end. A call that raises is
    tried ``retries`` times more, then split, so one bad row costs its own answer alone. Only the rows of running calls are frames;
    the rest of a batch stays in Arrow.
    """
    schema = work.select("*", F.lit(None).cast("string").alias("answer")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def calls() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size = rows_per_call or max(1, batch.num_rows)
                for at in range(0, batch.num_rows, size):
                    yield batch.slice(at, size)

        def answered(rows: pa.RecordBatch, found: list) -> pa.RecordBatch:
            answers = pa.array(found, pa.string(), from_pandas=True)
            return pa.RecordBatch.from_arrays([*rows.columns, answers], [*rows.schema.names, "answer"])

        with ThreadPoolExecutor(at_once) as pool:
            running: deque = deque()
            for rows in calls():
                running.append((rows, pool.submit(lambda r: _answers(scorer, _frame(r), retries), rows)))
                if len(running) >= at_once:
                    done, answers = running.popleft()
                    yield answered(done, answers.result())
            for done, answers in running:
                yield answered(done, answers.result())

    return work.mapInArrow(run, schema)


def expand_queries(rows: DataFrame, base: str, answer: str) -> DataFrame:
    """Usable further queries of an answer list, one row each, without the base query."""
    listed = F.coalesce(parse_list(F.col(answer), "queries"), F.array().cast("array<string>"))
    other = F.filter(listed, lambda q: (F.lower(q) != F.lower(F.col(base))))
    return rows.select("*", F.posexplode(other).alias("query_no", "query")).filter(
        valid_query(F.col("query"))
    )
