"""Secret scans with multipart credential linking, in DataFrame operations alone.

Strong finds stand by themselves: assignments to secret names, access keys, long hexadecimal
runs. Weak candidates (login names, endpoints, mixed random-looking tokens) are
reported only where the complementary part lies within ``SCOPE`` code points: a join of
intervals in bins of a scope's length, so a part meets only what stands near it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.session import checkpoint, small

SCOPE = 200
KINDS = ("assign", "access", "hex", "weak_login", "weak_secret", "weak_endpoint")

# Patterns of the strong kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"(AKIA[A-Z0-9]+)()"
HEX = r"([0-9a-f]{32,})()"

# Weak kinds: the part itself is the first group.
LOGIN = r"""((?i:\b(?:user|username|login|account|client_id|key_id|access_key_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}))()"""
TOKEN = r"([A-Za-z0-9+/_=-]{20,})()"
ENDPOINT = r"""((?i:https?|jdbc:[a-z0-9]+|s3|ftp|ssh)://[^\s"'<>]+)()"""

_SPAN = "struct<start:int,kind:int,end:int>"


def _matches(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the leftmost matches that do not overlap; ``keep(match, second group)`` decides on each.

    Spark gives matches without their places, so every match is taken with the
    gap before it (anchored at the end of the last one), and lengths are summed.
    """
    whole = r"\G(?s:(.*?))(" + pattern + ")"
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(whole), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(whole), F.lit(2)).alias("match"), F.regexp_extract_all(text, F.lit(whole), F.lit(4)).alias("value")
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def step(done: Column, x: Column) -> Column:
        begin = done["at"] + F.length(x["gap"])
        end = begin + F.length(x["match"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(keep(x["match"], x["value"]), F.array_append(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(found, start, step, lambda done: done["spans"])


def _where(condition: Column, spans: Column) -> Column:
    """The costly search only where a cheap scan finds what it needs."""
    return F.when(condition, spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _any(text: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _mixed(token: Column) -> Column:
    """A token that looks random: small and capital letters and three digits or more."""
    return token.rlike("[a-z]") & token.rlike("[A-Z]") & token.rlike("[0-9][^0-9]*[0-9][^0-9]*[0-9]")


def _parts(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, row, base, weak): strong spans, and weak candidates that touch none of them."""
    text, low = F.col("text"), F.col("low")
    always = lambda match, value: F.lit(True)
    named = _any(low, "password", "passwd", "secret", "token", "api_key", "apikey") & text.rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")
    base = F.concat(
        _where(named, _matches(text, ASSIGN, 0, lambda match, value: F.length(value) >= 8)),
        _where(text.contains("AKIA"), _matches(text, ACCESS, 1, lambda match, value: F.length(match) >= 16)),
        _where(text.rlike("[0-9a-f]{32}"), _matches(text, HEX, 2, always)),
    )
    weak = F.concat(
        _where(_any(low, "user", "login", "account", "client_id", "key_id"), _matches(text, LOGIN, 3, always)),
        _where(text.rlike("[A-Za-z0-9+/_=-]{20}") & text.rlike("[0-9]"), _matches(text, TOKEN, 4, lambda match, value: _mixed(match))),
        _where(text.contains("://"), _matches(text, ENDPOINT, 5, always)),
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("row"), F.array_sort(base).alias("base"), weak.alias("weak"))
    free = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    return rows.withColumn("weak", free)


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, mark, base, spans; spans are (start, kind, end), kinds by KINDS.

    Places count code points, ends are exclusive. ``base`` holds the strong
    spans, ``spans`` those and the weak ones that a complementary part supports: a login or an
    endpoint needs a secret within ``scope`` code points, a weak secret needs a login, an access key or an
    endpoint. ``mark`` is a hash of the text. NULL and empty texts have no spans. Repeated rows
    are scanned one by one.
    An empty table gives no rows; texts are taken whole at any length. Other columns are ignored.
    """
    parts = checkpoint(_parts(docs))
    open_rows = parts.where(F.size("weak") > 0)
    each = open_rows.select("row", F.explode(F.concat("base", "weak")).alias("s")).select("row", "s.*")
    secret = F.col("kind").isin(0, 2, 4)
    near = F.expr(f"sequence((start div {scope}) - 1, ((end - 1) div {scope}) + 1)")
    secrets = each.where(secret).select("row", F.col("start").alias("s0"), F.col("kind").alias("sk"), F.col("end").alias("s1"), F.explode(near).alias("bin"))
    others = each.where(~secret).select("row", F.col("start").alias("o0"), F.col("kind").alias("ok"), F.col("end").alias("o1"), F.explode(F.expr(f"sequence(start div {scope}, (end - 1) div {scope})")).alias("bin"))
    linked = secrets.join(others, ["row", "bin"]).where((F.greatest("s0", "o0") - F.least("s1", "o1") <= scope) & ((F.col("sk") == 4) | (F.col("ok") > 2)))
    found = linked.select("row", F.explode(F.array(F.struct(F.col("s0").alias("start"), F.col("sk").alias("kind"), F.col("s1").alias("end")), F.struct(F.col("o0").alias("start"), F.col("ok").alias("kind"), F.col("o1").alias("end")))).alias("s"))
    added = found.where("s.kind > 2").distinct().groupBy("row").agg(F.collect_list("s").alias("added"))
    both = parts.join(added, "row", "left")
    return both.select("doc_id", "mark", "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{_SPAN}>")))).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def redacted(docs: DataFrame, scope: int = SCOPE, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``secret_spans`` replaced by ``mask`` in text (touching or overlapping spans by one); all rows and columns stay."""
    found = secret_spans(docs.select("doc_id", "text"), scope).where(F.size("spans") > 0)
    found = small(checkpoint(found.select("doc_id", "mark", "spans").dropDuplicates(["doc_id", "mark"])), 50_000)
    # The row travels as one struct, so no column of it can clash with those of the join.
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    joined = rows.join(found.withColumnRenamed("doc_id", "of"), rows["doc_id"].eqNullSafe(F.col("of")) & (rows["mark"] == found["mark"]), "left")
    text = F.col("doc.text")

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, s["start"] - done["at"])
        out = F.when((s["start"] <= done["at"]) & (done["at"] > 0), done["out"]).otherwise(F.concat(done["out"], gap, F.lit(mask)))
        return F.struct(F.greatest(s["end"], done["at"]).alias("at"), out.alias("out"))

    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
    hidden = F.when(F.col("spans").isNotNull(), clean).otherwise(text)
    return joined.select(*[hidden.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
