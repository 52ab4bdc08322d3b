"""Exact and fuzzy duplicate removal; the earliest row of a set of copies stays.

The fuzzy rule is greedy: a row goes when an earlier *kept* row has a title
ratio >= 82 and a company ratio >= 88. Similarity is not transitive, so groups
of connected rows would be wrong. The plan:

1. Copies with equal keys collapse to their first row by partial aggregation,
   so a mass of copies costs one row per task.
2. Similar titles and similar companies are found apart, over the distinct
   strings. Pairs of rows are never listed, however many rows share a title.
3. Titles meet on rare bigrams. Two titles of ratio >= 82 differ in at most
   0.61 x length of their numbered bigrams, so with all bigrams in one order
   the first ``floor(0.61 x length) + 1`` of each must share one (prefix filter;
   q-gram count of Gravano et al., VLDB 2001). Titles of up to two characters
   match only equal ones.
4. Companies meet on words or on bigrams inside words. A set ratio >= 88 means
   that one name is all but 3/14 of its length common words (it then meets on
   its rarest words, which the other side must hold), or that the names differ
   in at most 0.43 x length of their bigrams (prefix filter as above).
5. A block of keys above ``BLOCK`` strings is cut into square tiles, so it is
   spread over many tasks and no pair is lost. A pair is looked at under its
   smallest shared key only, behind a length test; the ratio runs on Arrow
   batches.
6. Similar nodes become a narrow edge list. Rounds over it: a node that nothing
   undecided stands before stays, its neighbours go; settled nodes and their
   edges leave the list, until it is empty. Every round ends in a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, similarity
from ..functions.base import text
from ..functions.words import match_key
from ..session import checkpoint, small

BLOCK = 2000


def first_by(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """Row of the smallest ``order`` per key. Only a key's hash and number are aggregated; the rows follow by both."""
    keyed = df.withColumn("_key", F.xxhash64(*keys))
    first = keyed.groupBy("_key").agg(F.min(order).alias(order))
    return keyed.join(first, ["_key", order], "left_semi").select(*df.columns)


def exact_url(df: DataFrame, order: str = "posting_id") -> DataFrame:
    return first_by(df, [F.col("url")], order)


def exact_title_company(df: DataFrame, order: str = "posting_id") -> DataFrame:
    return first_by(df, [F.lower(text(F.col("title"))), F.lower(text(F.col("company")))], order)


def _numbered_bigrams(t: Column) -> Column:
    """Bigrams of a text with the number of their occurrence, so that counts are kept."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    return F.transform(
        pieces,
        lambda g, i: F.struct(
            g.alias("g"), F.size(F.filter(F.slice(pieces, F.lit(1), i + 1), lambda x: x == g)).alias("n")
        ),
    )


def _bigram_counts(strings: DataFrame) -> Column | None:
    """Constant map bigram -> count. Match keys hold 37 kinds of characters and
    a word mark, so there are under 1500 bigrams whatever the data."""
    flat = strings.filter(F.length("s") > 1).select(F.explode(similarity.bigrams(F.col("s"))).alias("g"))
    counts = {r["g"]: r["n"] for r in flat.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    return F.expr("map(" + ", ".join(f"'{g}', {n}L" for g, n in sorted(counts.items())) + ")")


def _rare_first(pieces: Column, counts: Column, most: Column) -> Column:
    """The ``most`` rarest numbered bigrams as text keys."""
    keyed = F.transform(
        pieces, lambda x: F.struct(F.try_element_at(counts, x["g"]).alias("f"), x["g"].alias("g"), x["n"].alias("n"))
    )
    return F.transform(
        F.slice(F.array_sort(keyed), F.lit(1), most.cast("int")), lambda x: F.concat_ws("#", x["g"], x["n"].cast("string"))
    )


def _share(threshold: float) -> float:
    """Largest share of its own bigrams a string can lose against a partner of that ratio."""
    return 2 * (2 - 2 * threshold / 100) / (2 - threshold / 100)


def _meeting(strings: DataFrame, threshold: float, block: int) -> DataFrame:
    """Pairs (x, y), x < y, of ``s`` that share one of their ``keys`` and may reach the ratio by length."""
    flat = strings.withColumn("key", F.explode("keys"))
    large = flat.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block)
    large = checkpoint(large.select("key", F.ceil(F.col("_n") / block).cast("int").alias("_chunks")))
    flat = flat.join(small(large), "key", "left")
    chunks = F.coalesce("_chunks", F.lit(1))
    flat = flat.withColumn("chunk", F.pmod(F.xxhash64("s"), chunks).cast("int"))
    flat = flat.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    flat = flat.withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")})
    on = ["key", "lo", "hi"]
    side = lambda n: flat.select(*on, F.col("s").alias(n), F.col("keys").alias(n + "_keys"), F.col("chunk").alias(n + "_chunk"))
    total = F.length("x") + F.length("y")
    near = 200 * F.least(F.length("x"), F.length("y")) >= total * threshold
    tile = (F.col("lo") == F.col("hi")) | (F.col("x_chunk") != F.col("y_chunk"))
    once = F.array_min(F.array_intersect("x_keys", "y_keys")) == F.col("key")
    return side("x").join(side("y"), on).filter((F.col("x") < F.col("y")) & near & tile & once).select("x", "y")


def similar_titles(titles: DataFrame, threshold: float, strict: bool = False, block: int = BLOCK) -> DataFrame:
    """Symmetric pairs (s, s2) of distinct titles at the ratio, each title with itself included."""
    counts = _bigram_counts(titles)
    own = titles.select("s", F.col("s").alias("s2"))
    if counts is None:
        return own
    most = F.floor(F.length("s") * _share(threshold)) + 1
    keyed = titles.filter(F.length("s") > 2).withColumn("keys", _rare_first(_numbered_bigrams(F.col("s")), counts, most))
    measured = similarity.plain_ratio(F.col("x"), F.col("y"))
    pairs = checkpoint(_meeting(keyed, threshold, block).filter(measured > threshold if strict else measured >= threshold))
    return _both_ways(pairs, own)


def _both_ways(pairs: DataFrame, own: DataFrame) -> DataFrame:
    there = pairs.select(F.col("x").alias("s"), F.col("y").alias("s2"))
    back = pairs.select(F.col("y").alias("s"), F.col("x").alias("s2"))
    return there.unionByName(back).unionByName(own)


def _word_bigrams(c: Column) -> Column:
    """Numbered bigrams inside the words of a name, each word led by a mark."""
    marked = F.transform(F.array_distinct(F.split(c, " ")), lambda w: F.concat(F.lit("^"), w))
    pieces = F.flatten(
        F.transform(marked, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2))))
    )
    return F.transform(
        pieces,
        lambda g, i: F.struct(g.alias("g"), F.size(F.filter(F.slice(pieces, F.lit(1), i + 1), lambda x: x == g)).alias("n")),
    )


def _by_words(names: DataFrame, block: int) -> DataFrame:
    """Pairs where one name's rarest words, just over 3/14 of its length, meet any word of the other.

    A word of more than ``block`` names is split: its holders are dealt into chunks, and each probe visits all of them.
    """
    flat = names.select("s", F.explode(F.array_distinct(F.split("s", " "))).alias("w"))
    rarity = flat.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    own = flat.join(rarity, "w").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("ws"))
    # Words of a name are few; lengths run up until the bound is passed.
    passed = lambda i: F.aggregate(
        F.slice("ws", F.lit(1), i), F.lit(0), lambda acc, x: acc + F.length(x["w"])
    )
    probe = F.filter("ws", lambda x, i: (i == 0) | (passed(i) <= F.length("s") * 3.0 / 14.0))
    probes = own.select(F.col("s").alias("a"), F.explode(F.transform(probe, lambda x: x["w"])).alias("w"))
    chunks = rarity.select("w", F.ceil(F.col("n") / block).cast("int").alias("of"))
    holders = flat.join(chunks, "w").select(F.col("s").alias("b"), "w", F.pmod(F.xxhash64("s"), F.col("of")).cast("int").alias("chunk"))
    probes = probes.join(chunks, "w").select("a", "w", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("chunk"))
    met = probes.join(holders, ["w", "chunk"]).filter(F.col("a") != F.col("b"))
    return met.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))


def similar_names(names: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Symmetric pairs (s, s2) of distinct company names at the set ratio, each with itself included."""
    own, real = names.select("s", F.col("s").alias("s2")), names.filter(F.col("s") != "")
    marked = real.select(F.concat(F.lit("^"), F.replace("s", F.lit(" "), F.lit("^"))).alias("s"))
    counts = _bigram_counts(marked)
    if counts is None:
        return own
    most = F.floor(F.length("s") * _share(threshold)) + 1
    keyed = real.withColumn("keys", _rare_first(_word_bigrams(F.col("s")), counts, most))
    met = _meeting(keyed, threshold, block).unionByName(_by_words(real, block)).distinct()
    return _both_ways(checkpoint(met.filter(similarity.name_ratio(F.col("x"), F.col("y")) >= threshold)), own)


def similar_nodes(nodes: DataFrame, scope: list[str], titles: DataFrame, companies: DataFrame) -> DataFrame:
    """Edges (early, late) between nodes of a scope with similar titles and similar companies, early < late."""
    by_title = titles.select(F.col("s").alias("t"), F.col("s2").alias("t2"))
    by_company = companies.select(F.col("s").alias("c"), F.col("s2").alias("c2"))
    there = nodes.select(*scope, F.col("t").alias("t2"), F.col("c").alias("c2"), F.col("id").alias("early"))
    # Neighbours are spelled out only as far as strings of real nodes go.
    reach = nodes.join(by_title, "t").join(nodes.select(*scope, F.col("t").alias("t2")).distinct(), [*scope, "t2"], "left_semi")
    return reach.join(by_company, "c").join(there, [*scope, "t2", "c2"]).filter("early < id").select("early", F.col("id").alias("late"))


def greedy_removed(edges: DataFrame) -> DataFrame | None:
    """Ids that the greedy rule removes, None without edges: a node goes when an earlier kept one is its neighbour.

    A round settles the nodes that nothing undecided stands before: they stay, and
    their neighbours go with all edges of theirs. Nodes without an edge never take part.
    """
    edges, gone = checkpoint(edges), None
    while not edges.isEmpty():
        held = edges.select(F.col("late").alias("early")).distinct()
        free = edges.select("early").distinct().join(held, "early", "left_anti")
        removed = checkpoint(edges.join(free, "early", "left_semi").select(F.col("late").alias("id")).distinct())
        gone = removed if gone is None else gone.unionByName(removed)
        late, early = removed.withColumnRenamed("id", "late"), removed.withColumnRenamed("id", "early")
        edges = checkpoint(edges.join(late, "late", "left_anti").join(early, "early", "left_anti").join(free, "early", "left_anti"))
    return gone


def fuzzy(
    df: DataFrame, scope: list[str] | None = None, order: str = "posting_id",
    title_at_least: float = fixed.TITLE_SIMILARITY, company_at_least: float = fixed.COMPANY_SIMILARITY,
    block: int = BLOCK,
) -> DataFrame:
    """Rows that survive the greedy rule, within each ``scope`` (a batch), or over all rows."""
    scope = scope or []
    keys = df.select(
        *scope, F.col(order).alias("id"), similarity.sorted_words(match_key(F.col("title"))).alias("t"),
        similarity.sorted_words(match_key(F.col("company"))).alias("c"),
    )
    nodes = checkpoint(keys.groupBy(*scope, "t", "c").agg(F.min("id").alias("id")))
    titles = similar_titles(nodes.select(F.col("t").alias("s")).distinct(), title_at_least, block=block)
    companies = similar_names(nodes.select(F.col("c").alias("s")).distinct(), company_at_least, block)
    removed = greedy_removed(similar_nodes(nodes, scope, titles, companies))
    kept = nodes if removed is None else nodes.join(removed, "id", "left_anti")
    return df.join(kept.select(F.col("id").alias(order)), order, "left_semi")


def fuzzy_queries(df: DataFrame, scope: list[str], query: str = "query", order: str = "query_no") -> DataFrame:
    """Queries of a run that are no near copy (ratio above 85) of an earlier kept one."""
    ordered = F.struct(*scope, order)
    keys = df.select(*scope, ordered.alias("id"), similarity.sorted_words(match_key(F.col(query))).alias("t"), F.lit("").alias("c"))
    nodes = checkpoint(keys.groupBy(*scope, "t", "c").agg(F.min("id").alias("id")))
    titles = similar_titles(nodes.select(F.col("t").alias("s")).distinct(), fixed.QUERY_SIMILARITY, strict=True)
    one = nodes.select(F.col("c").alias("s"), F.col("c").alias("s2")).distinct()
    removed = greedy_removed(similar_nodes(nodes, scope, titles, one))
    kept = (nodes if removed is None else nodes.join(removed, "id", "left_anti")).select("id.*")
    return df.join(kept, [*scope, order], "left_semi")
