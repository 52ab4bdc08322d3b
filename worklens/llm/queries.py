"""Registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm import decontaminate, edit_counts, licenses, lm, near_dedup, packing, periodic, prefix_trie, quality, secrets, sharding, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op2_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored_texts(_table(spark, sf_dir, "documents"))


def op3_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(_table(spark, sf_dir, "documents"), shards=40)


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(topk.integer_vectors(_table(spark, sf_dir, "embeddings")), k=20, every=20)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_edited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document gets a tag in its middle, its source in front, and loses its last characters."""
    n = F.length("text")
    edit = lambda start, end, text: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"))
    edits = F.array(
        edit(F.expr("length(text) div 2"), F.expr("length(text) div 2 + 40"), F.concat_ws(":", F.lit(" ["), "lang", "source")),
        edit(F.lit(0), F.lit(0), F.concat(F.coalesce("source", F.lit("")), F.lit(" "))),
        edit(n - 25, n, F.lit("")),
    )
    return edit_counts.counted(_table(spark, sf_dir, "documents").withColumn("edits", edits))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"),
    )


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.word_counts(_table(spark, sf_dir, "documents")))


def op11_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_spans(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.col("base")["start"]).alias("first_word"), F.array_max(F.col("base")["start"]).alias("last_word"),
        licenses.labels_of("base").alias("base_labels"), licenses.labels_of("base", "found").alias("labels"), licenses.score_of("found").alias("score"),
    )


def _repeated(texts: pd.Series, hashes: pd.Series) -> pd.Series:
    """Texts that from one word on repeat a few of their words; where and how many follows from a hash. NULL texts stay."""

    def one(text: str | None, h: int) -> str | None:
        words = text.encode().split() if text is not None else []
        if not words:
            return text
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(words[:a] + (words[a : a + p] * (n // p + 1))[: n - a]).decode()

    return pd.Series([one(t, h) for t, h in zip(texts, hashes, strict=True)], dtype=object)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document by hash first gets a tail that repeats some of its words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    repeated = F.pandas_udf(_repeated, "string")
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(repeated(F.when(h % 10 == 0, F.col("text")), F.coalesce(h, F.lit(0))), "text").alias("text"))
    found = periodic.periodic_runs(docs)
    best, line = F.col("strongest"), lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations begin with up to three turns of another one of their twenty, chosen by a hash."""
    own = prefix_trie.paths(_table(spark, sf_dir, "conversations"))
    heads = own.where("conv_id % 20 = 0").select(F.col("conv_id").alias("family"), F.slice("path", 1, 3).alias("head"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    joined = own.withColumns({"family": F.expr("conv_id - conv_id % 20"), "shared": shared}).join(heads, "family", "left")
    rest = F.expr("slice(path, shared + 1, size(path))")
    return prefix_trie.prefix_trie(joined.select("conv_id", F.concat(F.coalesce(F.expr("slice(head, 1, shared)"), F.expr("slice(path, 1, 0)")), rest).alias("path")))


#: Words of a text, in SQL: A-Z as a-z, parted by blank, tab, line feed, vertical tab, form feed, return.
_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 2 THEN [words[1]]
    ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
held AS (SELECT shingle, list(doc_id ORDER BY doc_id) AS ids FROM s GROUP BY 1 HAVING count(*) > 1),
pairs AS (
  SELECT a, b, count(*) AS shared FROM (
    SELECT a, unnest(later) AS b FROM (
      SELECT unnest(ids) AS a, unnest(list_transform(range(1, len(ids) + 1), lambda i: ids[i + 1:])) AS later FROM held))
  GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS other FROM w UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM w d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(other) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""

_OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

def _sql_spans(kind: int, pattern: str, keep: str = "true") -> str:
    """Spans as structs, from matches taken with the gap before each; ``keep`` may name m (match) and v (second group)."""
    whole = "(?s:(.*?))(" + pattern.replace("'", "''") + ")"
    part = lambda group: f"regexp_extract_all(text, '{whole}', {group})"
    total = lambda c: f"coalesce(list_sum(list_transform({c}, lambda x: length(x))), 0)"
    return f"""list_transform(list_filter(list_transform(range(1, len({part(2)}) + 1), lambda i: {{'m': {part(2)}[i], 'v': {part(4)}[i],
      'a': ({total(f"{part(1)}[1:i]")} + {total(f"{part(2)}[1:i-1]")})::INT}}), lambda s: {keep}), lambda s: {{'start': s.a, 'kind': {kind}, 'end': (s.a + length(s.m))::INT}})"""


#: CRC-32 of a number's decimal digits, in SQL, over a joined ``crc_table`` of 256 entries.
_CRC_TABLE = "range(256)"
for _ in range(8):
    _CRC_TABLE = f"list_transform({_CRC_TABLE}, lambda x: xor(x >> 1, 3988292384 * (x & 1)))"


def _sql_crc(column: str) -> str:
    digits = f"list_transform(string_split({column}::VARCHAR, ''), lambda d: ascii(d)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, d: xor(c >> 8, crc_table.t[(xor(c, d) & 255) + 1])), 4294967295)"


_OP12 = f"""
WITH crc_table AS (SELECT {_CRC_TABLE} AS t),
d AS (SELECT doc_id, {_sql_crc("doc_id")} AS h, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents, crc_table),
p AS (SELECT *, len(words) AS n, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a FROM d),
r AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i:
    words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE words END AS words FROM p),
w AS (SELECT doc_id, n, unnest(words) AS word, unnest(range(0, n)) AS i FROM r),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND (y.i - x.i) * 4 <= x.n),
island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM same),
stretch AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM island GROUP BY doc_id, q, part HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY 1, 2, 3),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    arg_min({{'s': start, 'l': length, 'p': period}}, {{'x': -length::DOUBLE / period, 's': start, 'p': period}}) AS best FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT w.doc_id, w.i FROM w JOIN runs r ON r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT r.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, (1000 * best.l) // best.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM r LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_OP13 = f"""
WITH crc_table AS (SELECT {_CRC_TABLE} AS t),
own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (SELECT own.*, {_sql_crc("conv_id")} % 4 AS h FROM own, crc_table),
built AS (SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS path FROM hashed o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
reach AS (SELECT conv_id, len(path) AS n, unnest(range(0, len(path) + 1)) AS depth, path FROM built),
nodes AS (SELECT path[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM reach GROUP BY 1, 2),
inner_nodes AS (SELECT n.*, count(c.depth) AS n_children, (n.n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE len(regexp_extract_all(n.p[n.depth].t, '[^\x20\x09-\x0D]+')) END AS saved
  FROM nodes n LEFT JOIN nodes c ON c.depth = n.depth + 1 AND c.p[1:n.depth] = n.p GROUP BY ALL),
up AS (SELECT p, n_children, saved, unnest(range(0, depth + 1)) AS above FROM inner_nodes),
under AS (SELECT p[1:above] AS p, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY 1)
SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, n.n_children, u.n_leaves, u.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM inner_nodes n JOIN under u ON u.p = n.p LEFT JOIN nodes a ON a.depth = n.depth - 1 AND a.p = n.p[1:n.depth - 1]
"""

_KIND_NAMES = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
_WRITTEN = lambda c: f"array_to_string(list_transform(list_sort({c}), lambda s: {_KIND_NAMES}[s.kind + 1] || ':' || s.start || ':' || s.\"end\"), ',')"
_MIXED = "regexp_matches(s.m, '[a-z]') AND regexp_matches(s.m, '[A-Z]') AND regexp_matches(s.m, '[0-9][^0-9]*[0-9][^0-9]*[0-9]')"
_OP9 = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
base AS (SELECT row, doc_id, text, {_sql_spans(0, secrets.ASSIGN, "length(s.v) >= 8")} || {_sql_spans(1, secrets.ACCESS, "length(s.m) >= 16")} || {_sql_spans(2, secrets.HEX)} AS base FROM t),
weak AS (SELECT *, list_filter({_sql_spans(3, secrets.LOGIN)} || {_sql_spans(4, secrets.TOKEN, _MIXED)} || {_sql_spans(5, secrets.ENDPOINT)},
  lambda w: len(list_filter(base, lambda b: b.start < w."end" AND w.start < b."end")) = 0) AS weak FROM base),
linked AS (SELECT *, list_filter(weak, lambda w: len(list_filter(base || weak, lambda o: (w.kind IN (0, 2, 4)) <> (o.kind IN (0, 2, 4))
  AND greatest(w.start, o.start) - least(w."end", o."end") <= {secrets.SCOPE})) > 0) AS added FROM weak)
SELECT doc_id, len(list_filter(base, lambda s: s.kind = 0))::BIGINT AS n_assign, len(list_filter(base, lambda s: s.kind = 1))::BIGINT AS n_access,
  len(list_filter(base, lambda s: s.kind = 2))::BIGINT AS n_hex, sha256({_WRITTEN("base")}) AS base_sha256, {_WRITTEN("base || added")} AS spans FROM linked
"""

QUERIES = {
    f.__name__: f for f in (op1_minhash_near_dedup, op2_attention_scores, op3_balanced_shards, op4_pairwise_quality, op5_exact_top_k, op6_toxicity, op7_edited_counts, op8_decontaminate, op9_linked_secrets, op10_best_fit,
        op11_license_rules, op12_periodic_runs, op13_prefix_trie)
}
ORACLE = {"op1_minhash_near_dedup": _OP1, "op5_exact_top_k": _OP5, "op9_linked_secrets": _OP9, "op12_periodic_runs": _OP12, "op13_prefix_trie": _OP13}
