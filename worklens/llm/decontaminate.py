"""Benchmark decontamination by spaced seeds, in DataFrame operations alone.

A mask names the positions of a short word window that count; the others may
be substituted. Windows of the texts and of the benchmark that agree under a mask are
hits; around a hit the two texts are laid side by side, and it stands
when some run of ``overlap`` item words (the whole item, if shorter) agrees in
``percent`` of its places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.session import checkpoint, small

#: Any 10 words with 2 substituted, and any 8 or 9 with 1, have a window of one of these masks that is intact.
MASKS = ("11011", "1101001")
OVERLAP, PERCENT = 10, 80
#: Items of fewer words must occur whole.
WHOLE = 8


def hashed_words(text: Column) -> Column:
    """Hashes of a text's words, A-Z as a-z; NULL gives none."""
    plain = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.split(plain, r"[\x20\x09-\x0D]+")
    return F.transform(F.filter(words, lambda w: w != F.lit("")), lambda w: F.xxhash64(w))


def _windows(mask: str, salt: int) -> Column:
    """For column ``h``: the hash of each window under ``mask``; none for a shorter text."""
    keep = [k for k, c in enumerate(mask) if c == "1"]
    at = lambda i, k: F.get(F.col("h"), i + F.lit(k))
    each = F.transform(F.sequence(F.lit(0), F.size("h") - F.lit(len(mask))), lambda i: F.xxhash64(F.lit(salt), *[at(i, k) for k in keep]))
    return F.when(F.size("h") >= len(mask), each).otherwise(F.array().cast("array<long>"))


def _seeds(rows: DataFrame, masks: tuple[str, ...], *keys: str) -> DataFrame:
    """(keys, at, seed): every window of ``h`` under every mask."""
    out = None
    for k, mask in enumerate(masks):
        one = rows.select(*keys, F.posexplode(_windows(mask, k)).alias("at", "seed"))
        out = one if out is None else out.unionByName(one)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, overlap: int = OVERLAP, percent: int = PERCENT, least_words: int = 1) -> DataFrame:
    """Overlaps of ``docs`` (doc_id, text) with ``benchmark`` (item_id, text): doc_id, item_id, start, n_same, n_words.

    One row per document and item: the alignment with most agreeing words,
    ``start`` being the word of the document that lies at the item's first word
    (negative where the item's beginning is missing). Items of fewer than WHOLE words must occur
    whole; those of fewer than ``least_words`` aren't sought (all are, by default). NULL and empty texts, and items without
    words, match nothing; texts and items are taken whole at any length; rows without an id are ignored; repeated rows count
    once; without texts or items there are no rows. Other columns are ignored.
    """
    items = benchmark.where("item_id is not null").select("item_id", hashed_words(F.col("text")).alias("h")).where(F.size("h") >= max(1, least_words)).distinct()
    items = checkpoint(items)
    short = [r[0] for r in items.where(F.size("h") < WHOLE).select(F.size("h")).distinct().collect()]  # these must occur whole
    patterns = (*masks, *["1" * n for n in sorted(short)])
    tests = _seeds(items.where(F.size("h") >= WHOLE), masks, "item_id")
    for k, p in enumerate(patterns[len(masks) :], len(masks)):
        tests = tests.unionByName(items.where(F.size("h") == len(p)).select("item_id", F.posexplode(_windows(p, k)).alias("at", "seed")))
    tests = small(checkpoint(tests.withColumnRenamed("at", "item_at").distinct()))
    texts = docs.where("doc_id is not null").select("doc_id", hashed_words(F.col("text")).alias("h"))
    joined = F.concat(*[_windows(p, k) for k, p in enumerate(patterns)])
    windows = texts.select("doc_id", F.size("h").alias("n"), F.posexplode(joined).alias("at", "seed"))
    hits = windows.join(tests, "seed")
    # The place within its own mask: what the masks before it take is known from the number of words.
    at, before = F.col("at"), F.lit(0)
    place = at
    for p in patterns[:-1]:
        before = before + F.greatest(F.lit(0), F.col("n") - F.lit(len(p) - 1))
        place = F.when(at >= before, at - before).otherwise(place)
    hits = checkpoint(hits.select("doc_id", "item_id", (place - F.col("item_at")).alias("start")).distinct())
    named = small(checkpoint(hits.select("doc_id").distinct()))
    sides = hits.join(texts.join(named, "doc_id", "left_semi"), "doc_id").join(small(items.withColumnRenamed("h", "g")), "item_id")
    low, high = F.greatest(F.lit(0), -F.col("start")), F.least(F.size("g"), F.size("h") - F.col("start"))
    same = F.transform(F.sequence(low, high - 1), lambda j: (F.get("h", j + F.col("start")) == F.get("g", j)).cast("int"))
    judged = sides.where(high > low).select("doc_id", "item_id", "start", F.size("g").alias("n_words"), same.alias("same"))
    run = F.when(F.col("n_words") < WHOLE, F.col("n_words")).otherwise(F.least(F.col("n_words"), F.lit(overlap)))
    need = F.when(F.col("n_words") < WHOLE, F.col("n_words")).otherwise(F.ceil(run * percent / 100).cast("int"))
    total = lambda i: F.aggregate(F.slice("same", i + 1, run), F.lit(0), lambda s, x: s + x)
    stands = F.exists(F.sequence(F.lit(0), F.size("same") - run), lambda i: total(i) >= need)
    judged = judged.where(F.size("same") >= run).where(stands)
    n_same = F.aggregate("same", F.lit(0), lambda s, x: s + x)
    best = judged.groupBy("doc_id", "item_id", "n_words").agg(F.max(F.struct(n_same.alias("n_same"), (-F.col("start")).alias("back"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.back")).alias("start"), F.col("b.n_same").alias("n_same"), "n_words")
