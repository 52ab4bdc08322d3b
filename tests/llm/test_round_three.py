"""License rules, periodic runs and the prefix trie: against brute force on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import odd_rows
from worklens.llm import decontaminate, licenses, periodic, prefix_trie, queries
from worklens.llm.license_rules import BASE_RULES, RULES

# --- license rules ---

TEXTS = [
    "Released under the MIT License. Licensed under the Apache License, Version 2.0 (the \"License\")", "CC-BY-NC 4.0 and cc by nc", "under the mit license under the mit license",
    "SPDX-License-Identifier: GPL-3.0-or-later", "licensed under CC BY-NC-SA 4.0", "licensed under CC BY 4.0, all rights reserved", "submit license", "underé the mit license",
    "GNU Lesser General Public License v2.1 or later; see the LICENSE file", "this is free and unencumbered software released into the public domain", "unter der MIT-Lizenz",
    "Copyright (c) 2020 Someone. All rights reserved. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "open rail-m, BSD 3-Clause license, MPL-2.0", "mit", None, "", " \t",
]
PHRASES = {"mit": ["under", "the", "mit", "license"], "apache-2": ["apache", "license", "version", "2"], "cc-by-nc": ["cc", "by", "nc"]}


def plain_words(text):
    low = (text or "").encode().lower() if text is None or text.isascii() else "".join(c.lower() if c.isascii() else c for c in text).encode()
    return [w.decode("latin-1") for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def by_all_rules(words):
    """Detections without keywords or roots, overlaps resolved pair by pair."""
    text, found = " " + " ".join(words) + " ", []
    for rule in RULES:
        for m in rule.regex.finditer(text):
            low = text[: m.start()].count(" ") - 1
            found.append((low, low + len(m.group().split(" ")), rule))
    return sorted((d for d in found if not any(o[2].order < d[2].order and o[0] <= d[0] and d[1] <= o[1] or o is not d and o[2] is d[2] and o[0] <= d[0] and d[1] <= o[1] for o in found)), key=lambda d: (d[0], d[1], d[2].order))


def test_license_spans(spark, odd, nothing):
    docs = spark.createDataFrame([(i, t, 0.1) for i, t in enumerate(TEXTS)] + [(None, "cc by nc", 0.0), (1, "x", 0.0)], "doc_id long, text string, found double").repartition(3)
    got = {(r.doc_id, r.n_words): r for r in licenses.license_spans(docs).collect()}
    assert len(got) == len(TEXTS) + 2 and got[None, 3].found[0].label == "cc-by-nc"
    for i, text in enumerate(TEXTS):
        words = plain_words(text)
        r = got[i, len(words)]
        base = sorted((k, label) for label, p in PHRASES.items() for k in range(len(words)) if words[k : k + len(p)] == p)
        assert [(s.start, s.label) for s in r.base] == base
        assert [(s.start, s.stop, s.label) for s in r.found] == [(a, b, rule.label) for a, b, rule in by_all_rules(words)]
        assert {label for _, label in base} <= {s.label for s in r.found}
    assert got[5, 9].found[-1].label == "all-rights-reserved" and "cc-by" in {s.label for s in got[5, 9].found} and "cc-by" not in {s.label for s in got[4, 8].found}
    assert licenses.license_spans(nothing).collect() == [] and len(licenses.license_spans(odd).collect()) == len(odd_rows())


def test_there_are_hundreds_of_rules_in_order():
    assert len(RULES) > 200 and [r.order for r in RULES] == list(range(len(RULES))) and RULES[:3] == BASE_RULES
    assert all(0 < r.confidence <= 1 and "," not in r.label for r in RULES)


@settings(max_examples=600, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_every_match_holds_its_keyword(data):
    rule = data.draw(st.sampled_from(RULES))
    body = rule.regex.pattern.removeprefix("(?<= )").removesuffix("(?= )")
    assert rule.keyword in data.draw(st.from_regex(re.compile(body, re.ASCII), fullmatch=True, alphabet="abcdefghijklmnopqrstuvwxyz0123456789 "))


def test_containment_by_priority():
    r = random.Random(3)
    for _ in range(200):
        found = [(a, a + r.randint(1, 6), RULES[r.randrange(12)]) for a in (r.randrange(20) for _ in range(r.randrange(15)))]
        found = list({(a, b, rule.order): (a, b, rule) for a, b, rule in found}.values())
        within = lambda d, o: o[0] <= d[0] and d[1] <= o[1]
        want = [d for d in found if not any(within(d, o) and (o[2].order < d[2].order or o[2] is d[2] and o is not d) for o in found)]
        assert licenses.unsuppressed(found) == sorted(want, key=lambda d: (d[0], d[1], d[2].order))


def test_a_very_long_text_of_licenses(spark):
    text = "word under the MIT License, " * 120_000 + "cc-by-nc"
    r = licenses.license_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).selectExpr("n_words", "size(base) AS n", "base[size(base) - 1].start AS last").first()
    assert (r.n_words, r.n, r["last"]) == (600_003, 120_001, 600_000)


# --- periodic runs ---


def all_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                s = w[i : i + length]
                if next(p for p in range(1, q + 1) if all(s[x] == s[x + p] for x in range(length - p))) == q:
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeating(r):
    words = []
    while len(words) < r.choice([0, 5, 30, 200, 400]):
        if r.random() < 0.4:
            base = [r.choice(["a", "A", "b", "cé", "d."]) if r.random() < 0.7 else str(r.randrange(99)) for _ in range(r.choice([1, 2, 3, 5, 17, 20, 33]))]
            words += [base[i % len(base)] for i in range(r.randrange(len(base) * 3, len(base) * 7 + 3))]
        else:
            words += [r.choice("abcd") for _ in range(r.randrange(1, 9))]
    return r.choice([" ", "\n", "  \t", "\x0b"]).join(words)


def test_periodic_runs_match_brute_force(spark, odd, nothing):
    r = random.Random(8)
    texts = [repeating(r) for _ in range(150)] + [None, "", " \r\n", "a a a a a", "a a a a a a", "ab " * 12, "x a b a b a b a b y", "a\x1ca " * 9]
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(None, "b " * 7, [1])], "doc_id long, text string, runs array<int>").repartition(4)
    got = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    for i, text in [*enumerate(texts), (None, "b " * 7)]:
        words = (text or "").encode().split()
        runs = all_runs(words)
        row = got[i]
        assert row.n_words == len(words) and [(s.start, s.length, s.period) for s in row.runs] == runs
        best = max(runs, key=lambda s: (s[1] / s[2], -s[0], -s[2]), default=None)
        assert (None if row.strongest is None else tuple(row.strongest)) == best
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert row.collapsed == b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
    assert periodic.periodic_runs(nothing).collect() == [] and len(periodic.periodic_runs(odd).collect()) == len(odd_rows())


def test_frequency_splitting_leaves_what_may_repeat():
    w = np.array([1, 2] * 6 + [3] + [4, 5, 4, 5, 4, 5] + [6] * 5 + [7, 8, 9] + [1, 2] * 4)
    assert periodic.segments(w, np.zeros(len(w), np.int64)) == [(0, 12), (27, 35)]
    assert periodic.segments(np.zeros(0, np.int64), np.zeros(0, np.int64)) == []
    # Words of two texts are never counted together.
    assert periodic.segments(np.ones(8, np.int64), np.repeat([0, 1], 4)) == []


@pytest.mark.parametrize("words,runs", [(["a"] * 300_000, 1), (["a", "b", "c"] * 100_000, 1), ([str(i % 20_000) for i in range(200_000)], 1)])
def test_very_long_texts_end_soon(words, runs):
    data, offsets = np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(" ".join(words))])
    starts, ends, bounds = periodic.split_words(data, offsets)
    ids = periodic.word_ids(data, starts, ends)
    assert [periodic.runs_of(ids[a:b]) for a, b in periodic.segments(ids, np.zeros(len(ids), np.int64))] == [[(0, len(words), len(set(words)))]] and runs == 1


def test_repeated_tails():
    import pandas as pd

    texts = ["a b c d e f g h i j", "", None, " x\ty "]
    for h in (10, 20, 70, 4_294_967_290):
        for text, got in zip(texts, queries._repeated(pd.Series(texts), pd.Series([h] * 4)), strict=True):
            w = (text or "").split()
            if not w:
                assert got == text
                continue
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert got == " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))


# --- prefix trie ---


def brute_trie(paths):
    members, children = defaultdict(list), defaultdict(set)
    for c, p in paths:
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append((c, len(p)))
    for k in members:
        if k:
            children[k[:-1]].add(k)

    def under(k):
        leaves, saved = 0 if children[k] else 1, (len(members[k]) - 1) * (k[-1][2] if k else 0)
        for x in children[k]:
            a, b = under(x)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, n in m if n == len(k)))
        out.append((min(m)[0], len(k), min(members[k[:-1]])[0] if k else None, len(m), len(children[k]), *under(k), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def as_frame(spark, paths):
    rows = [(c, [{"a": a, "b": b, "w": w} for a, b, w in p], "clash") for c, p in paths]
    return spark.createDataFrame(rows, "conv_id long, path array<struct<a:long,b:long,w:long>>, depth string").repartition(3)


@pytest.mark.parametrize("n,copies,deep", [(0, 0, 3), (1, 0, 0), (60, 150, 7), (250, 0, 5), (12, 0, 60)])
def test_prefix_trie_matches_brute_force(spark, n, copies, deep):
    r = random.Random(n)
    pool = [(r.randrange(-9, 9), r.randrange(-9, 9), r.randrange(5)) for _ in range(4)]
    paths = [(c, [r.choice(pool) for _ in range(r.randint(0, deep))]) for c in r.sample(range(-500, 2000), n)] + [(5000 + i, [pool[0], pool[1]]) for i in range(copies)]
    for cells in (prefix_trie.CELLS, 40):  # small slices leave many nodes open, on several levels
        assert sorted(map(tuple, prefix_trie.prefix_trie(as_frame(spark, paths), cells).collect()), key=str) == brute_trie(paths)


def test_slices_end_where_a_matrix_would_grow_too_large():
    rows = [[1] * n for n in (2, 2, 30, 1, 1, 1, 1, 1, 1, 1, 1, 1)]
    batch = pa.RecordBatch.from_pydict({"a": pa.array(rows, pa.list_(pa.int64()))})
    sizes = [t.num_rows for t in prefix_trie._slices(iter([batch.slice(0, 5), batch.slice(5)]), False, 40)]
    assert sizes == [8, 4] and [t.num_rows for t in prefix_trie._slices(iter([batch]), True, 40)] == [12]


def test_paths_of_odd_turns(spark):
    schema = "conv_id long, turn long, role string, text string, path string"
    rows = [(1, 1, "user", "b c", "x"), (1, None, None, None, "x"), (1, 0, "user", "a", "x"), (2, 0, "user", "a", "x"), (2, 0, "user", "a", "x"), (None, 0, "user", "z", "x"), (3, 5, "", "", "x"), (4, 0, "us", "era", "x")]
    got = {r.conv_id: [(t.a, t.b, t.w) for t in r.path] for r in prefix_trie.paths(spark.createDataFrame(rows, schema)).collect()}
    assert sorted(got) == [1, 2, 3, 4] and [w for _, _, w in got[1]] == [0, 1, 2]
    assert got[1][0] == got[3][0] and got[1][1] == got[2][0] == got[2][1] and got[4][0][:2] != got[2][0][:2]
    assert prefix_trie.prefix_trie(prefix_trie.paths(spark.createDataFrame([], schema))).collect() == []


def test_rebuilt_conversations(spark, tmp_path):
    r = random.Random(6)
    turns = {c: [("user" if i % 2 else "bot", r.choice(["a", "b b", ""])) for i in range(r.randint(1, 5))] for c in [*range(45), 61] if c != 20}
    rows = [(c, i, *t) for c, ts in turns.items() for i, t in enumerate(ts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    paths = []
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths.append((c, [(*t, len(t[1].split())) for t in turns.get(c - c % 20, [])[:h] + own[h:]]))
    got = sorted(map(tuple, queries.op13_prefix_trie(spark, str(tmp_path)).collect()), key=str)
    assert got == brute_trie(paths) and Counter(d for _, d, *_ in got)[0] == 1


def test_equal_texts_get_equal_licenses_and_runs(odd):
    """Repeated rows come back once each, with the same result."""
    for found, column in ((licenses.license_spans(odd), "found"), (periodic.periodic_runs(odd), "runs")):
        rows = [tuple(r) for r in found.where("doc_id = 4").select(F.col(column).cast("string")).collect()]
        assert len(rows) == 2 and rows[0] == rows[1]


def test_short_benchmark_items_are_sought(spark):
    docs = spark.createDataFrame([(1, "Alpha beta  gamma"), (2, "x"), (3, None), (None, "beta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "beta"), (2, "alpha BETA"), (3, ""), (4, "beta alpha"), (5, None), (None, "x")], "item_id long, text string")
    found = lambda least: {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, least_words=least).collect()}
    assert found(1) == {(1, 1), (1, 2)} and found(2) == {(1, 2)}
