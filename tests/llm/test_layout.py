"""Sharding, packing, top-k search and the pipeline: laws that every result keeps."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import odd_rows, prose
from worklens.llm import packing, queries, sharding, topk

SF = "/root/testdata/sf0.001"


def test_shards(spark, odd, nothing):
    got = sharding.balanced_shards(odd, shards=3, block_groups=4).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows())
    homes, slots = defaultdict(set), defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        if r.text_crc32 is not None:
            homes[r.text_crc32].add(r.shard)
    assert all(len(h) == 1 for h in homes.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(r.size for r in got) == sum(len((r[1] or "").encode()) + 16 for r in odd_rows())
    assert sharding.balanced_shards(nothing).collect() == []


def test_shards_are_near_equal(spark):
    docs = spark.createDataFrame([(i, "x" * (10 + i * i % 997)) for i in range(3000)], "doc_id long, text string")
    loads = Counter()
    for r in sharding.balanced_shards(docs, shards=7, block_groups=300).collect():
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) <= 0.01 * sum(loads.values()) / 7
    assert sharding.longest_first([3, 9, 9, 1], [0.0, 5.0]) == [0, 0, 1, 0]


def test_packing(spark, odd, nothing):
    lengths = packing.word_counts(odd)
    expected = Counter((r[0], len((r[1] or "").encode().split()) + 1) for r in odd_rows())
    assert Counter((r.doc_id, r.n_tokens) for r in lengths.collect()) == expected
    pieces = packing.packed(lengths, capacities=(64, 128, 512), block_pieces=4).collect()
    assert sum(p.n_tokens for p in pieces) == sum(n * c for (_, n), c in expected.items())
    bins = defaultdict(list)
    for p in pieces:
        bins[p.bin_id].append(p)
    for held in bins.values():
        at = 0
        for p in sorted(held, key=lambda p: p.place):
            assert p.place == at
            at += p.n_tokens
        assert held[0].capacity == min(c for c in (64, 128, 512) if c >= at)
    cover = defaultdict(list)
    for p in pieces:
        cover[p.doc_id].append((p.start, p.start + p.n_tokens))
    for spans in (sorted(s) for i, s in cover.items() if i not in (None, 4)):
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert packing.packed(packing.word_counts(nothing)).collect() == []
    odd_lengths = spark.createDataFrame([(1, None), (2, 0), (3, 4096)], "doc_id long, n_tokens long")
    assert [r.doc_id for r in packing.packed(odd_lengths).collect()] == [3]


def test_best_fit_opens_cheap_bins_and_shrinks_them():
    home, place, final = packing.best_fit([300, 200, 12], (64, 512, 4096), 16)
    assert (home, place, final) == ([0, 0, 0], [0, 300, 500], [512])
    assert packing.best_fit([40], (64, 512), 0)[2] == [64] and packing.best_fit([], (64,), 0) == ([], [], [])
    r = random.Random(1)
    sizes = sorted((r.randint(1, 512) for _ in range(500)), reverse=True)
    assert sum(packing.best_fit(sizes, (64, 128, 256, 512), 4)[2]) < 1.02 * sum(sizes) + 512


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "SLICE", 4)
    monkeypatch.setattr(topk, "BLOCK", 8)
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(150)] + [(i, [0.5, -0.25, 0.1, 0.0, 0.9, -1.0]) for i in range(150, 260)]
    rows += [(300, None), (320, [None] * 6), (340, [float("nan")] * 6), (360, [float("inf")] * 6), (None, [0.1] * 6), (380, [1.0]), (381, []), (20, rows[20][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("v", F.lit(0)).repartition(5)
    got = topk.exact_top_k(topk.integer_vectors(frame), k=7, every=20)
    con = duckdb.connect()
    con.register("embeddings", frame.select("vec_id", "embedding").where("vec_id is not null").dropDuplicates(["vec_id"]).toPandas())
    whole = {i: v for i, v in ((i, v) for i, v in rows if i is not None and v is not None and all(x is not None and abs(x) < 9 for x in v))}
    import numpy as np

    q = {i: np.floor(64 * np.array(list(np.float32(v)) + [0.0] * (6 - len(v)), dtype=float)) for i, v in whole.items()}
    expected = []
    for i in q:
        if i % 20 == 0:
            best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:7]
            expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == sorted(expected)
    assert topk.exact_top_k(topk.integer_vectors(frame.limit(0))).collect() == []


def test_large_components_stay_exact(spark):
    rows = [(0, [3_000_000_017, 5]), (1, [3_000_000_019, 7]), (2, [-1, 10**12])]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), k=2).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 3_000_000_017 * 3_000_000_019 + 35), (2, 5 * 10**12 - 3_000_000_017)]


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, prose(120, 2))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = Counter(r.doc_id for r in docs.select("doc_id").collect())
        if name == "near_dedup":
            assert ids[1] == 1 and not {2, 3, 12} & set(ids) and ids[4] == 1 and ids[None] == 2 and {5, 6, 7, 8, 14} <= set(ids) and 9 not in ids
        if name == "decontaminate":
            assert 4 not in ids and 1 in ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    # A text longer than a sequence lies in several; no token is lost.
    assert {i for r in packed for i in r.doc_ids} == set(ids)
    assert sum(r.n_tokens for r in packed) == sum(len((r.text or "").encode().split()) + 1 for r in docs.collect())
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_runs_over_documents(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    held = {i for r in rows for i in r.doc_ids}
    total = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.6 * total < len(held) < total and all(r.n_tokens <= r.capacity for r in rows)


def test_registered_queries(spark):
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.ORACLE) <= set(queries.QUERIES)
