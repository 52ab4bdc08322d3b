"""Scores and counts: base statistics by brute force, probabilities that sum to one, held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import odd_rows
from worklens.llm import edit_counts, lm, quality, tokens, toxicity
from worklens.llm.attention import CLASS, SPAN, Pairs, Scorer, Trainer, fresh

SF = "/root/testdata/sf0.01"


def _words(text):
    return (text or "").encode().lower().split()


def _fold(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def test_language_model_statistics(spark, odd, nothing):
    rows = odd_rows()
    training = [_words(r[1]) for r in rows if r[0] is not None and _fold(r[0], 5) != 1]
    counts = Counter(w for t in training for w in t) + Counter({None: len(training)})
    n, v = sum(counts.values()), len(counts)
    got = lm.scored_texts(odd).collect()
    assert len(got) == len(rows)
    expected = Counter()
    for r in rows:
        t = [*_words(r[1]), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        expected[(r[0], r[0] is None or _fold(r[0], 5) == 1, len(t), sum(counts[w] > 0 for w in t), n, round(base, 5))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.scored_texts(nothing).collect() == []


def test_attention_scores_each_subword_once_and_sums_to_one():
    size, random_ = 3 * CLASS, np.random.default_rng(1)
    chances = random_.random((size, size))
    pairs = Pairs(chances / chances.sum(1, keepdims=True))
    p = fresh(size)
    for k in ("r", "c", "i"):
        p[k] = random_.normal(0, 0.3, p[k].shape).astype(np.float32)
    scorer = Scorer(p, pairs, 1)
    ids = random_.integers(0, size, 90)
    starts = np.array([0, 1, 40])
    before = np.append(0, ids[:-1])
    before[starts] = 0
    of, begin = scorer(ids, before, starts)
    assert of.shape == begin.shape == (90,) and ((of > 0) & (of < 1) & (begin > 0) & (begin < 1)).all()
    # All subwords in the place of one: their chances sum to 1, and those of the first class to that of a beginning.
    for at in (0, 1, 39, 57, 89):
        total = []
        for k in range(size):
            other = ids.copy()
            other[at] = k
            total.append(scorer(other, before, starts)[0][at])
        assert sum(total) == pytest.approx(1, abs=1e-4) and sum(total[:CLASS]) == pytest.approx(begin[at], abs=1e-4)
    # What stands behind has no influence.
    other = before.copy()
    other[60:] = 5
    assert np.allclose(scorer(ids, other, starts)[0][:60], of[:60])


def test_every_scored_subword_sees_sixteen_before_it():
    size, random_ = 3 * CLASS, np.random.default_rng(4)
    chances = random_.random((size, size))
    p = fresh(size)
    for k in ("v", "c", "i"):
        p[k] = random_.normal(0, 1, p[k].shape).astype(np.float32)
    scorer = Scorer(p, Pairs(chances / chances.sum(1, keepdims=True)), 1)
    ids = random_.integers(0, size, 64)
    before, other = np.append(0, ids[:-1]), np.append(0, ids[:-1])
    other[16] = (other[16] + 1) % size
    a, b = (scorer(ids, x, np.array([0]))[0] for x in (before, other))
    assert (a[16:33] != b[16:33]).all()


def test_attention_gradients():
    size, random_ = 2 * CLASS, np.random.default_rng(3)
    pairs = Pairs(np.full((size, size), 1 / size))
    p = {k: v.astype(np.float64) + random_.normal(0, 0.2, v.shape) for k, v in fresh(size).items()}
    windows = random_.integers(0, size, (4, SPAN + 1))
    trainer = Trainer(p, pairs, 0.0)
    trainer.first = {k: np.zeros(v.shape) for k, v in p.items()}
    trainer.step(windows)
    for k in p:
        at = np.unravel_index(np.abs(trainer.first[k]).argmax(), p[k].shape)
        ends = []
        for sign in (1, -1):
            q = {n: v.copy() for n, v in p.items()}
            q[k][at] += sign * 1e-3
            ends.append(Trainer(q, pairs, 0.0).step(windows))
        assert 10 * trainer.first[k][at] == pytest.approx((ends[0] - ends[1]) / 2e-3, rel=0.02, abs=1e-5), k


def _auc(y, s):
    ranks = np.argsort(np.argsort(s))
    return (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize("operator, name, modulus, held", [(quality.quality_scores, "quality", 5, 0), (toxicity.toxicity_scores, "toxic", 4, 2)])
def test_classifiers(spark, odd, nothing, labels, operator, name, modulus, held):
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = operator(docs, marks).join(marks, "doc_id").toPandas()
    out = scored[scored.held_out]
    assert all(scored.held_out == [_fold(i, modulus) == held for i in scored.doc_id])
    assert _auc(out[name].to_numpy(), out.score.to_numpy()) > (0.97 if name == "quality" else 0.7)
    got = operator(odd, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert operator(nothing, labels).collect() == []
    assert len({r.score for r in operator(odd, labels.limit(0)).collect()}) == 1


def test_factors_learn_what_weights_cannot(spark):
    random_ = random.Random(1)
    rows, y = [], []
    for _ in range(800):
        a, b = random_.random() < 0.5, random_.random() < 0.5
        rows.append(np.unique([random_.randrange(10, 60) for _ in range(8)] + [1] * a + [2] * b))
        y.append(float(a != b))
    model = toxicity.fit(rows, np.array(y), np.arange(60))
    one = lambda *t: model.bias + model.weights[list(t)].sum() + 0.5 * ((model.vectors[list(t)].sum(0) ** 2 - (model.vectors[list(t)] ** 2).sum(0)).sum())
    cut = np.log(0.3 / 0.7)
    assert one(1) > cut > one(1, 2) and one(2) > cut > one()
    assert toxicity.best_cut(np.array([0.0, 1.0, 4.0, 6.0]), np.array([0.0, 0.0, 1.0, 1.0])) == 2.5


def test_quality_features_take_whole_texts():
    long = "word " * 50_000
    x = quality.features(pa.array([long + "|" * 50_000, long, None, "", " \n"]))
    assert x[0][quality.FEATURES.index("bars")] > 0.9 and x[1][quality.FEATURES.index("bars")] == 0 and not x[2:].any()


def test_edited_counts(spark, odd, nothing):
    encode = tokens.encoding().encode_ordinary
    edits = [(1, 0, 5, 9, "new words"), (1, 1, 0, 0, "'re "), (4, 0, 3, 10**6, ""), (5, 0, 0, 0, "some text"), (11, 0, 40_000, 40_010, "  "), (11, 1, None, None, None), (99, 0, 0, 1, "none")]
    table = spark.createDataFrame(edits, "doc_id long, seq int, start int, end int, text string")
    got = edit_counts.edited_counts(odd, table).collect()
    assert len(got) == len(odd_rows())
    texts = {r[0]: r[1] or "" for r in odd_rows()}
    for r in got:
        if r.doc_id is None:
            continue
        text, mine = texts[r.doc_id], [e for e in edits if e[0] == r.doc_id]
        assert r.n_tokens == len(encode(text)) and r.n_edits == len(mine)
        for _, _, a, b, new in mine:
            a, b = min(a or 0, len(text)), min(b or 0, len(text))
            text = text[:a] + (new or "") + text[max(a, b) :]
        assert r.tokens_after == len(encode(text))
        assert r.recoded < 100 or r.doc_id == 4
    assert edit_counts.edited_counts(nothing, table).collect() == []


def test_edits_equal_a_new_count():
    counter, encode, random_ = edit_counts.Counter(), tokens.encoding().encode_ordinary, random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "'", "'re", "s", "ll", "1", "23", "!", "é", "ß", "\t", "the ", " of", "。", "ve"]
    make = lambda n: "".join(random_.choice(parts) for _ in range(n))
    for _ in range(400):
        tree = edit_counts.PretokenTree(make(random_.choice([0, 1, 5, 30, 300])), counter)
        for _ in range(5):
            a = random_.randint(0, len(tree.text) + 2)
            tree.edit(a, a + random_.choice([0, 1, 3, 20]), make(random_.choice([0, 1, 4, 200])))
            assert tree.total == len(encode(tree.text)) and tree.chars[1] == len(tree.text)
            k = random_.randint(0, len(tree.text))
            assert k == len(tree.text) or tree.prefix_tokens(k) == sum(len(encode(m.group())) for m in tokens.pretokens.finditer(tree.text) if m.end() <= k)
