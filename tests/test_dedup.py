"""Fuzzy duplicate removal against the plain greedy rule."""

import random
import re

import pytest

from worklens.functions import similarity
from worklens.operators import dedup

CASES = [
    ([("Platform Engineer II", "Barclays"), ("Platform Engineer 2", "Barclays")], 1),
    ([("Senior Platform Engineer", "Mastercard"), ("Platform Engineer, Senior", "Mastercard")], 1),
    ([("Platform Engineer", "Mastercard"), ("Platform Engineer", "Mastercard Inc.")], 1),
    ([("Sr Platform Engineer", "Google"), ("Senior Platform Engineer", "Google")], 1),
    ([("", ""), ("", "")], 1),
    ([("DevOps Engineer", "Amazon"), ("SDE - AWS Platform", "Amazon")], 2),
    ([("Platform Engineer", "A"), ("DevOps Engineer", "B"), ("Cloud Engineer", "C")], 3),
]


def key(s):
    s = re.sub(r"\b(ii|iii|iv|sr?|jr)\b", "", s.lower().strip())
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", s)).strip()


def ratio(a, b):
    size = len(a) + len(b)
    return 100.0 if size == 0 else 200.0 * similarity.lcs(a, b) / size


def token_sort(a, b):
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a, b):
    """Best ratio among the common words alone and with the rest of either side; 0 when a side is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0 if x or y else 100.0
    common, rest_x, rest_y = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not rest_x or not rest_y):
        return 100.0
    whole = [" ".join([*sorted(common), *([rest] if rest else [])]) for rest in (rest_x, rest_y)]
    base = " ".join(sorted(common))
    n = len(whole[0]) + len(whole[1])
    best = 100.0 - 100.0 * (len(rest_x) + len(rest_y) - 2 * similarity.lcs(rest_x, rest_y)) / n
    return max(best, *(100.0 - 100.0 * (len(w) - len(base)) / (len(base) + len(w)) for w in whole)) if base else best


def greedy(rows):
    kept = []
    for i, title, company in rows:
        t, c = key(title), key(company)
        if not any(token_sort(t, u) >= 82 and token_set(c, d) >= 88 for _, u, d in kept):
            kept.append((i, t, c))
    return [i for i, _, _ in kept]


def survivors(spark, rows, block):
    df = spark.createDataFrame(rows, "posting_id bigint, title string, company string")
    return sorted(r["posting_id"] for r in dedup.fuzzy(df, block=block).select("posting_id").collect())


@pytest.mark.parametrize("pairs,kept", CASES)
def test_pairs(spark, pairs, kept):
    rows = [(i, t, c) for i, (t, c) in enumerate(pairs)]
    assert len(survivors(spark, rows, 2000)) == kept


def spelled(rng, words):
    out = " ".join(rng.sample(words, rng.randint(1, 3)))
    for _ in range(rng.randint(0, 2)):
        at = rng.randrange(len(out) + 1)
        out = out[:at] + rng.choice("abcxyz ") + out[at + rng.randint(0, 1):]
    return out


@pytest.mark.parametrize("seed,block", [(1, 2000), (2, 5), (3, 1)])
def test_equals_brute_force(spark, seed, block):
    """Small blocks force the refinement and the tiles."""
    rng = random.Random(seed)
    titles = "senior platform engineer devops cloud data analyst lead a it qa go".split()
    firms = "acme globex inc labs mastercard barclays ab x".split()
    rows = [(i, spelled(rng, titles), rng.choice(["", spelled(rng, firms), rng.choice(firms)])) for i in range(260)]
    assert survivors(spark, rows, block) == greedy(rows)


def test_similar_names_share_keys():
    """Both blocking claims on random similar strings."""
    rng = random.Random(7)
    words = "senior platform engineer devops cloud data analyst acme inc labs a b".split()

    def grams(t):
        seen, out = {}, set()
        for i in range(len(t) - 1):
            g = t[i : i + 2]
            seen[g] = seen.get(g, 0) + 1
            out.add((g, seen[g]))
        return out

    def pieces(c):
        seen, out = {}, set()
        for w in dict.fromkeys(c.split()):
            for i in range(len(w)):
                g = ("^" + w)[i : i + 2]
                seen[g] = seen.get(g, 0) + 1
                out.add((g, seen[g]))
        return sorted(out)[: int(len(c) * 0.48 / 1.12) + 1]

    def probes(c):
        out, size = set(), 0
        for i, w in enumerate(sorted(set(c.split()))):
            size_before, size = size, size + len(w)
            if i == 0 or size_before <= len(c) * 3 / 14:
                out.add(w)
        return out

    titles = companies = 0
    for _ in range(60000):
        a = " ".join(sorted(key(spelled(rng, words)).split()))
        b = " ".join(sorted(key(spelled(rng, words) if rng.random() < 0.5 else a + rng.choice("abz")).split()))
        if ratio(a, b) >= 82 and min(len(a), len(b)) > 2:
            titles += 1
            order = lambda t: sorted(grams(t))[: int(len(t) * 0.72 / 1.18) + 1]
            assert set(order(a)) & set(order(b)), (a, b)
        if a and b and token_set(a, b) >= 88:
            companies += 1
            met = set(pieces(a)) & set(pieces(b)) or probes(a) & set(b.split()) or probes(b) & set(a.split())
            assert met, (a, b)
    assert titles > 1000 and companies > 1000


def test_many_pairs_at_once():
    rng = random.Random(9)
    text = lambda most: "".join(rng.choice("abc é") for _ in range(rng.randint(0, most)))
    a, b = [text(rng.choice([3, 20, 64, 90])) for _ in range(400)], [text(rng.choice([3, 20, 64, 90])) for _ in range(400)]
    assert similarity.lcs_many(a, b).tolist() == [similarity.lcs(x, y) for x, y in zip(a, b)]
    assert similarity.token_sorts(a, b).tolist() == [token_sort(x, y) for x, y in zip(a, b)]
    assert similarity.company_ratios(a, b).round(9).tolist() == [round(token_set(x, y), 9) for x, y in zip(a, b)]
