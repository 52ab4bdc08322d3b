"""Literal cases of the normalizers, matchers and parsers."""

import pytest
from pyspark.sql import functions as F

from worklens.functions import extract, gates, places, salary, similarity, times, urls, words
from worklens.operators import scorer

NOW = 1706659200.0


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", build(F.col("v")).alias("o")).orderBy("i").collect()]


SALARIES = {
    "₹28-35 LPA": 35, "8-13 LPA": 13, "₹7-12 Lacs": 12, "5-8 lakhs": 8, "₹1.2 Cr": 120, "₹0.5-1 Cr": 100,
    "₹8,00,000 - ₹12,00,000": 12, "₹1,00,000 - ₹1,50,000 per month": 18, "₹30-40K per month": 5,
    "₹50K - ₹60K per month": 6, "₹10 LPA": 10, "₹10L": 10, "8 to 13 Years": None, "3-6 Years": None,
    "Not Disclosed": None, "": None, "5 lakhs": None, "1.2.3 LPA": None, "2.5 LPA": 2, "3.5 LPA": 4,
}


def test_salary(spark):
    assert column(spark, list(SALARIES), salary.salary_int) == list(SALARIES.values())


CITIES = {
    "Pune, Maharashtra, India": "Pune", "Hyderabad, Bengaluru": "Hyderabad", "bangalore": "Bengaluru", "New Delhi": "Delhi",
    "Work from home": "Remote", "work-from-home, Pune": "Pune", "pan-india": "India", "Anywhere in India": "Remote",
    "NCR region": "Delhi", "San Francisco, CA": "San Francisco", "Thane": "Thane", "xpune": "", "": "", "12345": "",
    "India / Remote": "India", "Bangalore / Hyderabad / Bengaluru": "Hyderabad",
}


def test_city(spark):
    assert column(spark, list(CITIES), places.city) == list(CITIES.values())


def test_region_and_text(spark):
    assert column(spark, ["Noida", "Thane", "BLR", "Mars"], places.region) == ["Delhi NCR", "Maharashtra", "Karnataka", ""]
    texts = ["NCR Corp virtual machines", "in Managing cloud in Noida", "salem"]
    assert column(spark, texts, places.city_in_text) == ["", "Noida", ""]


def test_times(spark):
    forms = ["2 days ago", "5 hours ago", "3 weeks ago", "1 month ago", "just now", "Today", "yesterday", "soon"]
    day = 86400
    want = [NOW - 2 * day, NOW, NOW - 21 * day, NOW - 30 * day, NOW, NOW - 3600, NOW - day, None]
    assert column(spark, forms, lambda c: times.relative_epoch(c, F.lit(NOW))) == want
    dates = ["2026-01-05", "Jan 5, 2026", "5 January 2026", "05/01/2026", "Posted: 5 Jan 2026", "2026-01-05T00:00:00Z",
             "2026-01-05T00:00:00.000Z", "2026-01-05T05:30:00+0530", "13/13/2026", "x"]
    assert column(spark, dates, times.absolute_epoch) == [1767571200] * 8 + [None, None]


def test_snippet_age(spark):
    forms = ["posted 3 days ago", "posted 10 days ago", "2 months ago", "posted: jan 20, 2024", "date: dec 1, 2023", "none"]
    assert column(spark, forms, lambda c: times.snippet_older_than(c, 7, F.lit(NOW))) == [False, True, True, True, True, False]


MATCHES = [
    ("c++11 python", "c++", True, False), ("c++ developer", "c++", False, True), ("asp.net core", ".net", True, False),
    ("use .net core", ".net", False, True), ("ci/cd tools", "ci/cd", True, True), ("cpp dev", "c++", False, True),
    ("k8s ops", "kubernetes", False, True), ("javascript", "java", False, False), ("amazon web services", "aws", False, True),
]


def test_two_skill_rules(spark):
    rows = spark.createDataFrame([(i, t, [s]) for i, (t, s, _, _) in enumerate(MATCHES)], "i int, t string, s array<string>")
    got = rows.select(
        "i", (F.size(words.hits(F.col("t"), words.needles(F.col("s"), False))) > 0).alias("w"),
        (F.size(words.hits(F.col("t"), words.needles(F.col("s"), True))) > 0).alias("e"),
    ).orderBy("i").collect()
    assert [(r["w"], r["e"]) for r in got] == [(w, e) for _, _, w, e in MATCHES]


def test_match_key_and_similarity(spark):
    assert column(spark, ["Sr Platform Engineer II", "Acme, Inc."], words.match_key) == ["platform engineer", "acme inc"]
    assert round(similarity.token_sorts(["platform engineer"], ["senior platform engineer"])[0], 1) == 82.9
    assert similarity.company_ratios(["mastercard", "", ""], ["mastercard inc", "", "a"]).tolist() == [100, 100, 0]
    assert similarity.lcs("abcde", "xaxcxe") == 3


def test_titles_and_companies(spark):
    assert column(spark, ["Acme is hiring Data Engineer in Pune", "SRE - LinkedIn"], extract.clean_web_title) == ["Data Engineer", "SRE"]
    hosts = ["https://koch.avature.net/x", "https://opportunities.vodafone.com/", "https://boards.greenhouse.io/a", "https://wd5.myworkdayjobs.com/x"]
    assert column(spark, hosts, urls.company_from_host) == ["Koch", "Vodafone", "", ""]
    slug = ["https://www.naukri.com/job-listings-python-developer-varite-kolkata-hyderabad-bengaluru-8-to-13-years-100326009734"]
    assert column(spark, slug, urls.company_from_slug) == ["Varite"]
    assert column(spark, slug, urls.locations_from_slug) == ["Kolkata, Hyderabad, Bengaluru"]


def test_junk_titles(spark):
    titles = ["DevOps Jobs", "Apply now", "AWS, EKS, Terraform, CI/CD", "Senior DevOps Engineer (A, B, C, D)", "www.acme.com", "Data Analyst"]
    assert column(spark, titles, gates.is_junk_title) == [True, True, True, False, True, False]


def test_redaction(spark):
    texts = ["https://u:p@h.example/x?token=1&a=2", "go u:p@h.example now"]
    assert column(spark, texts, urls.redact) == ["https://***@h.example/x?token=***&a=2", "go ***@h.example now"]


@pytest.mark.parametrize(
    "answer,score",
    [('{"score": 80}', 80.0), ('```json\n{"score": 12.34}\n```', 12.3), ('Sure {"score": 140} ok', 100.0), ('{"score": "80"}', None),
     ('{"score": 1}}', None), ("[]", None), ("", None)],
)
def test_scores(spark, answer, score):
    assert column(spark, [answer], lambda c: scorer.parse_score(c)["score"]) == [score]


def test_tenths_equals_python_round(spark):
    from worklens.functions.base import tenths

    values = [x / 400 for x in range(0, 40000, 7)] + [2.45, 24.5 * 0.1, 0.15, 0.25, 0.35, 2.675, 99.95, 5.05]
    assert column(spark, values, tenths, "double") == [round(v, 1) for v in values]
