"""Posting-shaped inputs derived from the given tables.

The given tables hold no postings, so attributes are picked from fixed lists
by key and joined with the real text. Every shape exists twice, as a DataFrame
and as SQL for the check, over the same lists and the whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-31 00:00:00 UTC
AS_OF = 1706659200

TITLES = [
    "Platform Engineer II", "Platform Engineer 2", "Senior DevOps Engineer", "Sr DevOps Engineer",
    "Data Analyst", "Junior Developer", "Principal SRE", "DevOps Jobs", "Apply now",
    "AWS, EKS, Terraform, CI/CD", "", "Acme", "Backend Developer",
]
COMPANIES = ["Acme", "Acme Inc.", "Globex", "Barclays", "Unknown", "", "Mastercard"]
LOCATIONS = [
    "Pune", "Bangalore, India", "Hyderabad, Bengaluru", "Noida", "Remote", "Mumbai, Maharashtra",
    "India", "San Francisco, CA", "", "Work from home", "New Delhi",
]
SALARIES = [
    "₹28-35 LPA", "8-13 LPA", "₹7-12 Lacs", "5-8 lakhs", "₹1.2 Cr", "₹0.5-1 Cr",
    "₹8,00,000 - ₹12,00,000", "₹1,00,000 - ₹1,50,000 per month", "₹30-40K per month",
    "₹50K - ₹60K per month", "₹10 LPA", "₹10L", "8 to 13 Years", "3-6 Years", "Not Disclosed", "",
    "5 lakhs",
]
LISTED = [
    "2 days ago", "3 weeks ago", "today", "yesterday", "5 hours ago", "2024-01-28", "Jan 5, 2024", "",
    "not a date",
]
WORKPLACES = ["", "Hybrid", "On-site", "Remote"]
PHRASES = [
    "aws docker kubernetes", "k8s terraform ci/cd", "amazon web services linux", "c++11 python", "",
]
SKILL_POOL = [
    "aws", "docker", "kubernetes", "terraform", "ci/cd", "linux", "python", "amazon web services", "c++",
]
PROFILE_PLACES = [
    "Pune", "Hyderabad, Bengaluru", "India", "Remote", "", "Mumbai and Pune", "Noida / Delhi",
    "San Francisco",
]
PROFILE_TITLES = ["Platform Engineer", "DevOps Engineer", "Data Analyst", "Backend Developer", ""]
PREFERENCES = ["", "remote", "hybrid", "onsite"]


def pick(values: list[str], key: Column) -> Column:
    """``values[key mod n]``."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_pick(values: list[str], key: str) -> str:
    return f"{sql_list(values)}[(({key}) % {len(values)} + 1)::INT]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in several tasks per core, for rows that are short in their file and costly to turn into pages and to parse."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def as_of() -> Column:
    return F.lit(AS_OF).cast("double")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw postings: one per document, keyed and ordered by ``posting_id``."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    k = F.col("doc_id")
    url = (
        F.when(k % 23 == 0, "")
        .when(k % 19 == 0, F.concat(F.lit("https://in.indeed.com/rc/clk?jk="), k.cast("string")))
        .otherwise(F.concat(F.lit("https://jobs.example.com/posting/"), (k - k % 2).cast("string")))
    )
    return docs.join(labels.select("doc_id", "quality"), "doc_id", "left").select(
        k.alias("posting_id"),
        pick(TITLES, k).alias("title"),
        pick(COMPANIES, k).alias("company"),
        pick(LOCATIONS, k).alias("location"),
        pick(SALARIES, k).alias("salary"),
        pick(LISTED, k).alias("listed"),
        pick(WORKPLACES, k).alias("workplace_type"),
        F.concat_ws(" ", pick(PHRASES, k), F.col("text")).alias("description"),
        url.alias("url"),
        F.when(k % 38 == 0, k.cast("string")).alias("job_key"),
        F.col("source"),
        F.when(F.col("quality") == 1, "full").when(F.col("quality") == 0, "partial").alias("data_quality"),
    )


POSTINGS = f"""
postings AS (
  SELECT d.doc_id AS posting_id,
    {sql_pick(TITLES, 'd.doc_id')} AS title,
    {sql_pick(COMPANIES, 'd.doc_id')} AS company,
    {sql_pick(LOCATIONS, 'd.doc_id')} AS location,
    {sql_pick(SALARIES, 'd.doc_id')} AS salary,
    {sql_pick(LISTED, 'd.doc_id')} AS listed,
    {sql_pick(WORKPLACES, 'd.doc_id')} AS workplace_type,
    {sql_pick(PHRASES, 'd.doc_id')} || ' ' || d.text AS description,
    CASE WHEN d.doc_id % 23 = 0 THEN ''
         WHEN d.doc_id % 19 = 0 THEN 'https://in.indeed.com/rc/clk?jk=' || d.doc_id
         ELSE 'https://jobs.example.com/posting/' || (d.doc_id - d.doc_id % 2) END AS url,
    CASE WHEN d.doc_id % 38 = 0 THEN d.doc_id::VARCHAR END AS job_key,
    d.source,
    CASE l.quality WHEN 1 THEN 'full' WHEN 0 THEN 'partial' END AS data_quality
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate profile per customer."""
    k = F.col("c_custkey")
    pool = F.array(*[F.lit(s) for s in SKILL_POOL])
    return table(spark, sf_dir, "customer").select(
        k.alias("profile_id"),
        pick(PROFILE_TITLES, k).alias("p_title"),
        F.col("c_mktsegment").alias("p_headline"),
        pick(PROFILE_PLACES, F.col("c_nationkey")).alias("p_location"),
        F.when(k % 7 == 0, "").otherwise((k % 15).cast("string")).alias("p_experience"),
        pick(PREFERENCES, k).alias("p_remote_preference"),
        F.slice(pool, (k % 6 + 1).cast("int"), (k % 4 + 1).cast("int")).alias("p_skills"),
        F.slice(pool, (k % 5 + 1).cast("int"), (k % 3).cast("int")).alias("p_must_have_skills"),
        F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 500)).cast("int").alias("p_min_salary"),
    )


PROFILES = f"""
profiles AS (
  SELECT c_custkey AS profile_id,
    {sql_pick(PROFILE_TITLES, 'c_custkey')} AS p_title,
    c_mktsegment AS p_headline,
    {sql_pick(PROFILE_PLACES, 'c_nationkey')} AS p_location,
    CASE WHEN c_custkey % 7 = 0 THEN '' ELSE (c_custkey % 15)::VARCHAR END AS p_experience,
    {sql_pick(PREFERENCES, 'c_custkey')} AS p_remote_preference,
    {sql_list(SKILL_POOL)}[(c_custkey % 6 + 1)::INT : (c_custkey % 6 + c_custkey % 4 + 1)::INT] AS p_skills,
    {sql_list(SKILL_POOL)}[(c_custkey % 5 + 1)::INT : (c_custkey % 5 + c_custkey % 3)::INT] AS p_must_have_skills,
    GREATEST(0, FLOOR(c_acctbal / 500))::INT AS p_min_salary
  FROM customer
)"""


def pairs(spark: SparkSession, sf_dir: str, postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every posting with one profile and every profile with one posting, by the numbers of the other table; no row is left out."""
    n, m = table(spark, sf_dir, "customer").count(), table(spark, sf_dir, "documents").count()
    mine = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("posting_id"), (F.col("doc_id") % max(n, 1)).alias("profile_id"))
    theirs = table(spark, sf_dir, "customer").select((F.col("c_custkey") % max(m, 1)).alias("posting_id"), F.col("c_custkey").alias("profile_id"))
    return mine.unionByName(theirs).distinct().join(postings, "posting_id").join(profiles, "profile_id")


PAIRS = """
pairs AS (SELECT doc_id AS posting_id, doc_id % (SELECT count(*) FROM customer) AS profile_id FROM documents
  UNION SELECT c_custkey % (SELECT count(*) FROM documents), c_custkey FROM customer)"""


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body
