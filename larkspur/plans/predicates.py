"""Queries of the predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.urls import path as url_path
from larkspur.operators import predicates as P
from larkspur.plans.base import Tables, query
from larkspur.plans.text import CLEAN, MATCH


def pick(by: Column, *values: str) -> Column:
    """The value at `by` modulo their number."""
    return F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))


def sql_pick(by: str, *values: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({by}) % {len(values)} + 1]"


def sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_regex(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


PLACES = ("Bengaluru, Karnataka", "Remote - India", "BLR INDIA", "Remote, United States", "", "Pune", "Greater Bangalore Area")
TITLES = ("Data Scientist II", "Senior Data Analyst", "Software Engineer", "VP - Analytics", "DevOps Specialist", "ML Engineer", "Sales Lead", "Cloud Platform Engineer", "Technical Support Engineer", "Research Associate")
BODIES = ("We need 2 years.", "Requires 5+ years of SQL.", "minimum 3 years", "at least 6 year s of python", "12 yrs and up", "", "8 plus years")
BY = "p_partkey // 2"


def titles(t: Tables) -> DataFrame:
    k = F.floor(F.col("p_partkey") / 2)
    return t.part.select("p_partkey", F.concat(pick(F.col("p_partkey"), *TITLES), F.lit(" "), "p_name").alias("title"), pick(k, *BODIES).alias("body"), pick(k, *PLACES).alias("location"))


TITLED = f"t AS (SELECT p_partkey, {sql_pick('p_partkey', *TITLES)} || ' ' || p_name AS title, {sql_pick(BY, *BODIES)} AS body, {sql_pick(BY, *PLACES)} AS location FROM part)"
LOCATED = (
    f"({MATCH.format('location')} <> '' AND ((list_has_any(string_split({MATCH.format('location')}, ' '), ['remote', 'blr']) AND list_has_any(string_split({MATCH.format('location')}, ' '), ['india', 'ind']))"
    f" OR len(list_filter({sql_list(P.LOCATIONS)}, lambda x: contains(' ' || {MATCH.format('location')} || ' ', ' ' || x || ' '))) > 0))"
)
TARGET = f"len(list_filter({sql_list(P.TARGET_TITLES)}, lambda x: contains(lower(title), x))) > 0"
TEXT = "lower(title || ' ' || coalesce(body, ''))"
SENIOR = f"""CASE WHEN regexp_matches(lower(title), '\\b(avp|svp|vp)\\b') THEN 'blocked seniority abbreviation'
  WHEN len(list_filter({sql_list(P.BLOCKED_TITLES)}, lambda x: contains(lower(title), x))) > 0 THEN 'blocked title term: ' || list_filter({sql_list(P.BLOCKED_TITLES)}, lambda x: contains(lower(title), x))[1]
  WHEN len(list_filter({sql_list(P.EXPERIENCE_REJECTS)}, lambda x: contains({TEXT}, x))) > 0 THEN 'too much experience: ' || list_filter({sql_list(P.EXPERIENCE_REJECTS)}, lambda x: contains({TEXT}, x))[1]
  WHEN regexp_matches({TEXT}, {sql_regex(P.MANY_YEARS)}) THEN 'experience appears too high: ' || regexp_extract({TEXT}, {sql_regex(P.MANY_YEARS)}) END"""
LEAST = f"regexp_extract({MATCH.format(TEXT)}, {sql_regex(P.LEAST_YEARS)}, 1)"
PLUS = f"regexp_extract({MATCH.format(TEXT)}, {sql_regex(P.PLUS_YEARS)}, 1)"
EXPERIENCE = f"""coalesce({SENIOR}, CASE WHEN try_cast({LEAST} AS DOUBLE) >= 4 THEN 'experience minimum too high: ' || {LEAST} || ' years' END,
  CASE WHEN try_cast({PLUS} AS DOUBLE) >= 4 THEN 'experience minimum too high: ' || {PLUS} || '+ years' END)"""


@query("f1_location_matches", f"WITH {TITLED} SELECT p_partkey, {LOCATED} AS ok FROM t")
def f1(t: Tables) -> DataFrame:
    return titles(t).select("p_partkey", P.location_matches(F.col("location")).alias("ok"))


@query("f2_is_target_title", f"WITH {TITLED} SELECT p_partkey, {TARGET} AS ok FROM t")
def f2(t: Tables) -> DataFrame:
    return titles(t).select("p_partkey", P.is_target_title(F.col("title")).alias("ok"))


@query(
    "f3_technical_titles",
    f"WITH {TITLED} SELECT p_partkey, regexp_matches(title, {sql_regex(P.GENERIC_TITLE)}) AS generic, {TARGET} OR regexp_matches(title, {sql_regex(P.GENERIC_TITLE)})"
    f" OR regexp_matches(title, {sql_regex(P.PLATFORM_TITLE)}) OR regexp_matches(title, {sql_regex(P.DATA_ADJACENT_TITLE)}) AS broad FROM t",
)
def f3(t: Tables) -> DataFrame:
    return titles(t).select("p_partkey", P.is_generic_technical(F.col("title")).alias("generic"), P.is_broad_title(F.col("title")).alias("broad"))


@query("f4_seniority_reason", f"WITH {TITLED} SELECT p_partkey, {SENIOR} AS reason FROM t")
def f4(t: Tables) -> DataFrame:
    return titles(t).select("p_partkey", P.seniority_reason(F.col("title"), F.col("body")).alias("reason"))


@query("f5_experience_reason", f"WITH {TITLED} SELECT p_partkey, {EXPERIENCE} AS reason FROM t")
def f5(t: Tables) -> DataFrame:
    return titles(t).select("p_partkey", P.experience_reason(F.col("title"), F.col("body")).alias("reason"))


EXCLUSIONS = {"support": P.SUPPORT_TITLE, "off_profile": P.NON_PROFILE_TITLE, "advisor": P.ADVISOR_TITLE, "degree": P.DEGREE_TITLE, "other_city": P.OTHER_CITY_TITLE}


@query("f6_title_exclusions", f"WITH {TITLED} SELECT p_partkey, " + ", ".join(f"regexp_matches(title, {sql_regex(p)}) AS {n}" for n, p in EXCLUSIONS.items()) + " FROM t")
def f6(t: Tables) -> DataFrame:
    return titles(t).select("p_partkey", *(F.col("title").rlike(p).alias(n) for n, p in EXCLUSIONS.items()))


@query("f7_in_opening", f"SELECT doc_id, regexp_matches(substr({CLEAN.format('text')}, 1, 1200), '(?i)\\b(is|est)\\s+(of|the|de)\\b') AS ok FROM documents")
def f7(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", P.in_opening(F.col("text"), r"(?i)\b(?:is|est)\s+(?:of|the|de)\b", 1200).alias("ok"))


@query("f8_in_scope", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'widget') AND NOT contains(lower(p_type), 'promo')")
def f8(t: Tables) -> DataFrame:
    return t.part.where(P.in_scope([F.col("p_name"), F.col("p_type")], F.lit("Widget"), F.lit("PROMO"))).select("p_partkey")


@query("f9_split_readable", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'malformed payload' ELSE regexp_extract(props, '([0-9]+)', 1) END AS outcome FROM events")
def f9(t: Tables) -> DataFrame:
    body = t.events.select("event_id", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("props"))
    good, bad = P.split_readable(body, "props", "k int")
    return good.select("event_id", F.col("record.k").cast("string").alias("outcome")).union(bad.select("event_id", "error"))


@query("f10_is_record", "SELECT page_id FROM pages WHERE regexp_matches(coalesce(url, ''), '(?i)^\\s*https?://[^/?#\\s]') AND page_id % 3 <> 0")
def f10(t: Tables) -> DataFrame:
    return t.pages.where(P.is_record(F.when(F.col("page_id") % 3 != 0, "title"), F.col("url"))).select("page_id")


@query("f11_is_open", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def f11(t: Tables) -> DataFrame:
    flag = F.when(F.col("o_orderstatus") == "F", False).when(F.col("o_orderstatus") == "O", True)
    return t.orders.where(P.is_open(flag, F.lit(None).cast("boolean"))).select("o_orderkey")


@query(
    "f12_page_evidence",
    f"""SELECT page_id, CASE WHEN regexp_matches({CLEAN.format('html')}, {sql_regex(P.NO_OPENINGS)}) THEN 'explicit_no_openings'
    WHEN len(regexp_extract_all(html, '(?i)"@type"\\s*:\\s*"JobPosting"')) > 0 THEN 'jobposting_jsonld'
    WHEN len(list_distinct(regexp_extract_all(html, 'href="(/[a-m][^"]*)"', 1))) > 0 THEN 'server_rendered_job_links' ELSE 'no_verifiable_job_records' END AS evidence FROM pages""",
)
def f12(t: Tables) -> DataFrame:
    postings = F.size(F.regexp_extract_all("html", F.lit(r'((?i)"@type"\s*:\s*"JobPosting")'), F.lit(1)))
    links = F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[a-m][^"]*)"'), F.lit(1))))
    return t.pages.select("page_id", P.page_evidence(F.col("html"), postings, links).alias("evidence"))


@query("f13_same_identity", "SELECT s_suppkey, s_suppkey % 4 <> 3 AS same FROM supplier")
def f13(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 4
    other = F.when(k == 0, F.concat(F.lit("Careers at "), "s_name")).when(k == 1, F.concat("s_name", F.lit(" Ltd."))).when(k == 2, F.upper("s_name")).otherwise("Another")
    return t.supplier.select("s_suppkey", P.same_identity(F.col("s_name"), other).alias("same"))


@query("f14_same_board", "SELECT s_suppkey, s_suppkey % 3 <> 2 AS same FROM supplier")
def f14(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 3
    other = F.concat("s_name", F.when(k == 0, " Careers").when(k == 1, " External Team").otherwise(" Labs"))
    return t.supplier.select("s_suppkey", P.same_board(F.col("s_name"), other).alias("same"))


ATS = ("lever", "greenhouse", "recruitee", "ashby")
PROMOTED = f"""p AS (SELECT s_suppkey, s_name, {sql_pick('s_suppkey', *ATS)} AS ats, s_suppkey % 11 <> 0 AS enabled, s_nationkey AS jobs,
    CASE WHEN s_suppkey % 8 = 1 THEN s_name || ' Labs' ELSE s_name END AS verified, CASE WHEN s_suppkey = 8 THEN 'LinkedIn' ELSE s_name END AS name FROM supplier)"""
REASON = """CASE WHEN NOT enabled THEN 'disabled' WHEN jobs <= 0 AND ats <> 'greenhouse' THEN 'no observed postings' WHEN name = 'LinkedIn' AND ats = 'lever' THEN 'known test or unrelated board'
    WHEN ats = 'recruitee' THEN 'provider response does not prove company identity' WHEN ats = 'greenhouse' AND s_suppkey % 8 = 1 THEN 'Greenhouse board name does not match company identity' END"""


def promoted(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    rows = t.supplier.select("s_suppkey", F.when(k == 8, "LinkedIn").otherwise(F.col("s_name")).alias("name"), pick(k, *ATS).alias("ats"), (k % 11 != 0).alias("enabled"),
        F.col("s_nationkey").alias("jobs"), F.when(k % 8 == 1, F.concat("s_name", F.lit(" Labs"))).otherwise(F.col("s_name")).alias("verified"))
    return rows.withColumn("reason", P.promotion_reason(F.col("name"), F.col("ats"), F.col("enabled"), F.col("jobs"), F.col("verified")))


@query("f15_promotion_reason", f"WITH {PROMOTED} SELECT s_suppkey, {REASON} AS reason FROM p")
def f15(t: Tables) -> DataFrame:
    return promoted(t).select("s_suppkey", "reason")


@query("f16_is_observed", f"WITH {PROMOTED} SELECT s_suppkey FROM p WHERE ats = 'greenhouse' OR jobs > 0")
def f16(t: Tables) -> DataFrame:
    return promoted(t).where(P.is_observed(F.col("ats"), F.col("jobs"))).select("s_suppkey")


@query("f17_path_has_term", "SELECT page_id FROM pages WHERE regexp_matches(lower(regexp_extract(url, '://[^/?#]+([^?#]*)', 1)), '[^a-z0-9]fr[^a-z0-9]|77')")
def f17(t: Tables) -> DataFrame:
    return t.pages.where(P.path_has_term(url_path(F.col("url")), ("fr", "77"))).select("page_id")


@query("f18_is_dynamic", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderpriority = '5-LOW')")
def f18(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "DYNAMIC").when(F.col("o_orderstatus") == "O", "REDIRECT").otherwise("BROKEN")
    resolved = F.when(F.col("o_orderpriority") == "5-LOW", "DYNAMIC")
    return t.orders.where(P.is_dynamic(status, resolved)).select("o_orderkey")
