"""Queries of the scoring lanes, over documents and parts that play postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.text import has_phrase, hits, tech_text
from larkspur.operators import predicates as P
from larkspur.operators import scoring as S
from larkspur.plans.base import Tables, query
from larkspur.plans.predicates import EXPERIENCE, LOCATED, SENIOR, TARGET, pick, sql_list, sql_pick, sql_regex
from larkspur.plans.text import CLEAN, MATCH, TECH
from larkspur.plans.values import TOKENS

ROLES = (
    "Data Scientist", "Senior Data Scientist", "Software Engineer", "ML Engineer", "Business Analyst", "DevOps Engineer", "Platform Engineer", "AI Engineer",
    "Data Engineer", "Automation Specialist", "Technical Support Engineer", "Research Associate (PhD)", "Data Pipeline Engineer based in Pune", "Systems Administrator",
)
SITES = ("Bengaluru", "Remote India", "BLR, IND", "London", "Bangalore, Karnataka")
NOTES = (
    "Entry level. Python, SQL, pandas and machine learning for data science dashboards.", "We need 5+ years of SQL and Spark.", "Generative AI and LLM work with PyTorch and TensorFlow; 0-2 years.",
    "DevOps and CI/CD with Jenkins, Docker, Linux, Ansible and Git; build automation, cloud infrastructure. Associate role.", "Minimum 3 years of Tableau and Power BI.",
    "Data engineering with Python, SQL, Airflow and Databricks; statistics; data pipeline work.", "We are looking for a senior colleague in data analytics, python, sql, pandas.", "", "Requires 4 years with ETL, Spark and Python.",
    "Platform engineering, infrastructure as code, site reliability with python, bash, yaml, github and docker.",
)


def postings(t: Tables) -> DataFrame:
    """Documents as postings: title, place and note by the id, the text as the rest of the description."""
    k = F.col("doc_id")
    role, note = pick(k, *ROLES), pick(F.floor(k / 3), *NOTES)
    return t.documents.select(
        "doc_id", role.alias("title"), pick(F.floor(k / 2), *SITES).alias("location"), F.concat(note, F.lit(" "), "text").alias("description"),
        F.col("source").alias("department"), (k % 6).cast("int").alias("priority"),
    )


def has(text: str, terms: tuple[str, ...]) -> str:
    return f"list_filter({sql_list(terms)}, lambda x: contains({text}, x))"


def phrases(text: str, terms: tuple[str, ...]) -> str:
    return f"list_filter({sql_list(terms)}, lambda x: contains(' ' || {text} || ' ', ' ' || x || ' '))"


def rows(score: str, *reasons: str) -> str:
    return f"{{'score': ({score})::INT, 'reasons': list_filter([{', '.join(reasons)}], lambda x: x IS NOT NULL)}}"


def none(reason: str) -> str:
    return rows("0", reason if reason.isidentifier() else "'" + reason + "'")


def listing(label: str, found: str, most: int) -> str:
    return f"CASE WHEN len({found}) > 0 THEN '{label}' || array_to_string({found}[1:{most}], ', ') END"


PLACE, PRIORITY = f"'{S.PLACE_REASON}'", "CASE WHEN priority >= 4 THEN 'higher WLB priority company' END"
BASE = f"""CASE WHEN NOT place THEN {none(S.NO_PLACE)} WHEN len({has('low_title', S.STRONG_TITLES)}) = 0 THEN {none('title does not match a target data/AI/analytics role')}
  WHEN senior IS NOT NULL THEN {none('senior')} ELSE {rows(
    f"least(100, 70 + least(30, 5 * len({has('base_text', S.SKILLS)})) + CASE WHEN len({has('base_text', S.CONTEXT)}) > 0 THEN 10 ELSE 0 END"
    f" + CASE WHEN len({has('base_text', S.EARLY)}) > 0 THEN 10 ELSE 0 END + CASE WHEN priority >= 4 THEN 5 ELSE 0 END)",
    PLACE, f"'role title: ' || {has('low_title', S.STRONG_TITLES)}[1]", listing('skills: ', has('base_text', S.SKILLS), 6),
    f"CASE WHEN len({has('base_text', S.CONTEXT)}) > 0 THEN 'data/analytics context' END", f"CASE WHEN len({has('base_text', S.EARLY)}) > 0 THEN 'early-career signal' END", PRIORITY)} END"""
EXPANDED = f"""CASE WHEN base.score > 0 THEN base WHEN NOT place THEN {none(S.NO_PLACE)}
  WHEN NOT regexp_matches(title, {sql_regex(P.GENERIC_TITLE)}) THEN {none('title does not match a target or adjacent technical role')} WHEN senior IS NOT NULL THEN {none('senior')}
  WHEN len(domains) = 0 OR (len(domains) < 2 AND len(tech) < 2 AND early IS NULL) THEN {none('generic technical title lacks strong data/AI evidence')}
  ELSE {rows("least(100, 60 + least(15, 5 * len(domains)) + least(20, 5 * len(tech)) + CASE WHEN early IS NULL THEN 0 ELSE 10 END + CASE WHEN priority >= 4 THEN 5 ELSE 0 END)",
    PLACE, "'adjacent engineer role verified from description'", listing('data/AI context: ', 'domains', 3), listing('skills: ', 'tech', 5), "'early-career signal: ' || early", PRIORITY)} END"""
PRODUCTION = f"CASE WHEN experience IS NOT NULL THEN {none('experience')} ELSE expanded END"
PRECISION = f"""CASE WHEN regexp_matches(title, {sql_regex(P.OTHER_CITY_TITLE)}) THEN {none('title requires a non-target city rather than Remote India')}
  WHEN experience IS NOT NULL THEN {none('experience')} WHEN {TARGET} THEN expanded
  WHEN NOT regexp_matches(title, {sql_regex(P.GENERIC_TITLE)}) THEN {none('title does not match a target or adjacent technical role')}
  WHEN regexp_matches(title, {sql_regex(P.SUPPORT_TITLE)}) THEN {none('adjacent title belongs to support/general application engineering')}
  WHEN regexp_matches(substr(clean, 1, 1200), {sql_regex(P.SENIOR_OPENING)}) THEN {none('description identifies the role itself as senior')}
  WHEN expanded.score = 0 OR regexp_matches(title, {sql_regex(S.TITLE_DOMAIN)}) THEN expanded
  WHEN (len({has('form', S.CORE_SKILLS)}) >= 3 AND list_has_any({has('form', S.BODY_DOMAINS)}, {sql_list(S.CORE_DOMAINS)}))
    OR (regexp_matches(form, {sql_regex(S.EARLY_ROLE)}) AND len({has('form', S.BODY_DOMAINS)}) >= 1 AND len({has('form', S.CORE_SKILLS)}) >= 2)
    THEN {{'score': least(85, expanded.score)::INT, 'reasons': list_append(expanded.reasons, 'generic title passed strict profile-overlap check')}}
  ELSE {none('generic title lacks enough profile-specific data/AI evidence')} END"""
EXTRA = f"CASE WHEN regexp_matches(body_form, {sql_regex(S.EARLY_ADJACENT)}) THEN 10 ELSE 0 END + CASE WHEN priority >= 4 THEN 5 ELSE 0 END"
EARLY_REASON = f"CASE WHEN regexp_matches(body_form, {sql_regex(S.EARLY_ADJACENT)}) THEN 'early-career signal' END"
ADJACENT = f"""CASE WHEN NOT place THEN {none(S.NO_PLACE)} WHEN experience IS NOT NULL THEN {none('experience')}
  WHEN regexp_matches(title, {sql_regex(P.NON_PROFILE_TITLE)}) THEN {none('role family does not overlap the resume target lanes')}
  WHEN regexp_matches(title, {sql_regex(P.ADVISOR_TITLE)}) THEN {none('title indicates an experienced advisory level')}
  WHEN regexp_matches(substr(clean, 1, 1600), {sql_regex(P.SENIOR_DESCRIPTION)}) THEN {none('description identifies an experienced/senior role')}
  WHEN regexp_matches(clean, {sql_regex(P.THREE_YEARS)}) THEN {none('adjacent role requires 3+ years; above demonstrated experience')}
  WHEN CASE WHEN regexp_matches(title, {sql_regex(P.PLATFORM_TITLE)}) THEN len(signals) >= 1 AND len(profile) >= 3
    ELSE regexp_matches(title, {sql_regex(P.GENERIC_TITLE)}) AND len(signals) > 0 AND ((regexp_matches(body_form, {sql_regex(S.EARLY_ADJACENT)}) AND len(signals) >= 2 AND len(profile) >= 4) OR (len(signals) >= 3 AND len(profile) >= 5)) END
    THEN {rows(f"least(95, 60 + least(20, 5 * len(profile)) + least(10, 5 * len(signals)) + {EXTRA})", PLACE, "'resume lane: DevOps/platform/build automation'",
      "'resume skills: ' || array_to_string(profile[1:6], ', ')", listing('platform context: ', 'signals', 3), EARLY_REASON, PRIORITY)}
  WHEN regexp_matches(title, {sql_regex(P.DATA_ADJACENT_TITLE)}) AND len(data_skills) >= 2
    THEN {rows(f"least(95, 65 + least(20, 5 * len(data_skills)) + {EXTRA})", PLACE, "'resume lane: data engineering/data science'", listing('resume skills: ', 'data_skills', 6), EARLY_REASON, PRIORITY)}
  ELSE {none('role lacks enough evidence for a resume-aligned adjacent lane')} END"""
STEPS = f"""WITH j AS (SELECT doc_id, {sql_pick('doc_id', *ROLES)} AS title, {sql_pick('doc_id // 2', *SITES)} AS location, {sql_pick('doc_id // 3', *NOTES)} || ' ' || text AS body, source AS department, (doc_id % 6)::INT AS priority FROM documents),
a AS (SELECT *, {LOCATED} AS place, {SENIOR} AS senior, {EXPERIENCE} AS experience, lower(title) AS low_title, lower(title || ' ' || department || ' ' || location || ' ' || body) AS base_text,
  ' ' || lower(title || ' ' || department || ' ' || body) || ' ' AS wide, {CLEAN.format('body')} AS clean, {MATCH.format('body')} AS form, {MATCH.format("(department || ' ' || body)")} AS body_form,
  {MATCH.format("(title || ' ' || department || ' ' || body)")} AS all_form, {MATCH.format('title')} AS title_form FROM j),
b AS (SELECT *, {BASE} AS base, list_concat({has('wide', S.DOMAINS)}, list_filter([CASE WHEN contains(' ' || title_form || ' ', ' ai ') THEN 'title: AI' END, CASE WHEN contains(' ' || title_form || ' ', ' ml ') THEN 'title: ML' END], lambda x: x IS NOT NULL)) AS domains,
  {has('wide', S.TECH_SKILLS)} AS tech, {has('wide', S.EARLY_SIGNALS)}[1] AS early, {phrases('body_form', S.PROFILE_SKILLS)} AS profile, {phrases('body_form', S.DATA_SKILLS)} AS data_skills, {phrases('all_form', S.PLATFORM_SIGNALS)} AS signals FROM a),
e AS (SELECT *, {EXPANDED} AS expanded FROM b),
l AS (SELECT *, {PRODUCTION} AS production, {PRECISION} AS precise, {ADJACENT} AS adjacent FROM e),
f AS (SELECT *, CASE WHEN regexp_matches(title, {sql_regex(P.DEGREE_TITLE)}) THEN {none('title requires a PhD/doctoral qualification not in the resume')}
  WHEN precise.score > 0 THEN precise WHEN len(adjacent.reasons) > 0 THEN adjacent ELSE precise END AS cascade FROM l)
"""


def lane(name: str, column: str) -> None:
    sql = STEPS + f"SELECT doc_id, {column}.score AS score, array_to_string({column}.reasons, '; ') AS reasons FROM f"

    @query(name, sql)
    def run(t: Tables, kind: str = {"precise": "precision"}.get(column, column)) -> DataFrame:
        return S.score_postings(postings(t), lane=kind).select("doc_id", "score", F.array_join("reasons", "; ").alias("reasons"))


for _name, _column in (
    ("c1_base_lane", "base"), ("c2_expanded_lane", "expanded"), ("c3_production_lane", "production"), ("c4_precision_lane", "precise"), ("c5_adjacent_lane", "adjacent"), ("c6_lane_cascade", "cascade"),
):
    lane(_name, _column)


@query("c7_threshold", STEPS + "SELECT doc_id, cascade.score AS score FROM f WHERE cascade.score >= 70")
def c7(t: Tables) -> DataFrame:
    return S.score_postings(postings(t)).where("score >= 70").select("doc_id", "score")


FAMILIES = (("plain", "of the", 4), ("plain", "and", 4), ("plain", "er", -3), ("french", "de la", 4), ("french", "le", 4), ("german", "der", 4), ("german", "und", -3))


@query(
    "c8_phrase_score",
    f"WITH p(family, phrase, weight) AS (VALUES {', '.join(str(f) for f in FAMILIES)}), d AS (SELECT doc_id, ' ' || {TECH.format('text')} || ' ' AS form FROM documents)"
    " SELECT doc_id, family, sum(weight)::BIGINT AS score FROM d JOIN p ON contains(form, ' ' || phrase || ' ') GROUP BY ALL",
)
def c8(t: Tables) -> DataFrame:
    return S.phrase_score(t.documents, t.spark.createDataFrame(FAMILIES, "family string, phrase string, weight int"), "text", "doc_id")


@query(
    "c9_relevance_order",
    f"""WITH f AS (SELECT *, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS lead FROM conversations),
    k AS (SELECT conv_id, turn, ' ' || {TECH.format('text')} || ' ' AS form, list_distinct({TOKENS}) AS a, list_distinct({TOKENS.replace("coalesce(text, '')", "coalesce(lead, '')")}) AS b FROM f),
    s AS (SELECT conv_id, turn, (CASE WHEN contains(form, ' of the ') THEN 4 ELSE 0 END) - (CASE WHEN contains(form, ' ea ') THEN 3 ELSE 0 END) AS role,
      len(list_filter(['the', 'and', 'is', 'de'], lambda x: contains(form, ' ' || x || ' '))) AS skills, len(list_intersect(a, b)) AS shared FROM k)
    SELECT conv_id, turn, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY role DESC, skills DESC, shared DESC, turn) AS rank FROM s) WHERE rank <= 3""",
)
def c9(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("lead", F.first("text").over(W.partitionBy("conv_id").orderBy("turn"))).withColumn("form", tech_text(F.col("text")))
    role = F.when(has_phrase(F.col("form"), "of the"), 4).otherwise(0) - F.when(has_phrase(F.col("form"), "ea"), 3).otherwise(0)
    skills = F.size(hits(F.col("form"), ("the", "and", "is", "de"), phrase=True))
    rows = rows.select("conv_id", "turn", role.alias("role"), skills.alias("skills"), S.overlap(F.col("text"), F.col("lead")).alias("shared"))
    return S.relevance_order(rows, "conv_id", "turn", F.col("role"), F.col("skills"), F.col("shared"), 3).select("conv_id", "turn", "rank")
