"""Scores of postings: four lanes, each a struct(score, reasons), and their cascade."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.text import any_hit, clean_text, hits, let, match_text, tech_text
from larkspur.functions.values import token_set
from larkspur.operators import predicates as P

# Terms of the lanes.
STRONG_TITLES = (
    "data scientist", "associate data scientist", "junior data scientist", "machine learning engineer", "ml engineer", "applied scientist",
    "decision scientist", "data analyst", "product analyst", "business analyst", "analytics engineer", "business intelligence",
    "bi analyst", "insights analyst", "ai engineer", "nlp engineer", "mlops engineer",
)
SKILLS = (
    "python", "sql", "machine learning", "statistics", "statistical", "pandas", "numpy", "power bi", "tableau", "dashboard", "analytics",
    "data visualization", "etl", "experiment", "a/b", "forecast", "classification", "regression", "nlp", "deep learning", "spark",
    "databricks", "airflow",
)
CONTEXT = ("data science", "analytics", "machine learning", "business intelligence", "applied science", "experimentation")
EARLY = ("entry level", "new grad", "associate", "0-2", "0 to 2", "0-3", "0 to 3", "1-3", "1 to 3", "early career")
DOMAINS = (
    "machine learning", "artificial intelligence", "generative ai", "gen ai", "data science", "data analytics", "data engineering",
    "data pipeline", "deep learning", "natural language processing", "computer vision", "predictive model", "recommendation system",
    "ml workload", "ai orchestration", "large language model", "llm",
)
TECH_SKILLS = (
    "python", "sql", "pandas", "numpy", "scikit", "pytorch", "tensorflow", "machine learning", "deep learning", "spark", "databricks",
    "airflow", "tableau", "power bi",
)
EARLY_SIGNALS = ("entry level", "early career", "new grad", "graduate role", "associate", "0-2", "0 to 2", "0-3", "0 to 3", "1-3", "1 to 3", "1+ year", "2+ years")
TITLE_DOMAIN = (
    r"(?i)\b(?:data|analytics?|machine learning|artificial intelligence|generative ai|genai|ai|ml|llm|nlp|computer vision|deep learning|"
    r"applied science|decision science|business intelligence)\b"
)
BODY_DOMAINS = (
    "data engineering", "data science", "data analytics", "machine learning", "artificial intelligence", "generative ai", "deep learning",
    "natural language processing", "computer vision", "business intelligence", "process mining", "process intelligence",
    "predictive model", "large language model", "ai orchestration",
)
CORE_DOMAINS = ("data engineering", "data science", "data analytics", "business intelligence")
CORE_SKILLS = ("python", "sql", "pandas", "numpy", "scikit", "pytorch", "tensorflow", "spark", "databricks", "airflow", "tableau", "power bi", "statistics")
EARLY_ROLE = (
    r"(?i)\b(?:entry[ -]?level|early[ -]?career|new grad|graduate role|associate|"
    r"0\s*(?:-|to)\s*[23]|1\s*(?:-|to|\+)\s*[123]?|2\s*(?:-|to|\+)\s*[35]?)\b"
)
EARLY_ADJACENT = (
    r"(?i)\b(?:entry[ -]?level|early[ -]?career|new grad|graduate role|associate|apprentice|trainee|"
    r"0\s*(?:-|to)\s*[23]|1\s*(?:-|to|\+)\s*[123]?|2\s*(?:-|to|\+)\s*[35]?)\b"
)
PROFILE_SKILLS = (
    "python", "sql", "groovy", "bash", "shell scripting", "git", "github", "github actions", "jenkins", "docker", "podman", "linux",
    "rhel", "jfrog", "artifactory", "ansible", "yaml", "power bi",
)
DATA_SKILLS = ("python", "sql", "pandas", "numpy", "scikit learn", "machine learning", "statistics", "spark", "databricks", "airflow", "etl", "power bi", "tableau")
PLATFORM_SIGNALS = (
    "devops", "platform engineering", "ci cd", "continuous integration", "continuous delivery", "continuous deployment",
    "infrastructure as code", "build automation", "release automation", "deployment automation", "containerized", "containerization",
    "configuration management", "artifact management", "linux systems", "compute infrastructure", "engineering compute",
    "site reliability", "cloud infrastructure", "build pipeline", "deployment pipeline",
)
PLACE_REASON = "Bangalore/Bengaluru or Remote India"
NO_PLACE = "location not clearly Bangalore/Remote India"


@dataclass(frozen=True)
class Settings:
    """Terms that a user may replace."""

    locations: tuple[str, ...] = P.LOCATIONS
    strong_titles: tuple[str, ...] = STRONG_TITLES
    target_titles: tuple[str, ...] = P.TARGET_TITLES
    skills: tuple[str, ...] = SKILLS
    context: tuple[str, ...] = CONTEXT
    early: tuple[str, ...] = EARLY
    blocked: tuple[str, ...] = P.BLOCKED_TITLES
    rejects: tuple[str, ...] = P.EXPERIENCE_REJECTS
    domains: tuple[str, ...] = DOMAINS
    tech_skills: tuple[str, ...] = TECH_SKILLS
    early_signals: tuple[str, ...] = EARLY_SIGNALS


def scored(score: Column | int, *reasons: Column | str | None) -> Column:
    """struct(score, reasons); reasons that are null are left out."""
    score = F.lit(score) if isinstance(score, int) else score
    listed = F.array_compact(F.array(*(F.lit(r) if isinstance(r, str) else r for r in reasons)))
    return F.struct(score.cast("int").alias("score"), listed.cast("array<string>").alias("reasons"))


def points(n: Column, each: int, most: int) -> Column:
    return F.least(n * each, F.lit(most))


def listing(label: str, found: Column, most: int) -> Column:
    """`label: a, b` of the first hits, null without one."""
    return F.when(F.size(found) > 0, F.concat(F.lit(label), F.array_join(F.slice(found, 1, most), ", ")))


@dataclass(frozen=True)
class Posting:
    """The columns of a posting that the lanes read, made once for each row and step."""

    title: Column
    priority: Column
    # normal forms
    low_title: Column
    title_form: Column
    low_text: Column  # title, department, location and description in lower case
    low_body: Column  # the same without the location
    clean: Column  # the description without markup
    form: Column  # match_text of the description, of it with the department, and with the title too
    body_form: Column
    whole_form: Column
    # gates: whether the location passes; reasons of the seniority and of the experience rules, or null
    place: Column
    senior: Column
    experience: Column
    # results of the lanes before
    base: Column
    expanded: Column

    @classmethod
    def of(cls) -> Posting:
        return cls(F.coalesce("title", F.lit("")), F.coalesce(F.col("priority"), F.lit(3)), *map(F.col, (*FORMS, *GATES, "__base", "__expanded")))


#: Columns of the steps, each made from the ones before.
FORMS = ("__low_title", "__title_form", "__low_text", "__low_body", "__clean", "__form", "__body_form", "__whole_form")
GATES = ("__place", "__senior", "__experience")


def wanted(lane: str, s: Settings) -> Column:
    """Whether a posting's description can matter to a lane's result, by its place and title. The production and the precision lane
    tell what experience is asked for, whatever the place."""
    if lane in ("production", "precision"):
        return F.lit(True)
    strong = any_hit(F.col("__low_title"), s.strong_titles)
    titled = {"base": strong, "expanded": strong | P.is_generic_technical(F.coalesce("title", F.lit("")))}.get(lane, F.lit(True))
    return F.col("__place") & titled


def with_forms(df: DataFrame, s: Settings, lane: str) -> DataFrame:
    """df with FORMS and GATES, cheap gates first: a description goes through its normal forms, each once, only where the place and the title
    leave something to it, and loses its markup only where the experience that it asks for does too. Forms of several fields are joined from theirs."""
    fields = {n: F.coalesce(F.col(n), F.lit("")) for n in ("title", "location", "description", "department")}
    place = P.location_matches(fields["location"], s.locations)
    first = once(df.select("*", F.lower(fields["title"]).alias("__low_title"), match_text(fields["title"]).alias("__title_form"), place.alias("__place")))
    first = once(first.select("*", F.when(wanted(lane, s), fields["description"]).otherwise("").alias("__description")))
    lowered = {"location": fields["location"], "description": F.col("__description"), "department": fields["department"]}
    parts = {f"__low_{n}": F.lower(c) for n, c in lowered.items()} | {f"__form_{n}": match_text(lowered[n]) for n in ("description", "department")}
    parts = once(first.select("*", *(c.alias(n) for n, c in parts.items())))
    low = lambda *names: F.concat_ws(" ", *(f"__low_{n}" for n in names))
    form = lambda *names: F.concat_ws(" ", *(F.nullif(F.col("__title_form" if n == "title" else f"__form_{n}"), F.lit("")) for n in names))
    joined = once(
        parts.select(
            *df.columns, "__low_title", "__title_form", "__place", "__description", F.col("__form_description").alias("__form"),
            low("title", "department", "location", "description").alias("__low_text"), low("title", "department", "description").alias("__low_body"),
            low("title", "description").alias("__titled"), form("department", "description").alias("__body_form"),
            form("title", "department", "description").alias("__whole_form"), form("title", "description").alias("__titled_form"),
        )
    )
    senior = P.senior_in(F.col("__low_title"), F.col("__titled"), s.blocked, s.rejects)
    gated = once(joined.select("*", senior.alias("__senior")))
    gated = once(gated.select("*", F.coalesce("__senior", P.stated_minimum(F.col("__titled_form"))).alias("__experience")))
    reads_markup = F.lit(lane in ("precision", "adjacent", "cascade")) & F.col("__experience").isNull()
    return once(gated.select("*", F.when(reads_markup, clean_text(F.col("__description"))).otherwise("").alias("__clean")))


def base_lane(p: Posting, s: Settings) -> Column:
    """Place 25, strong title 45, skills up to 30, context 10, early career 10, priority 5; a seniority reason zeroes all."""

    def result(skills: Column, context: Column, early: Column) -> Column:
        first = p.priority >= 4
        total = 70 + points(F.size(skills), 5, 30) + F.when(context, 10).otherwise(0) + F.when(early, 10).otherwise(0) + F.when(first, 5).otherwise(0)
        return scored(
            F.least(total, F.lit(100)), PLACE_REASON, F.concat(F.lit("role title: "), F.get(hits(p.low_title, s.strong_titles), F.lit(0))),
            listing("skills: ", skills, 6), F.when(context, "data/analytics context"), F.when(early, "early-career signal"), F.when(first, "higher WLB priority company"),
        )

    found = F.struct(hits(p.low_text, s.skills).alias("skills"), any_hit(p.low_text, s.context).alias("context"), any_hit(p.low_text, s.early).alias("early"))
    return (
        F.when(~p.place, scored(0, NO_PLACE))
        .when(~any_hit(p.low_title, s.strong_titles), scored(0, "title does not match a target data/AI/analytics role"))
        .when(p.senior.isNotNull(), scored(0, p.senior))
        .otherwise(let(found, lambda f: result(f["skills"], f["context"], f["early"])))
    )


def expanded_lane(p: Posting, s: Settings) -> Column:
    """base_lane; where it gives 0, technical titles with evidence in the description."""
    text, title = F.concat(F.lit(" "), p.low_body, F.lit(" ")), F.concat(F.lit(" "), p.title_form, F.lit(" "))
    named = F.array_compact(F.array(F.when(F.contains(title, F.lit(" ai ")), "title: AI"), F.when(F.contains(title, F.lit(" ml ")), "title: ML")))

    def result(domains: Column, skills: Column, early: Column) -> Column:
        enough = (F.size(domains) > 0) & ((F.size(domains) >= 2) | (F.size(skills) >= 2) | early.isNotNull())
        total = 60 + points(F.size(domains), 5, 15) + points(F.size(skills), 5, 20) + F.when(early.isNotNull(), 10).otherwise(0) + F.when(p.priority >= 4, 5).otherwise(0)
        return F.when(~enough, scored(0, "generic technical title lacks strong data/AI evidence")).otherwise(
            scored(
                F.least(total, F.lit(100)), PLACE_REASON, "adjacent engineer role verified from description", listing("data/AI context: ", domains, 3),
                listing("skills: ", skills, 5), F.concat(F.lit("early-career signal: "), early), F.when(p.priority >= 4, "higher WLB priority company"),
            )
        )

    found = lambda x: F.struct(
        F.concat(hits(x, s.domains), named).alias("domains"), hits(x, s.tech_skills).alias("skills"), F.get(hits(x, s.early_signals), F.lit(0)).alias("early")
    )
    return (
        F.when(p.base["score"] > 0, p.base)
        .when(~p.place, scored(0, NO_PLACE))
        .when(~P.is_generic_technical(p.title), scored(0, "title does not match a target or adjacent technical role"))
        .when(p.senior.isNotNull(), scored(0, p.senior))
        .otherwise(let(let(text, found), lambda f: result(f["domains"], f["skills"], f["early"])))
    )


def production_lane(p: Posting, s: Settings) -> Column:
    return F.when(p.experience.isNotNull(), scored(0, p.experience)).otherwise(p.expanded)


def precision_lane(p: Posting, s: Settings) -> Column:
    """production_lane for target titles; stricter gates for broad ones, whose score ends at 85 without a domain in the title."""
    expanded = p.expanded
    capped = F.struct(
        F.least(expanded["score"], F.lit(85)).alias("score"), F.array_append(expanded["reasons"], F.lit("generic title passed strict profile-overlap check")).alias("reasons")
    )

    def overlaps(domains: Column, skills: Column) -> Column:
        stack = (F.size(skills) >= 3) & F.arrays_overlap(domains, F.array(*map(F.lit, CORE_DOMAINS)))
        return stack | (p.form.rlike(EARLY_ROLE) & (F.size(domains) >= 1) & (F.size(skills) >= 2))

    found = F.struct(hits(p.form, BODY_DOMAINS).alias("domains"), hits(p.form, CORE_SKILLS).alias("skills"))
    return (
        F.when(p.title.rlike(P.OTHER_CITY_TITLE), scored(0, "title requires a non-target city rather than Remote India"))
        .when(p.experience.isNotNull(), scored(0, p.experience))
        .when(any_hit(p.low_title, s.target_titles), expanded)
        .when(~P.is_generic_technical(p.title), scored(0, "title does not match a target or adjacent technical role"))
        .when(p.title.rlike(P.SUPPORT_TITLE), scored(0, "adjacent title belongs to support/general application engineering"))
        .when(F.substring(p.clean, 1, 1200).rlike(P.SENIOR_OPENING), scored(0, "description identifies the role itself as senior"))
        .when((expanded["score"] == 0) | p.title.rlike(TITLE_DOMAIN), expanded)
        .when(let(found, lambda f: overlaps(f["domains"], f["skills"])), capped)
        .otherwise(scored(0, "generic title lacks enough profile-specific data/AI evidence"))
    )


def adjacent_lane(p: Posting, s: Settings) -> Column:
    """Platform and data roles next to the target ones, by whole phrases; ends at 95."""
    found = F.struct(
        hits(p.body_form, PROFILE_SKILLS, phrase=True).alias("profile"), hits(p.body_form, DATA_SKILLS, phrase=True).alias("data"),
        hits(p.whole_form, PLATFORM_SIGNALS, phrase=True).alias("signals"), p.body_form.rlike(EARLY_ADJACENT).alias("early"),
    )

    def result(profile: Column, data: Column, signals: Column, early: Column) -> Column:
        named, n_profile, n_signals = p.title.rlike(P.PLATFORM_TITLE), F.size(profile), F.size(signals)
        generic = (early & (n_signals >= 2) & (n_profile >= 4)) | ((n_signals >= 3) & (n_profile >= 5))
        platform = F.when(named, (n_signals >= 1) & (n_profile >= 3)).otherwise(P.is_generic_technical(p.title) & (n_signals > 0) & generic)
        extra = F.when(early, 10).otherwise(0) + F.when(p.priority >= 4, 5).otherwise(0)
        last = (F.when(early, "early-career signal"), F.when(p.priority >= 4, "higher WLB priority company"))
        return (
            F.when(
                platform,
                scored(
                    F.least(60 + points(n_profile, 5, 20) + points(n_signals, 5, 10) + extra, F.lit(95)), PLACE_REASON, "resume lane: DevOps/platform/build automation",
                    F.concat(F.lit("resume skills: "), F.array_join(F.slice(profile, 1, 6), ", ")), listing("platform context: ", signals, 3), *last,
                ),
            )
            .when(
                p.title.rlike(P.DATA_ADJACENT_TITLE) & (F.size(data) >= 2),
                scored(F.least(65 + points(F.size(data), 5, 20) + extra, F.lit(95)), PLACE_REASON, "resume lane: data engineering/data science", listing("resume skills: ", data, 6), *last),
            )
            .otherwise(scored(0, "role lacks enough evidence for a resume-aligned adjacent lane"))
        )

    return (
        F.when(~p.place, scored(0, NO_PLACE))
        .when(p.experience.isNotNull(), scored(0, p.experience))
        .when(p.title.rlike(P.NON_PROFILE_TITLE), scored(0, "role family does not overlap the resume target lanes"))
        .when(p.title.rlike(P.ADVISOR_TITLE), scored(0, "title indicates an experienced advisory level"))
        .when(F.substring(p.clean, 1, 1600).rlike(P.SENIOR_DESCRIPTION), scored(0, "description identifies an experienced/senior role"))
        .when(p.clean.rlike(P.THREE_YEARS), scored(0, "adjacent role requires 3+ years; above demonstrated experience"))
        .otherwise(let(found, lambda f: result(f["profile"], f["data"], f["signals"], f["early"])))
    )


#: Phrases that are broadcast; more are joined by a shuffle.
MAX_PHRASES = 100_000
LANES = {"base": base_lane, "expanded": expanded_lane, "production": production_lane, "precision": precision_lane, "adjacent": adjacent_lane}


def score_postings(df: DataFrame, settings: Settings | None = None, lane: str = "cascade") -> DataFrame:
    """df(title, location, description, department, priority) with score and reasons of a lane; the
    cascade takes the precision lane where it scores, else the adjacent one."""
    s, p = settings or Settings(), Posting.of()
    steps = with_forms(df, s, lane)
    steps = once(once(steps.select("*", base_lane(p, s).alias("__base"))).select("*", expanded_lane(p, s).alias("__expanded")))
    if lane != "cascade":
        return once(steps.select("*", LANES[lane](p, s).alias("lane"))).select(*df.columns, "lane.score", "lane.reasons")
    both = once(steps.select("*", precision_lane(p, s).alias("precise"), adjacent_lane(p, s).alias("adjacent")))
    degree = scored(0, "title requires a PhD/doctoral qualification not in the resume")
    chosen = F.when(F.col("title").rlike(P.DEGREE_TITLE), degree).when(F.col("precise.score") > 0, F.col("precise"))
    chosen = chosen.otherwise(F.when(F.size("adjacent.reasons") > 0, F.col("adjacent")).otherwise(F.col("precise")))
    return both.select(*df.columns, chosen.alias("lane")).select(*df.columns, "lane.score", "lane.reasons")


def once(df: DataFrame) -> DataFrame:
    """df behind a one-row generator, across which the optimiser doesn't copy expressions: each is computed once."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def phrase_score(df: DataFrame, phrases: DataFrame, text: str, key: str) -> DataFrame:
    """(key, family, score): summed weights of phrases(family, phrase, weight) that a text has. Texts meet phrases on the phrase's first word."""
    listed = phrases.select("family", tech_text(F.col("phrase")).alias("phrase"), "weight").withColumn("word", F.substring_index("phrase", " ", 1))
    normal = df.select(F.col(key), tech_text(F.col(text)).alias("normal"))
    asked = normal.select(key, "normal", F.explode(F.array_distinct(F.split("normal", " "))).alias("word"))
    met = asked.join(F.broadcast(listed) if listed.count() <= MAX_PHRASES else listed.hint("merge"), "word")
    met = met.where(F.contains(F.concat(F.lit(" "), "normal", F.lit(" ")), F.concat(F.lit(" "), "phrase", F.lit(" "))))
    return met.groupBy(key, "family").agg(F.sum("weight").cast("long").alias("score"))


def overlap(a: Column, b: Column) -> Column:
    """Tokens that both texts have."""
    return F.size(F.array_intersect(token_set(a), token_set(b)))


def relevance_order(df: DataFrame, group: str, index: str, role: Column, skills: Column, shared: Column, most: int | None = None) -> DataFrame:
    """df with `rank` of each group's rows: by role score, skill hits and shared tokens, most first, then by index; the first `most` if given."""
    order = [role.desc(), skills.desc(), shared.desc(), F.col(index).asc()]
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return ranked if most is None else ranked.where(F.col("rank") <= most)
