"""Filters over postings and sources: boolean columns and columns with the reason of a rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import any_hit, clean_text, compact_text, folded, hits, let, match_text
from larkspur.functions.urls import is_public

# Terms and patterns of the default settings.
LOCATIONS = ("bangalore", "bengaluru", "karnataka", "india remote", "remote india")
TARGET_TITLES = (
    "data scientist", "machine learning engineer", "ml engineer", "applied scientist", "decision scientist", "data analyst",
    "product analyst", "business analyst", "analytics engineer", "business intelligence", "bi analyst", "insights analyst",
    "ai engineer", "nlp engineer", "mlops engineer",
)
BLOCKED_TITLES = (
    "senior", "sr.", "sr ", "staff", "principal", "lead", "manager", "director", "architect", "head of", "vp ", "avp", "svp",
    "vice president", "internship manager", "sales", "recruiter", "talent acquisition", "data center", "database administrator", "dba",
)
EXPERIENCE_REJECTS = (
    "4+ years", "5+ years", "6+ years", "7+ years", "8+ years", "9+ years", "10+ years",
    "minimum 4 years", "minimum 5 years", "at least 4 years", "at least 5 years",
)
MANY_YEARS = r"\b([4-9]|1[0-5])\s*\+?\s*(years|yrs)\b"
LEAST_YEARS = r"\b(?:minimum|min|at least|requires?|required)\s+([0-9]+)\s*(?:plus\s+)?year(?:s|\s+s)?\b"
PLUS_YEARS = r"\b([0-9]+)\s*(?:plus|\+)\s*year(?:s|\s+s)?\b"
GENERIC_TITLE = (
    r"(?i)\b(?:engineer|developer|technical analyst|program analyst|research associate|"
    r"(?:devops|platform|automation|cloud|infrastructure) specialist|"
    r"(?:systems|devops) administrator|graduate engineer|engineering apprentice)\b"
)
PLATFORM_TITLE = (
    r"(?i)\b(?:devops|platform|build(?: and)? release|release engineering|build engineering|automation|infrastructure|"
    r"site reliability|cloud operations|compute operations|engineering compute)\b"
)
DATA_ADJACENT_TITLE = r"(?i)\b(?:data engineer|data platform engineer|data pipeline engineer|etl developer|data science|analytics developer)\b"
SUPPORT_TITLE = (
    r"(?i)\b(?:technical support|support engineer|customer engineer|customer success|technical services|application engineer|"
    r"solutions? engineer|full[ -]?stack|front[ -]?end|back[ -]?end|integrations? engineer|devops engineer|site reliability)\b"
)
NON_PROFILE_TITLE = (
    r"(?i)\b(?:technical support|customer engineer|customer success|field service|sales|full[ -]?stack|front[ -]?end|back[ -]?end|"
    r"physical design|silicon|rtl|firmware|embedded|electrical|mechanical|verification engineer)\b"
)
ADVISOR_TITLE = r"(?i)\badvisor\b"
DEGREE_TITLE = r"(?i)\b(?:ph\.?d\.?|doctorate|doctoral)\b"
OTHER_CITY_TITLE = r"(?i)\b(?:based|located)\s+in\s+(?:hyderabad|pune|chennai|mumbai|gurgaon|gurugram|noida|delhi|kolkata)\b"
SENIOR_OPENING = r"(?i)\b(?:seeking|looking for|hiring)\s+(?:an?\s+)?senior\b"
SENIOR_DESCRIPTION = r"(?i)\b(?:senior contributor|senior[ -]level|seasoned professional|experienced (?:software|platform|devops|data) engineer)\b"
THREE_YEARS = r"(?i)\b(?:minimum|min|at least|requires?|required|bring|have|with)?\s*(3(?:\.0)?)\s*(?:plus|\+)\s*year(?:s|\s+s)?\b"
NO_OPENINGS = r"(?i)\b(?:currently\s+)?(?:have\s+)?no\s+(?:current\s+|open\s+)?(?:jobs?|openings?|positions?|roles?|vacancies)\b"
IGNORED_BRAND_WORDS = (
    "careers", "career", "jobs", "job", "at", "the", "company", "companies", "inc", "ltd", "limited", "llc", "corp", "corporation",
    "group", "holdings", "technology", "technologies", "software", "solutions", "services", "systems", "global", "international",
    "india", "private", "pvt",
)
GENERIC_BOARD_WORDS = ("external", "website", "product", "products", "recruiting", "recruitment", "team", "north", "america", "opportunities", "io")
INVALID_BOARDS = (("linkedin", "lever"), ("porter", "lever"), ("bounce", "ashby"))


def location_matches(location: Column, terms: tuple[str, ...] = LOCATIONS) -> Column:
    """Marked remote (or the city's code) within the country, or a configured place as a whole phrase."""

    def matches(n: Column) -> Column:
        has = lambda w: F.array_contains(F.split(n, " "), w)
        near = (has("remote") | has("blr")) & (has("india") | has("ind"))
        return (n != "") & (near | (F.size(hits(n, tuple(terms), phrase=True)) > 0))

    return let(match_text(location), matches)


def is_target_title(title: Column, terms: tuple[str, ...] = TARGET_TITLES) -> Column:
    return any_hit(F.lower(title), terms)


def is_generic_technical(title: Column) -> Column:
    return title.rlike(GENERIC_TITLE)


def is_broad_title(title: Column) -> Column:
    return is_target_title(title) | is_generic_technical(title) | title.rlike(PLATFORM_TITLE) | title.rlike(DATA_ADJACENT_TITLE)


def seniority_reason(title: Column, body: Column, blocked: tuple[str, ...] = BLOCKED_TITLES, rejects: tuple[str, ...] = EXPERIENCE_REJECTS) -> Column:
    """Why a posting is too senior, in the order of the rules; null if it isn't."""
    low, low_body = F.lower(title), F.lower(F.coalesce(body, F.lit("")))
    return let(low, lambda x: let(F.concat(x, F.lit(" "), low_body), lambda text: senior_in(x, text, blocked, rejects)))


def senior_in(low: Column, text: Column, blocked: tuple[str, ...], rejects: tuple[str, ...]) -> Column:
    """seniority_reason of a lower-case title, and of it with the lower-case body."""
    return (
        F.when(low.rlike(r"\b(?:avp|svp|vp)\b"), "blocked seniority abbreviation")
        .when(any_hit(low, blocked), F.concat(F.lit("blocked title term: "), F.get(hits(low, blocked), F.lit(0))))
        .when(any_hit(text, rejects), F.concat(F.lit("too much experience: "), F.get(hits(text, rejects), F.lit(0))))
        .when(text.rlike(MANY_YEARS), F.concat(F.lit("experience appears too high: "), F.regexp_extract(text, MANY_YEARS, 0)))
    )


def experience_reason(title: Column, body: Column, **terms) -> Column:
    """seniority_reason, then a stated minimum of four years or more."""
    return F.coalesce(seniority_reason(title, body, **terms), let(match_text(F.concat_ws(" ", title, body)), stated_minimum))


def stated_minimum(n: Column) -> Column:
    """The reason that a normal form gives by a minimum of four years or more."""
    least, plus = (F.regexp_extract(n, p, 1) for p in (LEAST_YEARS, PLUS_YEARS))
    return F.coalesce(
        F.when(least.try_cast("double") >= 4, F.concat(F.lit("experience minimum too high: "), least, F.lit(" years"))),
        F.when(plus.try_cast("double") >= 4, F.concat(F.lit("experience minimum too high: "), plus, F.lit("+ years"))),
    )


def in_opening(description: Column, pattern: str, chars: int) -> Column:
    """Whether the pattern occurs in the first characters of the cleaned description."""
    return F.substring(clean_text(description), 1, chars).rlike(pattern)


def in_scope(fields: list[Column], required: Column, excluded: Column) -> Column:
    """A source's scope: its required keyword occurs in the fields and its excluded one doesn't; null keywords ask nothing."""
    text = match_text(F.concat_ws(" ", *fields))
    return F.coalesce(F.contains(text, match_text(required)), F.lit(True)) & ~F.coalesce(
        F.contains(text, match_text(excluded)) & (match_text(excluded) != ""), F.lit(False)
    )


def split_readable(df: DataFrame, body: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON body can be read, with it as `record`, and the rest, with the error."""
    read = df.withColumn("record", F.from_json(body, schema, {"mode": "PERMISSIVE"})).withColumn("valid", F.try_parse_json(F.col(body)).isNotNull())
    good = read.where("valid").drop("valid")
    bad = read.where(~F.col("valid")).drop("valid", "record").withColumn("error", F.lit("malformed payload"))
    return good, bad


def is_record(title: Column, url: Column) -> Column:
    return (F.trim(F.coalesce(title, F.lit(""))) != "") & is_public(url)


def is_open(*flags: Column) -> Column:
    """Every flag that is given is true."""
    out = F.lit(True)
    for flag in flags:
        out = out & F.coalesce(flag, F.lit(True))
    return out


def page_evidence(html: Column, posting_count: Column, link_count: Column) -> Column:
    """What shows that a page can be watched: stated lack of openings, structured postings, links to postings, or nothing."""
    return (
        F.when(clean_text(html).rlike(NO_OPENINGS), "explicit_no_openings")
        .when(posting_count > 0, "jobposting_jsonld")
        .when(link_count > 0, "server_rendered_job_links")
        .otherwise("no_verifiable_job_records")
    )


def brand_words(name: Column, ignored: tuple[str, ...] = IGNORED_BRAND_WORDS) -> Column:
    """Distinct words of a name but for those that name no brand, in order of the alphabet."""
    words = F.filter(F.split(match_text(name), " "), lambda w: (w != "") & ~w.isin(*ignored))
    return F.array_sort(F.array_distinct(words))


def same_identity(expected: Column, actual: Column) -> Column:
    """Equal names in compact form, or equal brand words, or an expected name of six letters or more within the actual one."""
    e, a = compact_text(expected), compact_text(actual)
    we, wa = brand_words(expected), brand_words(actual)
    return (e != "") & (a != "") & ((e == a) | ((F.size(we) > 0) & (we == wa)) | ((F.length(e) >= 6) & F.contains(a, e)))


def same_board(expected: Column, actual: Column, generic: tuple[str, ...] = GENERIC_BOARD_WORDS) -> Column:
    """Equal brand words, or the actual ones add generic words alone."""
    we, wa = brand_words(expected), brand_words(actual)
    extra = F.array_except(F.array_except(wa, we), F.array(*map(F.lit, generic)))
    return (F.size(we) > 0) & (F.size(wa) > 0) & ((we == wa) | ((F.size(F.array_except(we, wa)) == 0) & (F.size(extra) == 0)))


def promotion_reason(name: Column, ats: Column, enabled: Column, jobs: Column, verified_name: Column, invalid: tuple = INVALID_BOARDS) -> Column:
    """Why a discovered source isn't promoted; null if it is."""
    low = F.lower(ats)
    known = F.lit(False)
    for n, a in invalid:
        known = known | ((folded(name) == n) & (low == a))
    return (
        F.when(~F.coalesce(enabled, F.lit(True)), "disabled")
        .when((F.coalesce(jobs, F.lit(0)) <= 0) & (low != "greenhouse"), "no observed postings")
        .when(known, "known test or unrelated board")
        .when(low == "recruitee", "provider response does not prove company identity")
        .when((low == "greenhouse") & ~same_board(name, F.coalesce(verified_name, F.lit(""))), "Greenhouse board name does not match company identity")
    )


def is_observed(ats: Column, jobs: Column) -> Column:
    return (ats == "greenhouse") | (F.coalesce(jobs, F.lit(0)) > 0)


def path_has_term(path: Column, terms: tuple[str, ...]) -> Column:
    return any_hit(match_text(path), terms)


def is_dynamic(status: Column, resolved: Column) -> Column:
    return (status == "DYNAMIC") | ((status == "REDIRECT") & F.coalesce(resolved == "DYNAMIC", F.lit(False)))


