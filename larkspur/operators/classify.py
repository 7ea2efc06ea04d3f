"""Classification of sources and pages by ordered rules, and the merge of probe results."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import urls as U
from larkspur.operators.relational import add_missing, last_per_key, stored
from larkspur.operators.state import key_filter, possible

RULE_SCHEMA = "priority int, kind string, pattern string, ats string, attrs map<string,string>"
#: Rules, and bytes of their texts, that are broadcast; more are joined by a shuffle.
MAX_RULES, MAX_RULE_BYTES = 400_000, 64_000_000
#: Lengths of the runs of characters that path rules are looked up by: each by the longest that its pattern has, as few rules share long runs.
RUNS = (3, 6, 12, 24)
#: Rules that may share a whole word of their patterns to be looked up by it; a path has few words and many runs.
WORD_RULES = 16
#: Addresses of a turn: what their lookups shuffle is removed before the next turn.
TURN = 50_000_000

# Hosts of the common providers, and what a source's address says about its board.
SLUG = {"slug": "{first}", "career_site_url": "{url}"}
SITE = {"url": "{url}", "career_site_url": "{url}"}
PROVIDER_RULES = (
    (101, "host", "job-boards.greenhouse.io", "greenhouse", SLUG),
    (102, "host", "jobs.lever.co", "lever", SLUG),
    (103, "host", "jobs.ashbyhq.com", "ashby", SLUG),
    (104, "host", "careers.smartrecruiters.com", "smartrecruiters", SLUG),
    (105, "host", "myworkdayjobs.com", "workday_search", {"tenant": "{label}", "site": "{last}", "url": "{origin}/wday/cxs/{label}/{last}/jobs", "career_site_url": "{url}"}),
    (106, "host", "apply.workable.com", "workable", SLUG | {"url": "https://www.workable.com/api/accounts/{first}?details=true"}),
    (107, "host", "freshteam.com", "freshteam_html", SITE),
    (108, "host", "keka.com", "keka_embed", SITE),
    (109, "host", "icims.com", "icims_html", {"url": "{origin}/jobs/search", "career_site_url": "{url}"}),
    (110, "host", "jobs.jobvite.com", "jobvite_html", SLUG | {"url": "https://jobs.jobvite.com/{first}/?nl=1&fr=false"}),
    (111, "host", "recruiterflow.com", "recruiterflow_html", SITE),
    (112, "host", "peoplestrong.com", "peoplestrong", {"url": "{origin}/api/cp/rest/altone/cp/jobs/v1?offset=0&limit=100", "bootstrap_url": "{origin}/api/cp/rest/altone/cp/urlinfo", "career_site_url": "{url}"}),
    (113, "host", "zohorecruit.com", "zoho_recruit_public", SITE),
    (114, "host", "careers.kula.ai", "kula_html", SITE),
    (115, "host", "hire.trakstar.com", "trakstar_html", SITE),
    (116, "host", "sensehq.com", "sensehq_next_data", SITE),
    (117, "host", "app.param.ai", "param_ai", {"url": "{origin}/api/career/get_job/", "career_site_url": "{url}"}),
    (118, "host", "app.eightfold.ai", "eightfold_html", SITE),
)


def filled(attrs: Column, url: Column) -> Column:
    """attrs with {url}, {origin}, {host}, {label} (the host's first label), {first} and {last} (path segments) of the address put in."""
    segments = F.filter(U.segments(url), lambda s: ~s.rlike("(?i)^[a-z]{2}[-_][a-z]{2}$"))
    parts = {
        "{url}": url, "{origin}": F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]+)", 1), "{host}": U.host(url), "{label}": F.substring_index(U.host(url), ".", 1),
        "{first}": F.coalesce(F.get(segments, F.lit(0)), F.lit("")), "{last}": F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit("")),
    }

    def put_in(value: Column) -> Column:
        for name, part in parts.items():
            value = F.replace(value, F.lit(name), F.coalesce(part, F.lit("")))
        return value

    return F.transform_values(attrs, lambda _, v: put_in(v))


def runs_of(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text, none of a shorter one."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def words_of(text: Column) -> Column:
    """The distinct whole words of a text, each with the character before it: a text that holds another has all of the other's."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("([^a-z0-9][a-z0-9]++)(?=[^a-z0-9])"), F.lit(1)))


def rarest(parts: DataFrame) -> DataFrame:
    """(run, rule, rules): of parts(rule, run, n) each rule with the run that the fewest rules have of its n, and how many these are; without a run both are null."""
    counts = stored(parts.where("run is not null").groupBy("run").agg(F.count("*").alias("rules")), lean=True)
    met = parts.join(counts.hint("merge"), "run", "left")
    least = F.min_by(F.struct("run", "rule", "rules"), F.struct("rules", "run")).alias("r")
    chosen = met.where("n > 1").groupBy("rule.priority", "rule.ats", "rule.part", F.to_json("rule.attrs")).agg(least).select("r.*")
    return met.where("n <= 1").select("run", "rule", "rules").union(chosen)  # one run leaves no choice


def indexed_rules(rules: DataFrame) -> DataFrame:
    """(__key, rule), stored: each rule under what it is looked up by: a name, a host, or of a path rule's whole words the one that the fewest rules
    have; where it has none or more than WORD_RULES have it, of the pattern's runs the one that the fewest of these rules have. Of rules with
    the same kind and pattern only the first is there, as the others fit nothing else."""
    rule = F.struct("priority", "ats", "attrs", F.when(F.col("kind") == "path", F.lower("pattern")).alias("part"))
    exact = rules.where("kind <> 'path'").select(F.concat("kind", F.lit(":"), F.lower("pattern")).alias("__key"), rule.alias("rule"))
    low = F.lower("pattern")
    runs = F.array(low)
    for n in RUNS:
        runs = F.when(F.length(low) >= n, runs_of(low, n)).otherwise(runs)
    paths = rules.where("kind = 'path' and pattern <> ''").select(rule.alias("rule"))
    parts = lambda df, found: df.select("rule", F.size(found).alias("n"), F.explode_outer(found).alias("run"))
    worded = stored(rarest(parts(paths, words_of(F.col("rule.part")))), lean=True)
    known = F.coalesce(F.col("rules") <= WORD_RULES, F.lit(False))
    rest = worded.where(~known).select("rule", F.col("rule.part").alias("pattern"))
    others = rarest(parts(rest, runs)).select(F.concat(F.lit("path:"), "run").alias("__key"), "rule")
    by_word = worded.select(F.concat(F.lit("word:"), "run").alias("__key"), "rule", "rules")
    shared = exact.union(others).union(by_word.where(known & (F.col("rules") > 1)).drop("rules"))
    first = shared.groupBy("__key", "rule.part").agg(F.min_by("rule", F.struct("rule.priority", "rule.ats")).alias("rule"))
    return by_word.where("rules = 1").drop("rules").union(stored(first.select("__key", "rule"), lean=True))


def keys_of(low: DataFrame, name: str, url: str, kinds: set[str], lengths: list[int]) -> DataFrame:
    """(__id, key, __path): what the rows of low are looked up by, of the kinds of keys and the lengths of runs that an index has; the path
    where a rule's part must be in it, else null."""
    none, path = F.lit(None).cast("string").alias("__path"), F.lower(U.path(F.col(url))).alias("__path")
    labels = F.split(U.host(F.col(url)), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    in_paths = low.select("__id", path)
    sized = in_paths.select("*", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("__n")).where(F.length("__path") >= F.col("__n"))
    spots = sized.select("*", F.explode(F.sequence(F.lit(1), F.length("__path") - F.col("__n") + 1)).alias("__at"))
    pieces = {
        "name": low.select("__id", F.lower(name).alias("__piece"), none),
        "host": low.select("__id", F.explode(parents).alias("__piece"), none),
        "word": in_paths.select("__id", F.explode(words_of(F.col("__path"))).alias("__piece"), "__path"),
        "path": spots.select("__id", F.substring("__path", F.col("__at"), F.col("__n")).alias("__piece"), "__path"),
    }
    keys = [p.select("__id", F.concat(F.lit(f"{kind}:"), "__piece").alias("key"), "__path") for kind, p in pieces.items() if kind in kinds]
    return reduce(DataFrame.union, keys or [low.select("__id", none.alias("key"), none).limit(0)]).where("key is not null")


def is_small(index: DataFrame) -> bool:
    """Whether the stored index is within MAX_RULES and MAX_RULE_BYTES."""
    size = F.coalesce(F.sum(F.octet_length("__key") + F.octet_length(F.to_json("rule"))), F.lit(0))
    return index.count() <= MAX_RULES and index.agg(size).first()[0] <= MAX_RULE_BYTES


def looked_up(keys: DataFrame, index: DataFrame, blocks: tuple[DataFrame, int] | None) -> DataFrame:
    """(__id, priority, ats, attrs) of the rules of the stored index that fit keys(__id, key, __path): found by a hash of the key, and held against the path, or
    against the key where __path is null. With blocks (`key_filter` of the index) both are shuffled, of keys only those that the filter lets
    through; without, the index is broadcast."""
    rules = index.select(F.xxhash64("__key").alias("__hash"), F.when(F.col("rule.part").isNull(), F.col("__key")).alias("__text"), "rule")
    rules = F.broadcast(rules) if blocks is None else rules.hint("merge")
    keys = keys if blocks is None else possible(keys, *blocks)
    asked = keys.select("__id", "__path", F.xxhash64("key").alias("__hash"), F.when(F.col("__path").isNull(), F.col("key")).alias("__exact"))
    fits = F.coalesce(F.contains("__path", F.col("rule.part")), F.col("__exact") == F.col("__text"), F.lit(False))
    return asked.join(rules, "__hash").where(fits).select("__id", "rule.priority", "rule.ats", "rule.attrs")


def classify_sources(df: DataFrame, rules: DataFrame, name: str, url: str, default: str = "direct_job_html") -> DataFrame:
    """df with `ats` and `attrs`: those of the first rule that fits, by priority, with the parts of the address put in (`filled`).

    A rule (RULE_SCHEMA) fits a name exactly (kind `name`), a host or its subdomains (`host`) or a part of the path (`path`).
    All are looked up by equality, in one join: names, hosts with their parent domains, and path rules by the rarest of their whole words
    or else of their runs of characters (RUNS); only the found ones are compared with the path. The plan doesn't grow with the rules.
    Addresses are looked up in turns of TURN, and only for kinds of keys that the index has.
    """
    low = stored(df.withColumn("__id", F.monotonically_increasing_id()), lean=True)  # from here on the ids hold
    index = indexed_rules(rules)
    kind = F.substring_index("__key", ":", 1)
    size = F.when(kind == "path", F.length("__key") - F.lit(len("path:")))  # below the least of RUNS, or one of them
    parted = F.exists(F.map_values("rule.attrs"), lambda v: F.contains(v, F.lit("{")))
    has = index.where(kind.isin("name", "host", "word", "path")).groupBy(kind.alias("kind"), size.alias("size")).agg(F.max(parted).alias("parted")).collect()
    kinds, lengths = {r.kind for r in has}, sorted(r.size for r in has if r.kind == "path")
    turns = max(1, math.ceil(low.count() / TURN))
    blocks = None if is_small(index) else key_filter(index.select(F.col("__key").alias("key")))
    keys = [keys_of(low.where(F.pmod("__id", F.lit(turns)) == t), name, url, kinds, lengths) for t in range(turns)]
    hits = [looked_up(k, index, blocks).repartition("__id") for k in keys]
    first = [h.groupBy("__id").agg(F.min_by(F.struct("ats", "attrs"), F.struct("priority", "ats")).alias("exact")) for h in hits]
    found = low.join(stored(*first, lean=True).hint("merge"), "__id", "left")
    none = F.create_map().cast("map<string,string>")
    attrs = F.coalesce(filled(F.col("exact.attrs"), F.col(url)) if any(r.parted for r in has) else F.col("exact.attrs"), none)
    return found.withColumn("ats", F.coalesce("exact.ats", F.lit(default))).withColumn("attrs", attrs).select(*df.columns, "ats", "attrs")


def page_status(http: Column, redirected: Column, provider: Column, jobs: Column, no_openings: Column, dynamic: Column, resolved: Column) -> Column:
    """struct(status, resolved_status) of a careers page by the recorded evidence."""
    direct = (
        F.when(http.isin(401, 403, 429), "BLOCKED")
        .when(http.isNull() | (http >= 400), "BROKEN")
        .when(jobs > 0, "WORKING")
        .when(no_openings | ((provider != "") & (jobs == 0)), "NO_JOBS")
        .when(dynamic, "DYNAMIC")
        .otherwise("NO_PUBLIC_BOARD")
    )
    moved = redirected & ~direct.isin("BLOCKED", "BROKEN")
    return F.struct(F.when(moved, "REDIRECT").otherwise(direct).alias("status"), F.when(moved, F.coalesce(resolved, direct)).alias("resolved_status"))


def source_verdict(error: Column, fetched: Column, matched: Column, monitorable: Column) -> Column:
    return (
        F.when(error.isNotNull(), "FAILED").when(matched > 0, "WORKING").when((fetched > 0) | monitorable, "NO_CURRENT_MATCHING_JOBS").otherwise("UNRESOLVED_DYNAMIC_SOURCE")
    )


def first_supported_link(links: DataFrame, key: str) -> DataFrame:
    """(key, href, provider) of the first link of a page that a provider has; links(kind, pos, href), frames before anchors."""
    known = links.withColumn("provider", U.provider(F.col("href"))).where("provider <> ''")
    order = F.struct(F.when(F.col("kind") == "iframe", 0).otherwise(1).alias("k"), "pos")
    return known.groupBy(key).agg(F.min_by(F.struct("href", "provider"), order).alias("l")).select(key, "l.href", "l.provider")


def merge_probes(parts: DataFrame, key: str, verified: str, order: str) -> DataFrame:
    """The last result of each key among verified ones, and of the other keys among the rest."""
    return add_missing(last_per_key(parts.where(F.col(verified)), key, order), last_per_key(parts.where(~F.col(verified)), key, order), key)
