"""URL filters: pattern rules indexed by their rarest literal token.

Two kinds of rules. A *list rule* (`example.net/en/`) names a host and a path
prefix; it fits that host and its subdomains, and the longest one that fits
decides. A *pattern rule* is a regular expression over host and path that blocks
when no list rule fits; a URL that no rule fits is allowed.

Each rule is stored under one of the literal tokens that a fitting URL must
contain: the one in the fewest URLs of the table. A URL's tokens fetch its
candidate rules, and regular expressions run on those
candidates alone. Rules without a literal token are candidates of every URL. The
rule index is broadcast up to MAX_RULES rules. Beyond that URLs and rules are shuffled by token, after
tokens that many URLs but no rule has are dropped; rules without a token are broadcast in blocks of MAX_RULES.

Null URLs and URLs without `://` have an empty host and path and are allowed; URLs are read whole, however
long; of list rules of equal length that fit, the last one in order of their text decides, and a block before an
allow of the same text; repeated rows keep their row each; an empty table gives an empty result; an input column
with an output's name is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common

MAX_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    rule: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    listed: bool


def list_rule(rule: str, verdict: str) -> Rule:
    """A rule `host/path-prefix`."""
    host, _, path = rule.partition("/")
    host = host.lower()
    whole = [*re.split(r"[^0-9A-Za-z]+", host), *re.findall(r"[/._~-]([0-9A-Za-z]+)(?=[^0-9A-Za-z])", f"/{path}")]
    return Rule(rule, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", tuple(t for t in whole if t and t.isascii()), True)


def pattern_rule(name: str, regex: str, tokens: tuple[str, ...]) -> Rule:
    """A blocking regular expression over host and path; every fitting URL has all of `tokens`."""
    return Rule(name, "block", regex, tokens, False)


#: The rules of the contract.
LIST_RULES = (
    list_rule("net/", "block"),
    list_rule("example.net/en/", "allow"),
    list_rule("example.com/de/", "block"),
    list_rule("org/fr/", "allow"),
)

#: What the method itself blocks: link farms, adult and betting hosts, account and checkout pages.
PATTERN_RULES = (
    pattern_rule("host:spam-farm", r"^(?:[^/]*\.)?spam-farm\.", ("spam", "farm")),
    *(pattern_rule(f"host:{w}", rf"^(?:[^/]*[.-])?{w}[.-]", (w,)) for w in ("ads", "adserver", "casino", "porn", "xxx", "tracker", "doubleclick")),
    *(pattern_rule(f"path:{w}", rf"/{w}(?:[/.]|$)", (w,)) for w in ("login", "signin", "signup", "cart", "checkout", "logout")),
)


def host_of(url: Column) -> Column:
    return common.ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct runs of ASCII letters and digits of host and path."""
    return F.array_distinct(F.filter(F.split(F.concat(host, F.lit("/"), path), r"[^0-9A-Za-z]+"), lambda t: t != ""))


def rule_index(urls: DataFrame, rules: tuple[Rule, ...], max_rules: int) -> list[tuple]:
    """(token, rule, verdict, regex, rank) by each rule's rarest token in urls(tokens)."""
    wanted = sorted({t for r in rules for t in r.tokens})
    spark = urls.sparkSession
    counts = {}
    if wanted:
        known = spark.createDataFrame([(t,) for t in wanted], "token string")
        if len(wanted) <= max_rules:
            found = urls.select(F.explode("tokens").alias("token")).join(F.broadcast(known), "token", "left_semi").groupBy("token").count()
        else:  # counted first, so that a token of many URLs is one row in the join
            found = urls.select(F.explode("tokens").alias("token")).groupBy("token").count().join(known.hint("merge"), "token", "left_semi")
        counts = dict(found.collect())  # one row for each token of a rule at most
    return [
        (min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), r.rule, r.verdict, r.regex, len(r.rule) if r.listed else 0)
        for r in rules
    ]


INDEX = "token string, rule string, verdict string, regex string, rank int"
#: A token in more than one of so many URLs is dropped before the shuffle if no rule is stored under it.
COMMON = 1000


def candidates(urls: DataFrame, index: list[tuple], max_rules: int) -> DataFrame:
    """urls(row_id, row, host, path, tokens) with each candidate rule; a URL without one stays once with null rule columns."""
    spark = urls.sparkSession
    if len(index) <= max_rules:
        # each URL has the empty token too: it keeps URLs without candidates and fetches rules without tokens
        asked = urls.withColumn("token", F.explode(F.concat(F.array(F.lit("")), F.col("tokens")))).drop("tokens")
        return asked.join(F.broadcast(spark.createDataFrame(index, INDEX)), "token", "left")
    urls = common.written(urls, "urls")  # their row ids hold from here on
    none = [F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in INDEX.split(", "))]
    found = urls.drop("tokens").select("*", *none)
    free = [r for r in index if not r[0]]
    for i in range(0, len(free), max_rules or 1):
        asked = urls.drop("tokens").withColumn("token", F.lit(""))
        found = found.unionByName(asked.join(F.broadcast(spark.createDataFrame(free[i : i + (max_rules or 1)], INDEX)), "token"))
    stored = common.written(spark.createDataFrame([r for r in index if r[0]], INDEX), "rules")
    asked = urls.withColumn("token", F.explode("tokens")).drop("tokens")
    n = urls.count()
    often = asked.groupBy("token").count().where(F.col("count") * COMMON > n).join(stored.hint("merge"), "token", "left_anti")
    often = common.written(often.select("token"), "often")  # fewer than COMMON times the tokens of a mean URL
    return found.unionByName(asked.join(F.broadcast(often), "token", "left_anti").join(stored.hint("merge"), "token"))


def judge_urls(
    df: DataFrame,
    url: str = "url",
    list_rules: tuple[Rule, ...] = LIST_RULES,
    pattern_rules: tuple[Rule, ...] = PATTERN_RULES,
    keep: list[str] | None = None,
    max_rules: int = MAX_RULES,
) -> DataFrame:
    """df's columns `keep` (all by default) with host, path, rule (the list rule that decides,
    else null), pattern (the first blocking pattern, else null) and verdict."""
    outputs = ("host", "path", "rule", "pattern", "verdict")
    kept = [c for c in (keep if keep is not None else df.columns) if c not in outputs]
    urls = df.select(F.struct(*kept).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    urls = urls.withColumn("tokens", tokens_of(F.col("host"), F.col("path")))
    index = rule_index(urls, (*list_rules, *pattern_rules), max_rules)
    tried = candidates(common.with_row_id(urls), index, max_rules)
    fits = F.regexp(F.concat("host", "path"), F.col("regex"))
    best = F.max(F.when(fits & (F.col("rank") > 0), F.struct("rank", "rule", "verdict")))
    blocked = F.min(F.when(fits & (F.col("rank") == 0), F.col("rule")))
    judged = tried.groupBy("row_id").agg(
        F.first("row").alias("row"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"), blocked.alias("pattern")
    )
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("pattern").isNotNull(), "block").otherwise("allow"))
    return judged.select("row.*", "host", "path", F.col("best.rule").alias("rule"), "pattern", verdict.alias("verdict"))
