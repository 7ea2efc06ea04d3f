"""Queries of classification and registry operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import classify as C
from larkspur.operators import relational as R
from larkspur.plans.base import Tables, query
from larkspur.plans.predicates import PROMOTED, REASON, promoted
from larkspur.sources.payloads import anchors

RULES = (
    (1, "host", "example.net", "net_board", {"slug": "{first}", "site": "{origin}/{last}"}),
    (2, "path", "/de/", "german", {"tenant": "{label}"}),
    (3, "host", "example.org", "org_board", None),
    (4, "path", "/fr/", "french", None),
)


@query(
    "l1_classify_sources",
    r"""SELECT page_id, CASE WHEN regexp_matches(h, '(^|\.)example\.net$') THEN 'net_board' WHEN contains(p, '/de/') THEN 'german'
    WHEN regexp_matches(h, '(^|\.)example\.org$') THEN 'org_board' WHEN contains(p, '/fr/') THEN 'french' ELSE 'direct_job_html' END AS ats,
    CASE WHEN ats = 'net_board' THEN coalesce(s[1], '') END AS slug, CASE WHEN ats = 'net_board' THEN regexp_extract(url, '^([a-z]+://[^/?#]+)') || '/' || coalesce(s[-1], '') END AS site,
    CASE WHEN ats = 'german' THEN split_part(h, '.', 1) END AS tenant
    FROM (SELECT page_id, url, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS h, lower(regexp_extract(url, '://[^/?#]+([^?#]*)', 1)) AS p, list_filter(string_split(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages)""",
)
def l1(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame(RULES, C.RULE_SCHEMA)
    found = C.classify_sources(t.pages.select("page_id", "url", F.lit("x").alias("name")), rules, "name", "url")
    return found.select("page_id", "ats", *(F.col("attrs")[a].alias(a) for a in ("slug", "site", "tenant")))


@query(
    "l1_path_rules",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders) THEN l_orderkey END AS a, (SELECT o_orderkey FROM orders WHERE o_orderkey = l_partkey) AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, coalesce((SELECT o_orderpriority FROM orders WHERE o_orderkey = least(a, b)), 'direct_job_html') AS ats, coalesce(least(a, b)::VARCHAR, '') AS slug FROM l""",
)
def l1_paths(t: Tables) -> DataFrame:
    """A path rule for every order; addresses hold the numbers of an order and of a part, which may be another order's."""
    number = F.col("o_orderkey").cast("string")
    rules = t.orders.select(F.col("o_orderkey").cast("int").alias("priority"), F.lit("path").alias("kind"), F.concat(F.lit("/"), number, F.lit("-")).alias("pattern"), F.col("o_orderpriority").alias("ats"), F.create_map(F.lit("slug"), number).alias("attrs"))
    url = F.format_string("https://x.org/en/%d-%d/%d-x/apply", "l_orderkey", "l_linenumber", "l_partkey")
    found = C.classify_sources(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", url.alias("url"), F.lit("x").alias("name")), rules, "name", "url")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "ats", F.coalesce(F.col("attrs")["slug"], F.lit("")).alias("slug"))


@query(
    "l2_page_status",
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 403 WHEN event_id % 7 = 1 THEN 404 WHEN event_id % 7 = 2 THEN NULL ELSE 200 END AS http, user_id % 4 = 0 AS moved, (value::INT % 3) AS jobs, event_type FROM events),
    s AS (SELECT *, CASE WHEN http = 403 THEN 'BLOCKED' WHEN http IS NULL OR http >= 400 THEN 'BROKEN' WHEN jobs > 0 THEN 'WORKING' WHEN event_type = 'signup' OR event_type = 'view' THEN 'NO_JOBS' WHEN event_type = 'error' THEN 'DYNAMIC' ELSE 'NO_PUBLIC_BOARD' END AS d FROM e)
    SELECT event_id, CASE WHEN moved AND d NOT IN ('BLOCKED', 'BROKEN') THEN 'REDIRECT' ELSE d END AS status, CASE WHEN moved AND d NOT IN ('BLOCKED', 'BROKEN') THEN d END AS resolved_status FROM s""",
)
def l2(t: Tables) -> DataFrame:
    k, kind = F.col("event_id") % 7, F.col("event_type")
    http = F.when(k == 0, 403).when(k == 1, 404).when(k > 2, 200)
    status = C.page_status(
        http, F.col("user_id") % 4 == 0, F.when(kind == "signup", "lever").otherwise(""), F.rint("value").cast("int") % 3, kind == "view", kind == "error", F.lit(None).cast("string")
    )
    return t.events.select("event_id", status.alias("s")).select("event_id", "s.*")


@query(
    "l3_first_supported_link",
    """WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS l FROM pages), r AS (SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS h FROM a)
    SELECT page_id, 'https://jobs.lever.co' || arg_min(h, pos) AS href, 'lever' AS provider FROM r WHERE regexp_matches(h, '^/[n-z]') GROUP BY 1""",
)
def l3(t: Tables) -> DataFrame:
    found = anchors(t.pages.select("page_id", "html", F.lit("https://x.org/").alias("url"))).withColumn("kind", F.lit("a"))
    path = F.regexp_replace("href", "^https://x.org", "")
    found = found.withColumn("href", F.when(path.rlike("^/[n-z]"), F.concat(F.lit("https://jobs.lever.co"), path)).otherwise(F.col("href")))
    return C.first_supported_link(found, "page_id")


@query(
    "l4_source_verdict",
    """SELECT user_id, CASE WHEN e > 20 THEN 'FAILED' WHEN p > 0 THEN 'WORKING' WHEN n > 30 THEN 'NO_CURRENT_MATCHING_JOBS' ELSE 'UNRESOLVED_DYNAMIC_SOURCE' END AS verdict, samples FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'purchase' AND value > 150) AS p, count(*) AS n,
    array_to_string(list(event_id ORDER BY event_id)[1:3], ',') AS samples FROM events GROUP BY 1)""",
)
def l4(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    each = t.events.groupBy("user_id").agg(
        F.count_if(kind == "error").alias("e"), F.count_if((kind == "purchase") & (F.col("value") > 150)).alias("p"), F.count("*").alias("n")
    )
    each = each.join(R.first_values(t.events, "user_id", "event_id", 3, "samples").hint("merge"), "user_id")
    verdict = C.source_verdict(F.when(F.col("e") > 20, "x"), F.lit(0), F.col("p"), F.col("n") > 30)
    return each.select("user_id", verdict.alias("verdict"), F.array_join("samples", ",").alias("samples"))


@query(
    "l5_merge_probes",
    """WITH v AS (SELECT user_id, arg_max(event_type, event_id) AS state, true AS verified FROM events WHERE value > 100 GROUP BY 1),
    u AS (SELECT user_id, arg_max(event_type, event_id) AS state, false AS verified FROM events WHERE value <= 100 GROUP BY 1)
    SELECT * FROM v UNION ALL SELECT * FROM u WHERE user_id NOT IN (SELECT user_id FROM v)""",
)
def l5(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.col("event_type").alias("state"), (F.col("value") > 100).alias("verified"), "event_id")
    return C.merge_probes(rows, "user_id", "verified", "event_id").drop("event_id")


@query("l6_promotion_split", f"WITH {PROMOTED}, r AS (SELECT {REASON} AS reason FROM p) SELECT coalesce(reason, 'promoted') AS outcome, count(*) AS n FROM r GROUP BY 1")
def l6(t: Tables) -> DataFrame:
    return promoted(t).groupBy(F.coalesce("reason", F.lit("promoted")).alias("outcome")).agg(F.count("*").alias("n"))


@query(
    "l7_consolidation",
    """SELECT n_name AS canonical, min(s_suppkey) AS s_suppkey, string_agg(s_name, ',' ORDER BY s_suppkey) AS aliases FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""",
)
def l7(t: Tables) -> DataFrame:
    """Suppliers under their nation as canonical name, each with the nation's board as its source; a conflict would fail."""
    names = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("alias"), F.col("n_name").alias("canonical"))
    board = F.concat(F.lit("html|board"), F.col("s_nationkey").cast("string"))
    merged = R.consolidated(t.supplier.select("s_suppkey", "s_name", board.alias("identity"), F.array("s_name").alias("aliases")), names, "s_name", "s_suppkey", "identity", ["aliases"])
    return merged.select("canonical", "s_suppkey", F.array_join("aliases", ",").alias("aliases"))


@query(
    "l7_conflicts",
    """WITH s AS (SELECT n_name AS name, 'b' || (s_suppkey % 3 + s_nationkey) AS identity FROM supplier JOIN nation ON n_nationkey = s_nationkey)
    SELECT identity AS key, count(DISTINCT name) AS n, 'identity' AS kind FROM s GROUP BY 1 HAVING count(DISTINCT name) > 1 UNION ALL SELECT name, count(DISTINCT identity), 'name' FROM s GROUP BY 1 HAVING count(DISTINCT identity) > 1""",
)
def l7_conflicts(t: Tables) -> DataFrame:
    """What makes a consolidation fail: names with several identities and identities with several names."""
    names = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    identity = F.concat(F.lit("b"), (F.col("s_suppkey") % 3 + F.col("s_nationkey")).cast("string"))
    return R.identity_conflicts(names.select(F.col("n_name").alias("name"), identity.alias("identity")), "identity", "name")


@query("l8_retired", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def l8(t: Tables) -> DataFrame:
    retired = t.supplier.select(F.format_string("customer#%09d", "s_suppkey"))
    return R.without_names(t.customer, "c_name", retired).select("c_custkey")
