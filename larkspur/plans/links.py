"""Queries of the URL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import urls as U
from larkspur.plans.base import Tables, query
from larkspur.plans.text import MATCH

PART = r"regexp_extract(trim(coalesce(url, '')), '(?i)^(https?)://([^/?#\s]+)([^?#]*)\??([^#]*)', {0})"
DECODE = r"url_decode(replace(regexp_replace(regexp_replace({0}, '%([0-9A-Fa-f]{{2}})', chr(1) || '\1', 'g'), '%', '%25', 'g'), chr(1), '%').replace('+', ' '))"
DROPPED = ", ".join(f"'{p}'" for p in U.DROPPED_PARAMETERS)
CANONICAL = rf"""
u AS (SELECT *, lower(regexp_replace({PART.format(2)}, ':[0-9]*$', '')) AS host, {PART.format(3)} AS path FROM pages),
c0 AS (SELECT *,
    coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '/{{2,}}', '/', 'g'), '(?i)/en[-_][a-z]{{2}}/', '/', 'g'), '(?i)/apply(/|$)', '/', 'g'), '/+$', ''), ''), '/') AS p,
    list_sort(list_filter(list_transform(list_filter(string_split({PART.format(4)}, '&'), lambda x: x <> ''),
      lambda x: {{'name': {DECODE.format("split_part(x, '=', 1)")}, 'value': {DECODE.format("x[length(split_part(x, '=', 1)) + 2:]")}}}),
      lambda x: NOT starts_with(lower(x.name), 'utm_') AND lower(x.name) NOT IN ({DROPPED}))) AS items FROM u),
c1 AS (SELECT *, array_to_string(list_transform(items, lambda x: replace(url_encode(x.name), '%20', '+') || '=' || replace(url_encode(x.value), '%20', '+')), '&') AS q FROM c0),
c AS (SELECT *, CASE WHEN {PART.format(2)} = '' THEN '' ELSE lower({PART.format(1)} || '://' || {PART.format(2)} || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END) END AS loose,
    regexp_matches(p, '(?i)/(jobs?|positions?|postings?|requisitions?|openings?)/[^/]+') OR regexp_matches(p, '(?i)[0-9a-f]{{8}}-[0-9a-f-]{{20,}}|[0-9]{{4,}}')
    OR len(list_filter(items, lambda x: lower(x.name) IN ('id', 'jobid', 'job_id', 'position_id', 'opportunityid', 'gh_jid'))) > 0 AS named FROM c1)
"""
#: Queries as they are met: encoded, doubly given, without a value, with stray percent signs.
QUERIES = ("", "?id", "?b=%C3%A9+x~*&a=1&a=0", "?ID=7%&utm_x=1&page=2", "?a=b=c&&q=1&x=%7e%2f")


@query(
    "u1_canonical_url",
    "WITH odd AS (SELECT page_id, regexp_extract(url, '^[^?#]*') || " + str(list(QUERIES)) + f"[page_id % {len(QUERIES)} + 1] AS url, url AS own FROM pages),"
    f" {CANONICAL.replace('FROM pages)', 'FROM (SELECT page_id, url, 1 AS kind FROM pages UNION ALL SELECT page_id, url, 2 FROM odd) AS both_kinds)')}"
    " SELECT page_id, kind, loose AS url, CASE WHEN named THEN loose ELSE '' END AS posting_url FROM c",
)
def u1(t: Tables) -> DataFrame:
    ending = F.get(F.array(*map(F.lit, QUERIES)), (F.col("page_id") % len(QUERIES)).cast("int"))
    odd = t.pages.select("page_id", F.concat(F.regexp_extract("url", "^[^?#]*", 0), ending).alias("url"), F.lit(2).alias("kind"))
    both = t.pages.select("page_id", "url", F.lit(1).alias("kind")).union(odd)
    return both.select("page_id", "kind", U.canonical_url(F.col("url"), False).alias("url"), U.canonical_url(F.col("url")).alias("posting_url"))


@query(
    "u2_is_public",
    f"WITH {CANONICAL} SELECT page_id, {PART.format(2)} <> '' AND host NOT IN ('api.smartrecruiters.com', 'api.lever.co', 'boards-api.greenhouse.io')"
    " AND NOT (contains(lower(path), '/wday/cxs/') OR contains(lower(path), '/hcmrestapi/') OR contains(lower(path), '/posting-api/job-board/') OR contains(lower(path), '/recruiting/v2/api/feed/')) AS public FROM c",
)
def u2(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.is_public(F.col("url")).alias("public"))


@query(
    "u3_requisition_id",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'jr' || (1000 + o_orderkey) WHEN o_orderkey % 3 = 1 THEN 'r' || (100000 + o_orderkey)
    ELSE CASE WHEN length(o_orderkey::VARCHAR) >= 4 THEN o_orderkey::VARCHAR ELSE '' END END AS requisition FROM orders""",
)
def u3(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("/x/JR-"), (k + 1000).cast("string"), F.lit("/en"))).when(k % 3 == 1, F.concat(F.lit("x%20R"), (k + 100000).cast("string"))).otherwise(k.cast("string"))
    return t.orders.select("o_orderkey", U.requisition_id(raw, True).alias("requisition"))


@query("u4_url_fingerprint", f"WITH {CANONICAL} SELECT page_id, CASE WHEN loose <> '' THEN substr(sha256('url|' || loose), 1, 24) ELSE '' END AS fingerprint FROM c")
def u4(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.url_fingerprint(F.col("url"), False).alias("fingerprint"))


@query("u5_requisition_fingerprint", f"SELECT o_orderkey, substr(sha256('req|' || {MATCH.format('o_orderpriority')} || '|req' || (10000 + o_orderkey)), 1, 24) AS fingerprint FROM orders")
def u5(t: Tables) -> DataFrame:
    number = F.concat(F.lit("REQ_"), (F.col("o_orderkey") + 10000).cast("string"))
    return t.orders.select("o_orderkey", U.requisition_fingerprint(F.col("o_orderpriority"), number, F.lit("")).alias("fingerprint"))


SEMANTIC = f"substr(sha256({MATCH.format('c_mktsegment')} || '|' || {MATCH.format('c_name')} || '|' || c_nationkey), 1, 24)"


@query("u6_semantic_fingerprint", f"SELECT c_custkey, {SEMANTIC} AS fingerprint FROM customer")
def u6(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", U.semantic_fingerprint(F.col("c_mktsegment"), F.col("c_name"), F.col("c_nationkey").cast("string")).alias("fingerprint"))


KEYS = f"""CASE WHEN c_custkey % 3 = 0 THEN [substr(sha256('req|' || {MATCH.format('c_mktsegment')} || '|req' || (10000 + c_custkey)), 1, 24), substr(sha256('url|https://x.org/jobs/' || c_custkey), 1, 24)]
  WHEN c_custkey % 3 = 1 THEN [substr(sha256('url|https://x.org/jobs/' || c_custkey), 1, 24)] ELSE [{SEMANTIC}] END"""


def keys(t: Tables, f) -> DataFrame:
    k = F.col("c_custkey")
    url = F.when(k % 3 < 2, F.concat(F.lit("https://X.org/apply/jobs/"), k.cast("string"), F.lit("/?utm_a=b"))).otherwise("https://x.org/about")
    number = F.when(k % 3 == 0, F.concat(F.lit("REQ "), (k + 10000).cast("string"))).otherwise("")
    return t.customer.select("c_custkey", f(F.col("c_mktsegment"), F.col("c_name"), F.col("c_nationkey").cast("string"), url, number).alias("keys"))


@query("u7_dedupe_keys", f"SELECT c_custkey, array_to_string({KEYS}, ',') AS keys FROM customer")
def u7(t: Tables) -> DataFrame:
    return keys(t, U.dedupe_keys).withColumn("keys", F.array_join("keys", ","))


@query("u8_state_key", f"SELECT c_custkey, ({KEYS})[1] AS keys FROM customer")
def u8(t: Tables) -> DataFrame:
    return keys(t, U.state_key)


@query(
    "u9_provider",
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'lever' WHEN page_id % 5 = 1 THEN 'greenhouse' WHEN page_id % 5 = 2 THEN 'workday' WHEN page_id % 5 = 3 THEN 'oracle' ELSE '' END AS provider,
    CASE WHEN page_id % 5 = 4 THEN regexp_extract(url, '(?i)^https?://[^/?#]+/+([^/?#]+)', 1) WHEN page_id % 5 = 3 THEN 'sites' ELSE 'board' || page_id END AS slug FROM pages""",
)
def u9(t: Tables) -> DataFrame:
    hosts = F.array(*map(F.lit, ("https://jobs.lever.co/board", "https://boards.greenhouse.io/board", "https://x.wd5.myworkdayjobs.com/board")))
    k = (F.col("page_id") % 5).cast("int")
    made = F.concat(F.get(hosts, k), F.col("page_id").cast("string"), F.lit("/jobs"))
    url = F.when(k < 3, made).when(k == 3, "https://e.oraclecloud.com/sites/CX").otherwise(F.col("url"))
    return t.pages.select("page_id", U.provider(url).alias("provider"), U.segment(url, 1).alias("slug"))


@query(
    "u10_path_parts",
    f"""WITH {CANONICAL}, s AS (SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM c)
    SELECT page_id, coalesce(s[-1], '') AS last, coalesce(s[-2], '') AS before, coalesce(list_filter(s, lambda x: regexp_matches(x, '^[0-9]+'))[1], '') AS number FROM s""",
)
def u10(t: Tables) -> DataFrame:
    number = F.coalesce(F.get(F.filter(U.segments(F.col("url")), lambda s: s.rlike("^[0-9]+")), F.lit(0)), F.lit(""))
    return t.pages.select("page_id", U.segment(F.col("url"), -1).alias("last"), U.segment(F.col("url"), -2).alias("before"), number.alias("number"))


@query("u11_source_identity", "SELECT page_id, 'html|' || lower(regexp_replace(url, '/+$', '')) AS identity FROM pages")
def u11(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.source_identity(F.lit("html"), F.col("url"), F.lit("")).alias("identity"))


@query(
    "u12_slug_candidates",
    """WITH n AS (SELECT s_suppkey, 'Supplier ' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ' Group Ltd' ELSE ' & Sons (North)' END AS name FROM supplier)
    SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'supplier' || s_suppkey || 'groupltd,supplier-' || s_suppkey || '-group-ltd,supplier' || s_suppkey || ',supplier-' || s_suppkey || ',Supplier' || s_suppkey || 'GroupLtd'
    ELSE 'supplier' || s_suppkey || 'andsons,supplier-' || s_suppkey || '-and-sons,Supplier' || s_suppkey || 'andSons' END AS slugs FROM n""",
)
def u12(t: Tables) -> DataFrame:
    tail = F.when(F.col("s_suppkey") % 2 == 0, " Group Ltd").otherwise(" & Sons (North)")
    name = F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string"), tail)
    return t.supplier.select("s_suppkey", F.array_join(U.slug_candidates(name), ",").alias("slugs"))


@query(
    "u13_urls_in_page",
    """WITH a AS (SELECT page_id, regexp_extract_all(html, '(/[A-Za-z]+")') AS l FROM pages),
    p AS (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM a), f AS (SELECT page_id, x, min(i) AS i FROM p GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n FROM f)
    SELECT a.page_id, coalesce(string_agg(x, ',' ORDER BY i) FILTER (n <= 12), '') AS urls FROM a LEFT JOIN r USING (page_id) GROUP BY 1""",
)
def u13(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(U.urls_in(F.col("html"), '/[A-Za-z]+"'), ",").alias("urls"))
