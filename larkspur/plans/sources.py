"""Queries of payload shapes and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.relational import merge_state, numbered, shared_folder, spread
from larkspur.plans.base import Tables, query
from larkspur.sources import files
from larkspur.sources import payloads as S
from larkspur.sources import sinks as K


def orders_payload(t: Tables, wrap: str | None = None) -> DataFrame:
    """Each customer's orders as the JSON body of a feed."""
    record = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.struct(F.col("o_orderstatus").alias("code")).alias("status"))
    item = record if wrap is None else F.struct(record.alias(wrap))
    lists = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(item)).alias("jobs"))
    return lists.select("o_custkey", F.to_json(F.struct("jobs")).alias("body"))


def feed() -> Column:
    """Feeds of twenty suppliers."""
    return F.floor(F.col("s_suppkey") / 20).alias("feed")


MAPPING = S.Mapping("$.jobs", {"title": ("$.title", "$.name"), "location": ("$.status.code",), "requisition_id": ("$.id",)})
ORDER_ITEMS = "SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS item_ord, o_orderpriority AS title, o_orderstatus AS location, o_orderkey::VARCHAR AS requisition_id FROM orders"
ITEM = ("o_custkey", "item_ord", "title", "location", "requisition_id")


@query("s1_flat_items", ORDER_ITEMS)
def s1(t: Tables) -> DataFrame:
    return S.flat_items(orders_payload(t), MAPPING).select(*ITEM)


@query("s2_wrapped_items", ORDER_ITEMS)
def s2(t: Tables) -> DataFrame:
    body = orders_payload(t, "data")
    quoted = F.regexp_extract(F.to_json(F.struct("body")), r'^\{"body":(.*)\}$', 1)
    body = body.select("o_custkey", F.when(F.col("o_custkey") % 2 == 0, quoted).otherwise(F.col("body")).alias("body"))
    return S.flat_items(body, S.Mapping(MAPPING.items, MAPPING.fields, "$.data")).select(*ITEM)


@query("s3_grouped_items", "SELECT o_custkey, o_orderkey::VARCHAR AS requisition_id, o_orderpriority AS department FROM orders")
def s3(t: Tables) -> DataFrame:
    record = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"))
    groups = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.sort_array(F.collect_list(record)).alias("l"))
    body = groups.groupBy("o_custkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "l")))).alias("body"))
    return S.grouped_items(body, S.Mapping("$.none", MAPPING.fields)).select("o_custkey", "requisition_id", "department")


@query("s4_graphql_items", "SELECT o_custkey, o_orderkey::VARCHAR AS requisition_id, false AS failed FROM orders WHERE o_custkey % 5 <> 0 UNION ALL SELECT DISTINCT o_custkey, NULL, true FROM orders WHERE o_custkey % 5 = 0")
def s4(t: Tables) -> DataFrame:
    errors = F.when(F.col("o_custkey") % 5 == 0, '[{"message": "denied"}]').otherwise("[]")
    body = orders_payload(t).select("o_custkey", F.concat(F.lit('{"data": {"search": '), "body", F.lit('}, "errors": '), errors, F.lit("}")).alias("body"))
    good, bad = S.graphql_items(body, S.Mapping("$.data.search.jobs", MAPPING.fields))
    return good.select("o_custkey", "requisition_id", F.lit(False).alias("failed")).union(bad.select("o_custkey", F.lit(None).cast("string"), F.lit(True)))


def posting_pages(t: Tables) -> DataFrame:
    """Pages with structured postings: nested ones in every third, broken ones in every fifth."""
    k = F.col("page_id")
    one = F.concat(F.lit('{"@type": "JobPosting", "title": "t'), k.cast("string"), F.lit('"}'))
    nested = F.concat(F.lit('{"@graph": [{"x": ['), one, F.lit(', {"@type": ["Thing", "jobposting"], "title": "second"}]}]}'))
    body = F.when(k % 5 == 0, '{"@type": "JobPosting", ').when(k % 3 == 0, nested).otherwise(one)
    return t.pages.select("page_id", "url", F.concat("html", F.lit('<script type="application/ld+json">'), body, F.lit("</script>")).alias("html"))


@query(
    "s5_json_ld",
    "SELECT page_id, 0 AS item_ord, 't' || page_id AS title FROM pages WHERE page_id % 5 <> 0 UNION ALL SELECT page_id, 1, 'second' FROM pages WHERE page_id % 5 <> 0 AND page_id % 3 = 0",
)
def s5(t: Tables) -> DataFrame:
    found = S.json_ld_postings(posting_pages(t).select("page_id", "html"))
    return found.select("page_id", "item_ord", F.get_json_object("record", "$.title").alias("title"))


@query("s5_json_ld_count", "SELECT page_id, len(regexp_extract_all(html, '(?i)\"@type\"\\s*:\\s*\"JobPosting\"'))::INT + 1 AS n FROM pages")
def s5_count(t: Tables) -> DataFrame:
    return posting_pages(t).select("page_id", S.json_ld_count(F.col("html")).alias("n"))


@query("s6_embedded_state", """SELECT page_id, page_id::VARCHAR AS id, 'a "] } ; b' AS note FROM pages""")
def s6(t: Tables) -> DataFrame:
    """Six ways in which pages hold their state, with brackets and quotes in its strings; chunks are pushed in two parts."""
    state = F.concat(F.lit('{"props": {"list": [1, [2]], "note": "a \\"] } ; b", "id": '), F.col("page_id").cast("string"), F.lit("}}"))
    marked = F.replace(F.replace(F.replace(state, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("]"), F.lit("&#93;"))
    quoted = lambda text: F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)
    pushed = F.concat(F.lit('0:["$","x"]\n1:{"other":0,"jobs": '), state, F.lit("}"))
    chunk = lambda text: F.concat(F.lit("<script>self.__next_f.push([1,"), quoted(text), F.lit("])</script>"))
    held = (
        ("element", "__NEXT_DATA__", F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), state, F.lit("</script>"))),
        ("element", "applyData", F.concat(F.lit('<code style="display:none" id="applyData">'), marked, F.lit("</code><code>{}</code>"))),
        ("pushed", "jobs", F.concat(F.lit("<script>self.__next_f.push([0])</script>"), chunk(F.substring(pushed, 1, 50)), F.lit("<i>"), chunk(F.substring(pushed, 51, 10_000)))),
        ("assignment", "window.jobsList", F.concat(F.lit("<script>if (window.jobsList == 1) {}; window.jobsList = "), state, F.lit("; window.more = {};</script>"))),
        ("attribute", "jobs", F.concat(F.lit('<input type="hidden" id="jobs" value="'), marked, F.lit('">'))),
        ("escaped", "jobs", F.concat(F.lit('<script>var a = {"x": '), quoted(F.concat(F.lit('{"jobs" : '), state, F.lit("}"))), F.lit("};</script>"))),
    )
    kind = F.col("page_id") % len(held)
    found = F.coalesce(*(S.embedded_state(F.when(kind == i, F.concat("html", page)), form, name) for i, (form, name, page) in enumerate(held)))
    return t.pages.select("page_id", F.get_json_object(found, "$.props.id").alias("id"), F.get_json_object(found, "$.props.note").alias("note"))


@query(
    "s7_anchors",
    """WITH a AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS l FROM pages),
    r AS (SELECT page_id, url, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS h, unnest(l) AS l FROM a)
    SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || h AS url, arg_min(l, pos) AS title, min(pos)::INT AS item_ord FROM r WHERE trim(l) <> '' AND regexp_matches(h, '^/[a-m]') GROUP BY page_id, 2""",
)
def s7(t: Tables) -> DataFrame:
    return S.cards(t.pages, r"^https?://[^/]+/[a-m]").select("page_id", "url", "title", "item_ord")


@query(
    "s7_cards",
    """SELECT s_suppkey // 20 AS feed, 'https://x.org/jobs/' || s_suppkey AS url, CASE WHEN s_suppkey % 3 = 2 THEN 'Role of ' || s_name ELSE s_name END AS title,
    CASE s_suppkey % 3 WHEN 0 THEN s_name || ' Pune ' || s_suppkey || ' Apply now' WHEN 1 THEN s_name ELSE 'Role of ' || s_name || ' Goa' END AS description FROM supplier""",
)
def s7_cards(t: Tables) -> DataFrame:
    """Cards with a heading and a stock link, links alone, and links that are the title within a card."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    link = F.concat(F.lit('<a href="/jobs/'), k.cast("string"), F.lit('">'))
    card = F.concat(F.lit("<li><h3>"), name, F.lit("</h3><span>Pune</span><p>"), k.cast("string"), F.lit("</p>"), link, F.lit("Apply now</a></li>"))
    alone = F.concat(F.lit("<p>"), link, F.lit("<b>"), name, F.lit("</b></a></p>"))
    named = F.concat(F.lit("<div><div>"), link, F.lit("Role of "), name, F.lit("</a></div><i>Goa</i></div>"))
    html = F.array_join(F.collect_list(F.when(k % 3 == 0, card).when(k % 3 == 1, alone).otherwise(named)), "\n")
    pages = t.supplier.groupBy(feed()).agg(F.concat(F.lit("<ul>"), html, F.lit("</ul>")).alias("html")).withColumn("url", F.lit("https://x.org/all"))
    return S.cards(pages, "/jobs/").select("feed", "url", "title", "description")


@query("s8_table_rows", "SELECT s_suppkey // 20 AS feed, (row_number() OVER (PARTITION BY s_suppkey // 20 ORDER BY s_suppkey) - 1)::INT AS item_ord, s_name || ' | ' || s_suppkey AS cells FROM supplier")
def s8(t: Tables) -> DataFrame:
    row = F.concat(F.lit('<tr class="data-row"><td>'), "s_name", F.lit("</td><td><b>"), F.col("s_suppkey").cast("string"), F.lit("</b></td></tr>"))
    rows = t.supplier.groupBy(feed()).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("row")))).alias("l"))
    html = F.concat(F.lit("<table><tr><th>Name</th></tr>"), F.array_join(F.transform("l", lambda x: x["row"]), "\n"), F.lit("</table>"))
    found = S.table_rows(rows.select("feed", html.alias("html")), row_attribute="data-row")
    return found.select("feed", "item_ord", F.array_join("cells", " | ").alias("cells"))


@query(
    "s8_nested_tables",
    """SELECT s_suppkey, 0 AS item_ord, s_name || ' | in ' || s_nationkey || ' | Z' AS cells FROM supplier UNION ALL SELECT s_suppkey, 1, 'in | ' || s_nationkey FROM supplier
    UNION ALL SELECT s_suppkey, 2, 'last' FROM supplier""",
)
def s8_nested(t: Tables) -> DataFrame:
    inner = F.concat(F.lit("<table><tr><td>in</td><td>"), F.col("s_nationkey").cast("string"), F.lit("</td></tr></table>"))
    html = F.concat(F.lit("<table><tr><td>"), "s_name", F.lit("</td><td>"), inner, F.lit("</td><td>Z<script>x</script></td></tr><tr><td>last</table>"))
    return S.table_rows(t.supplier.select("s_suppkey", html.alias("html"))).select("s_suppkey", "item_ord", F.array_join("cells", " | ").alias("cells"))


@query("s9_sitemap", "SELECT s_suppkey // 20 AS feed, 'https://x.org/jobs/' || s_suppkey AS url FROM supplier")
def s9(t: Tables) -> DataFrame:
    loc = F.concat(F.lit("<url><loc> https://x.org/jobs/"), F.col("s_suppkey").cast("string"), F.lit("</loc></url>"))
    body = t.supplier.groupBy(feed()).agg(F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list(loc), ""), F.lit("</urlset>")).alias("body"))
    return S.sitemap_urls(body).select("feed", "url")


@query("s9_feed_items", "SELECT s_suppkey // 20 AS feed, s_name AS title, 'https://x.org/' || s_suppkey AS link, '' AS location FROM supplier")
def s9_feed(t: Tables) -> DataFrame:
    item = F.concat(F.lit("<item><title><![CDATA["), "s_name", F.lit("]]></title><a:link>https://x.org/"), F.col("s_suppkey").cast("string"), F.lit("</a:link></item>"))
    body = t.supplier.groupBy(feed()).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("body"))
    return S.feed_items(body).select("feed", "title", "link", "location")


@query("s10_union_under", "SELECT key AS url, min(source_ord)::INT AS source_ord, 'both' AS source FROM (SELECT c_custkey AS key, 0 AS source_ord FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_suppkey, 1 FROM supplier) GROUP BY 1")
def s10(t: Tables) -> DataFrame:
    a = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("url"), F.col("c_custkey").alias("item_ord"))
    b = t.supplier.select(F.col("s_suppkey").alias("url"), F.col("s_suppkey").alias("item_ord"))
    return S.union_under("both", a, b).select("url", "source_ord", "source")


@query("s0_dispatch", "SELECT o_custkey, count(*) AS n, '' AS error FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1 UNION ALL SELECT DISTINCT o_custkey, 0, 'unsupported source: odd' FROM orders WHERE o_custkey % 4 = 0")
def s0(t: Tables) -> DataFrame:
    raw = orders_payload(t).withColumn("ats", F.when(F.col("o_custkey") % 4 == 0, "odd").when(F.col("o_custkey") % 4 == 1, "a").otherwise("b"))
    rows, unknown = S.dispatch(raw, {"a": MAPPING, "b": MAPPING})
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("error", F.lit("")).union(unknown.select("o_custkey", F.lit(0).cast("long"), "error"))


@query(
    "k3_summary",
    """WITH r AS (SELECT CASE WHEN o_orderstatus = 'O' THEN 'WORKING' ELSE o_orderstatus END AS status, 'c' || (o_custkey % 9) AS name FROM orders), c AS (SELECT status, count(*) AS n FROM r GROUP BY 1)
    SELECT c.status, n, name FROM c LEFT JOIN (SELECT DISTINCT status, name FROM r WHERE status <> 'WORKING') d ON d.status = c.status""",
)
def k3(t: Tables) -> DataFrame:
    rows = t.orders.select(F.when(F.col("o_orderstatus") == "O", "WORKING").otherwise(F.col("o_orderstatus")).alias("status"), F.concat(F.lit("c"), (F.col("o_custkey") % 9).cast("string")).alias("name"))
    return K.summary(rows, "status", "name")


@query(
    "k4_alert_records",
    """SELECT p_partkey AS key, substr(repeat(p_name || ' ', p_size), 1, 250) AS title, substr(repeat('é', p_size * 50), 1, 1000) AS location, p_size || '/100' AS score,
    array_to_string((range(0, p_size % 8)::VARCHAR[])[1:5], chr(10)) AS reasons, CASE WHEN p_size % 3 = 0 THEN 'Posted ₹' || p_size || '–' || (p_size + 2) || ' LPA' ELSE 'Est. ₹7–15 LPA' END AS pay,
    CASE WHEN p_size % 2 = 0 THEN 'r' || p_partkey END AS job_id FROM part""",
)
def k4(t: Tables) -> DataFrame:
    """Titles and places beyond the limits, none to seven reasons, posted and estimated pay."""
    n, key = F.col("p_size"), F.col("p_partkey").cast("string")
    rows = spread(t.part.select("p_partkey", "p_name", "p_brand", "p_size")).select(
        F.col("p_partkey").alias("key"), F.expr("repeat(p_name || ' ', p_size)").alias("title"), F.col("p_brand").alias("company"), F.expr("repeat('é', p_size * 50)").alias("location"), n.alias("score"),
        F.slice(F.array(*map(F.lit, "01234567")), F.lit(1), n % 8).alias("reasons"),
        F.when(n % 3 == 0, F.concat(F.lit("Pay ₹"), n.cast("string"), F.lit(" - "), (n + 2).cast("string"), F.lit(" LPA"))).otherwise("").alias("description"),
        F.when(n % 2 == 0, F.concat(F.lit("r"), key)).otherwise("").alias("requisition_id"),
    )
    fields = ("title", "location", "score", "reasons", "pay", "job_id")
    return K.alert_records(rows).select("key", F.json_tuple("payload", *fields).alias(*fields))  # a payload is read once


@query(
    "k5_run_line",
    "SELECT count(*) AS configured, count(DISTINCT e) AS labels, count(*) FILTER (f IS NULL) AS completed, count(*) FILTER (f IS NULL AND n = 0) AS zero, count(*) FILTER (f IS NOT NULL) AS failed FROM (SELECT user_id, min(event_type) AS e, count(*) FILTER (event_type = 'purchase') AS n, max(CASE WHEN event_type = 'error' AND value > 200 THEN 'x' END) AS f FROM events GROUP BY 1)",
)
def k5(t: Tables) -> DataFrame:
    error = F.max(F.when((F.col("event_type") == "error") & (F.col("value") > 200), "x"))
    each = t.events.groupBy("user_id").agg(F.min("event_type").alias("label"), F.count_if(F.col("event_type") == "purchase").alias("n"), error.alias("error"))
    return K.run_line(each, "label", "n", "error")


@query(
    "k5_run_table",
    """WITH e AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'first' ELSE 'second' END AS run, user_id, count(*) FILTER (event_type = 'purchase') AS n, max(CASE WHEN event_type = 'error' AND value > 100 THEN 'x' END) AS f FROM events GROUP BY ALL)
    SELECT run, count(*) AS configured, count(*) FILTER (f IS NULL) AS completed, count(*) FILTER (f IS NULL AND n = 0) AS zero, count(*) FILTER (f IS NOT NULL) AS failed FROM e GROUP BY 1""",
)
def k5_table(t: Tables) -> DataFrame:
    """Two runs' results are written; their lines are counted on the way and read back from the table of runs."""
    where = folder(t, "k5")
    error = F.max(F.when((F.col("event_type") == "error") & (F.col("value") > 100), "x"))
    cut = F.lit("2024-01-16").cast("timestamp")
    for run, part in (("first", t.events.where(F.col("ts") < cut)), ("second", t.events.where(F.col("ts") >= cut))):
        results = part.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("n"), error.alias("error"))
        K.record_run(results, f"{where}/{run}", f"{where}/runs", run, "n", "error")
    return K.run_table(t.spark, f"{where}/runs")


@query("s9_meta_cards", "SELECT s_suppkey // 20 AS feed, s_suppkey::VARCHAR AS card_id, s_name || ' & more' AS content_title, 'https://x.org/' || s_suppkey AS content_url, '' AS content_note FROM supplier")
def s9_meta(t: Tables) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    meta = lambda name, *strings: F.concat(F.lit(f'<a:Meta name="{name}">'), *strings, F.lit("</a:Meta>"))
    title = (F.lit("<a:MetaString>"), F.col("s_name"), F.lit("</a:MetaString><a:MetaString>&amp; more</a:MetaString>"))
    hit = F.concat(F.lit("<a:Hit>"), meta("card_id", F.lit('<a:MetaString value="'), key, F.lit('"/>')), meta("content_title", *title), meta("content_url", F.lit("<a:MetaString>https://x.org/"), key, F.lit("</a:MetaString>")), F.lit("</a:Hit>"))
    body = t.supplier.groupBy(feed()).agg(F.concat(F.lit('<a:Answer xmlns:a="urn:x">'), F.array_join(F.collect_list(hit), ""), F.lit("</a:Answer>")).alias("body"))
    return S.meta_cards(body, ("card_id", "content_title", "content_url", "content_note")).drop("item_ord")


def folder(t: Tables, name: str) -> str:
    """A new folder in the shared one, for files that a query writes and reads."""
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("s11_line_files", "SELECT s_name AS name, 'https://x.org/' || s_suppkey AS url FROM supplier UNION ALL SELECT n_name, NULL FROM nation")
def s11(t: Tables) -> DataFrame:
    """Lines in both forms with comments and blank lines, and a file of names alone."""
    path, k = folder(t, "lines"), F.col("s_suppkey")
    url = F.concat(F.lit("https://x.org/"), k.cast("string"))
    line = F.when(k % 2 == 0, F.concat(F.col("s_name"), F.lit(" | "), url)).otherwise(F.concat(F.col("s_name"), F.lit(": "), url))
    t.supplier.select(F.concat(F.lit("# comment\n\n  "), line).alias("value")).write.text(f"{path}/pairs")
    t.nation.select(F.concat("n_name", F.lit("\n#x")).alias("value")).write.text(f"{path}/names")
    return files.lines(t.spark, f"{path}/pairs").unionByName(files.lines(t.spark, f"{path}/names", named=False), allowMissingColumns=True)


def part() -> Column:
    """Files of fifty suppliers."""
    return F.floor(F.col("s_suppkey") / 50).cast("int").alias("batch_index")


def documents_of(df: DataFrame, by: str, path: str) -> None:
    """One file with one JSON document for each value of `by`, which stays in the document."""
    df.withColumn("__dir", F.col(by)).repartition("__dir").write.partitionBy("__dir").json(path)


@query("s12_registry", "SELECT s_name AS name, 'https://x.org/' || s_suppkey AS url, s_suppkey % 2 = 0 AS enabled FROM supplier")
def s12(t: Tables) -> DataFrame:
    path = folder(t, "registry")
    row = F.struct(F.col("s_name").alias("name"), F.concat(F.lit("https://x.org/"), F.col("s_suppkey").cast("string")).alias("url"), (F.col("s_suppkey") % 2 == 0).alias("enabled"))
    documents_of(t.supplier.groupBy(part()).agg(F.collect_list(row).alias("companies")), "batch_index", path)
    return files.registry(t.spark, path, "name string, url string, enabled boolean").select("name", "url", "enabled")


@query("s14_part_files", "SELECT (s_suppkey // 50)::INTEGER AS batch_index, s_name AS name FROM supplier")
def s14(t: Tables) -> DataFrame:
    path = folder(t, "parts")
    results = t.supplier.groupBy(part()).agg(F.collect_list(F.struct(F.col("s_name").alias("name"))).alias("results"))
    documents_of(results, "batch_index", path)
    return files.parts(t.spark, path, "name string").select("batch_index", "name")


STATE = "state_key string, event_type string, first_seen timestamp"


@query(
    "s13_state",
    """SELECT 'u' || user_id AS state_key, arg_min(event_type, event_id) AS event_type, min(ts) AS first_seen, 'kept' AS of FROM events GROUP BY ALL
    UNION ALL SELECT 'bad', NULL, NULL, 'records' UNION ALL SELECT 'none', NULL, NULL, 'missing ' || 0""",
)
def s13(t: Tables) -> DataFrame:
    """The newest of two versions of a state that K1 wrote; a file with an unreadable record; a path that isn't there."""
    path = folder(t, "state")
    write_versions(t, path)
    t.region.limit(1).select(F.lit('{"state_key": "bad"}\n[broken').alias("value")).write.text(f"{path}/records")
    kept = files.state(t.spark, f"{path}/states", STATE).withColumn("of", F.lit("kept"))
    records = files.state(t.spark, f"{path}/records", STATE).withColumn("of", F.lit("records"))
    none = files.state(t.spark, f"{path}/none", STATE).agg(F.lit("none").alias("state_key"), F.concat(F.lit("missing "), F.count("*").cast("string")).alias("of"))
    return kept.unionByName(records).unionByName(none, allowMissingColumns=True)


def write_versions(t: Tables, path: str) -> list[str]:
    """Two versions of a state: the first keys, then all of them, with the older side's records."""
    rows = t.events.withColumn("state_key", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    first = lambda d: d.groupBy("state_key").agg(F.min_by("event_type", "event_id").alias("event_type"), F.min("ts").alias("first_seen"))
    early = K.write_state(first(rows.where(F.col("ts") < F.lit("2024-01-05").cast("timestamp"))), f"{path}/states", 1)
    old = t.spark.read.schema(STATE).parquet(early)
    return [early, K.write_state(merge_state(old, first(rows), "state_key"), f"{path}/states", 2)]


@query(
    "k1_write_state",
    "WITH s AS (SELECT 1 AS version, user_id FROM events WHERE ts < TIMESTAMP '2024-01-05' UNION SELECT 2, user_id FROM events) SELECT version, 'u' || user_id AS state_key, row_number() OVER (PARTITION BY version ORDER BY 'u' || user_id) AS place FROM s",
)
def k1(t: Tables) -> DataFrame:
    """Both versions stay; each is the whole state in order of its keys."""
    out = None
    for i, path in enumerate(write_versions(t, folder(t, "state"))):
        rows = numbered(t.spark.read.schema(STATE).parquet(path), ["state_key"], "place").select(F.lit(i + 1).alias("version"), "state_key", "place")
        out = rows if out is None else out.union(rows)
    return out


@query("k2_write_registry", "SELECT s_name AS name, row_number() OVER (ORDER BY lower(s_name)) AS place, count(*) OVER () AS total, 'from suppliers' AS note, '2026-01-01' AS generated_at FROM supplier")
def k2(t: Tables) -> DataFrame:
    path = folder(t, "registry")
    K.write_registry(t.supplier.select(F.col("s_name").alias("name")), path, "from suppliers", F.lit("2026-01-01"))
    rows = numbered(t.spark.read.schema("name string").json(f"{path}/rows"), [F.lower("name")], "place")
    meta = t.spark.read.schema("generated_at string, total long, note string").json(f"{path}/metadata")  # one row
    return rows.join(F.broadcast(meta), F.lit(True))
