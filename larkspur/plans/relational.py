"""Queries of dedupe, joins, set operations, aggregates and order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.text import match_text
from larkspur.functions.urls import dedupe_keys
from larkspur.operators import relational as R
from larkspur.operators import reports as P
from larkspur.operators import state as S
from larkspur.plans.base import Tables, query
from larkspur.plans.links import KEYS


@query(
    "d1_greedy_dedupe",
    """WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount) AS n FROM lineitem),
    r AS (SELECT l_orderkey * 10000 + l_linenumber * 1000 + n AS ord, 'p' || l_partkey AS p, 's' || l_suppkey || '-' || month(l_shipdate) || '-' || l_linenumber AS s FROM l),
    rounds AS (
      SELECT ord, unnest([p, s]) AS k, false AS won FROM r
      UNION ALL
      SELECT ord, k, won FROM (
        SELECT *, max(taken) OVER (PARTITION BY ord) AS gone FROM (
          SELECT *, bool_or(won) OVER (PARTITION BY k) AS taken FROM (
            SELECT ord, k, min(leads) OVER (PARTITION BY ord) AS won FROM (SELECT ord, k, ord = min(ord) OVER (PARTITION BY k) AS leads FROM rounds WHERE NOT won))))
      WHERE won OR NOT gone)
    SELECT ord, p || ',' || s AS keys FROM r WHERE ord IN (SELECT ord FROM rounds WHERE won)""",
)
def d1(t: Tables) -> DataFrame:
    order = F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount"))
    rows = t.lineitem.withColumn("n", order)
    rows = rows.select(
        (F.col("l_orderkey") * 10000 + F.col("l_linenumber") * 1000 + F.col("n")).alias("ord"),
        F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("-"), F.month("l_shipdate").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))).alias("keys"),
    )
    rows = R.stored(rows)  # read twice: by the rounds and for the accepted rows
    return R.greedy_dedupe(rows, "keys", "ord").select("ord", F.array_join("keys", ",").alias("keys"))


@query("d2_first_per_key", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def d2(t: Tables) -> DataFrame:
    return R.first_per_key(t.documents, ["text"], ["doc_id"]).select("doc_id", "source")


@query("d3_last_per_key", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def d3(t: Tables) -> DataFrame:
    return R.last_per_key(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query(
    "d4_merge_duplicates",
    """WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS i FROM orders GROUP BY ALL)
    SELECT o_custkey, (SELECT arg_min(o_orderstatus, o_orderkey) FROM orders o WHERE o.o_custkey = f.o_custkey) AS o_orderstatus, string_agg(o_orderpriority, ',' ORDER BY i) AS places FROM f GROUP BY 1""",
)
def d4(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", F.array("o_orderpriority").alias("places"))
    return R.merge_duplicates(rows, "o_custkey", "o_orderkey", ["places"]).select("o_custkey", "o_orderstatus", F.array_join("places", ",").alias("places"))


@query(
    "d5_merge_aliases",
    """SELECT n_name, array_to_string(list_concat(['nation ' || n_nationkey], coalesce((SELECT list(DISTINCT s_name ORDER BY s_name) FROM supplier WHERE s_nationkey = n_nationkey), [])), ',') AS aliases FROM nation""",
)
def d5(t: Tables) -> DataFrame:
    base = t.nation.select("n_nationkey", "n_name", F.array(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string"))).alias("aliases"))
    extra = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("aliases"))
    return R.merge_aliases(base, extra, "n_nationkey", "aliases").select("n_name", F.array_join("aliases", ",").alias("aliases"))


@query(
    "j1_anti_join_seen",
    """WITH s AS (SELECT DISTINCT 'u' || user_id || props AS k FROM events WHERE ts < TIMESTAMP '2024-01-16' UNION SELECT DISTINCT 'e' || event_type || value FROM events WHERE ts < TIMESTAMP '2024-01-16')
    SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND ('u' || user_id || props) NOT IN (SELECT k FROM s) AND ('e' || event_type || value) NOT IN (SELECT k FROM s)""",
)
def j1(t: Tables) -> DataFrame:
    value = F.col("value").cast("string")
    rows = t.events.select("event_id", "ts", F.array(F.concat(F.lit("u"), F.col("user_id").cast("string"), "props"), F.concat(F.lit("e"), "event_type", value)).alias("keys"))
    cut = F.lit("2024-01-16").cast("timestamp")
    seen = rows.where(F.col("ts") < cut).select(F.explode("keys").alias("key"))
    return S.anti_join_seen(rows.where(F.col("ts") >= cut), seen, "keys", "event_id").select("event_id")


@query(
    "j1_legacy_state",
    f"""WITH k AS (SELECT c_custkey, {KEYS} AS keys FROM customer),
    s AS (SELECT unnest(keys) AS key FROM k WHERE c_custkey % 4 = 0 AND c_custkey % 5 <> 0 UNION SELECT keys[1] FROM k WHERE c_custkey % 20 = 0 AND c_custkey % 3 <> 1)
    SELECT c_custkey FROM k WHERE NOT list_has_any(keys, (SELECT list(key) FROM s))""",
)
def j1_legacy(t: Tables) -> DataFrame:
    """A state of every fourth posting, met with other forms of their URLs: most under keys of an older form, a fifth without
    the location that keys are made anew from, of these some under their present key."""
    k = F.col("c_custkey")
    company, title, location = F.col("c_mktsegment"), F.col("c_name"), F.col("c_nationkey").cast("string")
    number = F.when(k % 3 == 0, F.concat(F.lit("REQ "), (k + 10000).cast("string"))).otherwise("")
    url = lambda form: F.when(k % 3 < 2, F.format_string(form, k)).otherwise("https://x.org/about")
    now = dedupe_keys(company, title, location, url("https://X.org/apply/jobs/%d/?utm_a=b"), number)
    stored_key = F.when((k % 5 == 0) & (k % 3 != 1), now[0]).otherwise(F.format_string("legacy-%d", k))
    customers = R.spread(t.customer.select("c_custkey", "c_mktsegment", "c_name", "c_nationkey"))
    state = customers.where(k % 4 == 0).select(
        stored_key.alias("state_key"), company.alias("company"), title.alias("title"), F.when(k % 5 != 0, location).alias("location"),
        url("https://x.org/en-US/jobs/%d?utm_campaign=old").alias("url"), number.alias("requisition_id"),
    )
    return S.anti_join_seen(customers.select("c_custkey", now.alias("keys")), R.stored(S.state_keys(state)), "keys", "c_custkey").select("c_custkey")


@query(
    "j2_overlay",
    """SELECT coalesce(k.key, s.key) AS key, CASE WHEN s.key IS NOT NULL THEN s.bal ELSE k.bal END AS balance, coalesce(s.nation, k.nation) AS nation
    FROM (SELECT 'n' || c_custkey AS key, round(c_acctbal, 2) AS bal, c_nationkey AS nation FROM customer) k
    FULL JOIN (SELECT 'N' || (s_suppkey * 7) AS name, 'n' || (s_suppkey * 7) AS key, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE round(s_acctbal, 2) END AS bal, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS nation FROM supplier) s ON s.key = k.key""",
)
def j2(t: Tables) -> DataFrame:
    base = t.customer.select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("key"), F.round("c_acctbal", 2).alias("balance"), F.col("c_nationkey").alias("nation"))
    k = F.col("s_suppkey")
    layer = t.supplier.select(
        F.concat(F.lit("N"), (k * 7).cast("string")).alias("key"), F.when(k % 3 != 0, F.round("s_acctbal", 2)).alias("balance"), F.when(k % 2 == 0, F.col("s_nationkey")).alias("nation"),
        F.when(k % 2 == 0, F.array(F.lit("balance"), F.lit("nation"))).otherwise(F.array(F.lit("balance"))).alias("present"),
    )
    return R.overlay(base, layer, key="key", present="present").withColumn("key", F.lower("key"))


@query(
    "j2_layers",
    "WITH o AS (SELECT o_custkey, extract(month FROM o_orderdate) AS layer, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL),"
    """ r AS (SELECT o.o_custkey AS k, layer, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 2 > 0 THEN o_orderpriority END AS priority FROM o JOIN orders USING (o_orderkey)
      UNION ALL SELECT c_custkey, 0, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 7 > 0)
    SELECT 'C' || k AS name, arg_max(price, layer) FILTER (price IS NOT NULL) AS price, arg_max(priority, layer) FILTER (priority IS NOT NULL) AS priority FROM r GROUP BY k""",
)
def j2_layers(t: Tables) -> DataFrame:
    """A base and twelve layers, one for each month, in one shuffle."""
    price, priority = F.when(F.col("r.o_orderkey") % 3 > 0, F.col("r.o_totalprice")), F.when(F.col("r.o_orderkey") % 2 > 0, F.col("r.o_orderpriority"))
    last = t.orders.groupBy("o_custkey", F.month("o_orderdate").alias("layer")).agg(F.max_by(F.struct("o_orderkey", "o_totalprice", "o_orderpriority"), "o_orderkey").alias("r"))
    rows = R.stored(last.select("layer", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"), price.alias("price"), priority.alias("priority")))
    base = t.customer.where("c_custkey % 7 > 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_acctbal").alias("price"), F.col("c_mktsegment").alias("priority"))
    layers = [rows.where(F.col("layer") == m).drop("layer") for m in range(1, 13)]
    return R.overlay(base, *layers, key="name").withColumn("name", F.upper("name"))


@query("j3_add_missing", "SELECT c_custkey AS key, 'customer' AS origin FROM customer UNION ALL SELECT s_suppkey * 50, 'supplier' FROM supplier WHERE s_suppkey * 50 NOT IN (SELECT c_custkey FROM customer)")
def j3(t: Tables) -> DataFrame:
    base = t.customer.select(F.col("c_custkey").alias("key"), F.lit("customer").alias("origin"))
    return R.add_missing(base, t.supplier.select((F.col("s_suppkey") * 50).alias("key"), F.lit("supplier").alias("origin")), "key")


def states(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.events.groupBy("user_id", (F.col("ts") < F.lit("2024-01-10").cast("timestamp")).alias("old")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    return rows.where("old").drop("old"), rows.where(~F.col("old")).drop("old")


STATES = "s AS (SELECT user_id, ts < TIMESTAMP '2024-01-10' AS old, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY ALL)"


@query("j4_upsert", f"WITH {STATES} SELECT user_id, state FROM s WHERE NOT old UNION ALL SELECT user_id, state FROM s WHERE old AND user_id NOT IN (SELECT user_id FROM s WHERE NOT old)")
def j4(t: Tables) -> DataFrame:
    return R.upsert(*states(t), "user_id")


BUCKET = "('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 256"


@query(
    "j4_bucket_upsert",
    f"""WITH s AS (SELECT user_id, ts < TIMESTAMP '2024-01-10' AS old, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY ALL), n AS (SELECT * FROM s WHERE NOT old AND user_id % 9 = 0)
    SELECT user_id, state, ({BUCKET})::INTEGER AS bucket, {BUCKET} IN (SELECT {BUCKET} FROM n) AS rewritten FROM (SELECT * FROM n UNION ALL SELECT * FROM s WHERE old AND user_id NOT IN (SELECT user_id FROM n))""",
)
def j4_buckets(t: Tables) -> DataFrame:
    """The state of some users changes: their buckets are rewritten, the other buckets' files stay."""
    old, new = states(t)
    table = S.BucketState(t.spark, f"{R.shared_folder(t.spark)}/j4-{uuid.uuid4().hex}", "user_id long, state string", "user_id", 256)
    table.upsert(old)
    changed = table.upsert(new.where("user_id % 9 = 0"))
    return table.read().withColumn("rewritten", F.col("bucket").isin(changed))


@query("j5_merge_state", f"WITH {STATES} SELECT user_id, state FROM s WHERE old UNION ALL SELECT user_id, state FROM s WHERE NOT old AND user_id NOT IN (SELECT user_id FROM s WHERE old)")
def j5(t: Tables) -> DataFrame:
    return R.merge_state(*states(t), "user_id", prefer="old")


@query(
    "j6_containment_semi_join",
    """WITH n AS (SELECT DISTINCT lower(s_name) AS b FROM supplier UNION SELECT 'bolt' UNION SELECT 'x' UNION SELECT 'the cold widget store')
    SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM n WHERE contains(lower(p_name), b) OR contains(b, lower(p_name)))""",
)
def j6(t: Tables) -> DataFrame:
    names = t.supplier.select("s_name").union(t.spark.createDataFrame([("Bolt",), ("X",), ("The Cold Widget Store",)], "s_name string"))
    return R.containment_semi_join(t.part, names, "p_name", "s_name").select("p_partkey")


@query(
    "j7_enrich_with_budget",
    """WITH w AS (SELECT doc_id, source, n_chars > 800 AS wanted, sum(CASE WHEN n_chars > 800 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
    SELECT doc_id, CASE WHEN wanted AND n <= 5 AND quality IS NOT NULL THEN 'q' || quality ELSE 'listed' END AS note FROM w LEFT JOIN labels USING (doc_id)""",
)
def j7(t: Tables) -> DataFrame:
    listed = t.documents.select("doc_id", "source", "n_chars", F.lit("listed").alias("note"))
    details = t.labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("note"))
    return R.enrich_with_budget(listed, details, "doc_id", "source", "doc_id", 5, F.col("n_chars") > 800, ["note"]).select("doc_id", "note")


@query("j8_validated", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE n_chars >= 200 AND quality = 1")
def j8(t: Tables) -> DataFrame:
    return R.approved(t.documents, t.labels, "doc_id", F.col("quality") == 1).where("n_chars >= 200").select("doc_id")


@query("j9_canonical_name", "SELECT s_suppkey, CASE WHEN n_nationkey IS NULL THEN s_name ELSE n_name END AS canonical FROM supplier LEFT JOIN nation ON s_suppkey = n_nationkey * 2")
def j9(t: Tables) -> DataFrame:
    aliases = t.nation.select(F.format_string("SUPPLIER#%09d", F.col("n_nationkey") * 2).alias("alias"), F.col("n_name").alias("canonical"))
    return R.with_canonical_name(t.supplier, aliases, "s_name").select("s_suppkey", "canonical")


@query("j10_coverage", "SELECT c_custkey, c_custkey IN (SELECT s_suppkey FROM supplier) AS covered FROM customer")
def j10(t: Tables) -> DataFrame:
    labels = t.supplier.select(F.explode(F.array(F.concat(F.lit("customer "), F.format_string("%09d", "s_suppkey")), F.lit("other"))).alias("label"))
    return R.coverage(t.customer, labels, "c_name", "label", match_text).select("c_custkey", "covered")


@query("j11_deferred", "SELECT c_custkey, NOT (c_custkey % 3 = 0 AND c_custkey // 3 IN (SELECT s_suppkey FROM supplier)) AS enabled FROM customer")
def j11(t: Tables) -> DataFrame:
    deferred = t.supplier.select((F.col("s_suppkey") * 3).alias("c_custkey"), F.lit("deferred").alias("status"))
    return R.with_deferred(t.customer, deferred, "c_custkey").select("c_custkey", "enabled")


@query("j12_request_plan", 'SELECT r_name AS term, n_name AS place, "offset" FROM region, nation, (SELECT unnest(range(0, 60, 20)) AS "offset") WHERE n_regionkey = 1')
def j12(t: Tables) -> DataFrame:
    plan = R.request_plan(t.region.select(F.col("r_name").alias("term")), t.nation.where("n_regionkey = 1").select(F.col("n_name").alias("place")), 60, 20)
    return plan.withColumn("offset", F.col("offset").cast("long"))


@query("x1_union_in_order", "SELECT row_number() OVER (ORDER BY o, k) AS ord, name FROM (SELECT 0 AS o, r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation)")
def x1(t: Tables) -> DataFrame:
    both = t.region.select(F.lit(0).alias("source_ord"), F.col("r_regionkey").alias("item_ord"), F.col("r_name").alias("name"))
    both = both.unionByName(t.nation.select(F.lit(1).alias("source_ord"), F.col("n_nationkey").alias("item_ord"), F.col("n_name").alias("name")))
    return R.numbered(both, ["source_ord", "item_ord"], "ord").select("ord", "name")


@query(
    "x2_differences",
    """SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL
    SELECT doc_id + 1000000, 'unexpected' FROM labels WHERE toxic = 1""",
)
def x2(t: Tables) -> DataFrame:
    actual = t.labels.select("doc_id").union(t.labels.where("toxic = 1").select(F.col("doc_id") + 1000000))
    return R.differences(t.documents, actual, "doc_id")


@query("x3_missing_parts", "SELECT i AS part FROM range(0, 400) r(i) WHERE i NOT IN (SELECT s_suppkey * 2 FROM supplier)")
def x3(t: Tables) -> DataFrame:
    return R.missing_parts(t.supplier.select((F.col("s_suppkey") * 2).alias("part")), "part", 400)


@query("x4_unconfigured", "SELECT c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) AND c_custkey NOT IN (SELECT n_nationkey * 100 FROM nation) ORDER BY lower(c_name)")
def x4(t: Tables) -> DataFrame:
    known = t.supplier.select(F.format_string("customer#%09d", "s_suppkey")), t.nation.select(F.format_string("customer#%09d", F.col("n_nationkey") * 100))
    return R.without_names(t.customer, "c_name", *known).orderBy(F.lower("c_name")).select("c_name")


@query("x5_union_distinct", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT n_name FROM nation")
def x5(t: Tables) -> DataFrame:
    names = t.nation.select(F.col("n_name").alias("name"))
    return R.union_distinct(names, t.region.select("r_name"), names).orderBy("name")


@query("a1_status_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def a1(t: Tables) -> DataFrame:
    return P.status_counts(t.orders, "o_orderstatus")


@query(
    "a2_effective_status",
    """WITH e AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'REDIRECT' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'O' END AS resolved, o_orderpriority FROM orders)
    SELECT coalesce(resolved, status) AS effective, count(*) AS n, count(*) FILTER (coalesce(resolved, status) IN ('O', 'F') AND o_orderpriority <> '5-LOW') AS promotable FROM e GROUP BY 1""",
)
def a2(t: Tables) -> DataFrame:
    pending = F.col("o_orderstatus") == "P"
    status, resolved = F.when(pending, "REDIRECT").otherwise(F.col("o_orderstatus")), F.when(pending & (F.col("o_orderkey") % 2 == 0), "O")
    return P.effective_counts(t.orders, status, resolved, F.col("effective").isin("O", "F") & (F.col("o_orderpriority") != "5-LOW"))


@query("a3_conditional_counts", "SELECT count(*) FILTER (o_orderstatus = 'O') AS working, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderstatus = 'P') AS unresolved, count(*) FILTER (o_orderstatus = 'F') > 0 AS failing FROM orders")
def a3(t: Tables) -> DataFrame:
    return P.conditional_counts(t.orders, "o_orderstatus", {"working": "O", "failed": "F", "unresolved": "P"})


@query(
    "a4_coverage_summary",
    "SELECT count(*) AS configured, count(*) FILTER (n > 0) AS enabled, count(DISTINCT event_type) AS labels, count(*) FILTER (n > 10) AS nonempty, count(*) FILTER (errors > 0) AS failed FROM (SELECT user_id, min(event_type) AS event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)",
)
def a4(t: Tables) -> DataFrame:
    each = t.events.groupBy("user_id").agg(F.min("event_type").alias("label"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return P.coverage_summary(each, "label", F.col("n") > 0, F.col("n") > 10, F.col("errors") > 0)


@query(
    "a5_limited_list",
    """WITH l AS (SELECT o_orderstatus, list(DISTINCT 'c' || (o_custkey % 40) ORDER BY 'c' || (o_custkey % 40)) AS l FROM orders GROUP BY 1)
    SELECT o_orderstatus, array_to_string(l[1:15], ', ') || CASE WHEN len(l) > 15 THEN ' (+' || (len(l) - 15) || ' more)' ELSE '' END AS names FROM l""",
)
def a5(t: Tables) -> DataFrame:
    name = F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string"))
    return R.limited_names(t.orders.select("o_orderstatus", name.alias("name")), "o_orderstatus", "name", 15)


@query(
    "a6_identity_conflicts",
    """WITH r AS (SELECT 'b' || p_brand AS identity, 't' || p_type || (p_size // 10) AS name FROM part)
    SELECT identity AS key, count(DISTINCT name) AS n, 'identity' AS kind FROM r GROUP BY 1 HAVING count(DISTINCT name) > 1 UNION ALL
    SELECT name, count(DISTINCT identity), 'name' FROM r GROUP BY 1 HAVING count(DISTINCT identity) > 1""",
)
def a6(t: Tables) -> DataFrame:
    rows = t.part.select(F.concat(F.lit("b"), "p_brand").alias("identity"), F.concat(F.lit("t"), "p_type", F.floor(F.col("p_size") / 10).cast("string")).alias("name"))
    return R.identity_conflicts(rows, "identity", "name")


@query("a7_duplicate_names", "SELECT lower(p_name) AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def a7(t: Tables) -> DataFrame:
    return P.duplicates(t.part, F.lower("p_name"))


@query(
    "a8_anchor_counts",
    """WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages)
    SELECT page_id, count(DISTINCT h) AS links, least(count(DISTINCT h) FILTER (regexp_matches(h, '[aeiou]n')), 10) AS targets FROM a GROUP BY 1""",
)
def a8(t: Tables) -> DataFrame:
    return P.link_counts(t.pages, "page_id", "[aeiou]n")


@query(
    "a9_multiset_difference",
    """WITH s AS (SELECT l_orderkey % 100 AS g, l_returnflag || l_linestatus || l_quantity::INT AS sig, l_linenumber % 2 AS side FROM lineitem),
    c AS (SELECT g, sig, count(*) FILTER (side = 0) AS o, count(*) FILTER (side = 1) AS c FROM s GROUP BY ALL)
    SELECT g, sum(greatest(c - o, 0))::BIGINT AS changed FROM c GROUP BY 1 HAVING sum(greatest(c - o, 0)) > 0""",
)
def a9(t: Tables) -> DataFrame:
    rows = t.lineitem.select((F.col("l_orderkey") % 100).alias("g"), F.concat("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string")).alias("sig"), "l_linenumber")
    return R.multiset_difference(rows.where("l_linenumber % 2 = 0"), rows.where("l_linenumber % 2 = 1"), "g", "sig")


@query("w1_limit_per_source", "SELECT doc_id, source, n FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 7")
def w1(t: Tables) -> DataFrame:
    return P.limit_per_group(t.documents.select("doc_id", "source"), "source", ["doc_id"], 7)


@query("w2_single_best", "SELECT conv_id, arg_min(turn, (-length(text), turn)) AS turn FROM conversations GROUP BY 1")
def w2(t: Tables) -> DataFrame:
    return R.first_per_key(t.conversations, ["conv_id"], [F.desc(F.length("text")), "turn"]).select("conv_id", "turn")


@query(
    "w3_change_detection",
    """WITH r AS (SELECT user_id, date_trunc('day', ts) AS run, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY ALL)
    SELECT user_id, run, failed, coalesce(failed <> lag(failed) OVER (PARTITION BY user_id ORDER BY run), true) AS changed FROM r""",
)
def w3(t: Tables) -> DataFrame:
    runs = t.events.groupBy("user_id", F.date_trunc("day", "ts").alias("run")).agg(F.count_if(F.col("event_type") == "error").alias("failed"))
    return P.changes(runs, "user_id", "run", "failed")


@query("o1_stable_sort", "SELECT row_number() OVER (ORDER BY quality DESC, toxic DESC, doc_id) AS place, doc_id FROM labels")
def o1(t: Tables) -> DataFrame:
    return R.numbered(t.labels, [F.desc("quality"), F.desc("toxic"), "doc_id"], "place").select("place", "doc_id")


@query("o2_top_alerts", "SELECT doc_id, (SELECT greatest(count(*) - 15, 0) FROM documents) AS remaining FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15")
def o2(t: Tables) -> DataFrame:
    return P.top_rows(t.documents, [F.desc("n_chars"), "doc_id"], 15).select("doc_id", "remaining")


@query("o3_sort_by_name", "SELECT row_number() OVER (ORDER BY lower(p_name), p_partkey) AS place, p_partkey FROM part")
def o3(t: Tables) -> DataFrame:
    return R.numbered(t.part, [F.lower("p_name"), "p_partkey"], "place").select("place", "p_partkey")


@query("o4_input_order", "SELECT row_number() OVER (ORDER BY event_id) AS place, event_id, event_type FROM events")
def o4(t: Tables) -> DataFrame:
    """Rows that were dealt anew, put back in their order and numbered."""
    return R.numbered(t.events.select("event_id", "event_type").repartition(16, "event_type"), ["event_id"], "place")


@query("o5_batch_slice", "SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey LIMIT 25 OFFSET 50")
def o5(t: Tables) -> DataFrame:
    return R.ordered_batch(t.part.select("p_partkey", "p_name"), [F.lower("p_name"), "p_partkey"], 2, 25)


@query(
    "o6_chunks",
    """SELECT l_suppkey, ((n - 1) // 40)::INT AS chunk, string_agg(l_orderkey, ',' ORDER BY n) AS ids FROM (SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS n FROM lineitem) GROUP BY ALL""",
)
def o6(t: Tables) -> DataFrame:
    chunks = R.in_chunks(t.lineitem, "l_suppkey", "l_orderkey", "l_orderkey", 40)
    return chunks.select("l_suppkey", "chunk", F.array_join("values", ",").alias("ids"))


@query("o7_reordered", "SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderpriority) AS items FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) GROUP BY 1")
def o7(t: Tables) -> DataFrame:
    items = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("items"))
    return items.select("o_custkey", F.array_join(R.reordered(F.col("items"), ["5-LOW", "1-URGENT"]), ",").alias("items"))


