"""Queries of the value functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import values as V
from larkspur.operators.relational import spread
from larkspur.plans.base import Tables, query
from larkspur.plans.text import CLEAN, MATCH

STOP = ", ".join(f"'{w}'" for w in V.STOPWORDS)
TOKENS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '([a-z][a-z0-9+#./-]{{2,}})', 1), lambda x: x NOT IN ({STOP}))"


@query(
    "n1_flatten_text",
    f"""WITH s AS (SELECT p_partkey, p_name, p_brand, string_split(p_name || ';' || p_type || '; ' || upper(p_name) || ' ;; ' || p_brand, ';') AS l FROM part),
    e AS (SELECT p_partkey, p_name, p_brand, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM s),
    c AS (SELECT p_partkey, p_name, p_brand, i, {CLEAN.format('x')} AS x FROM e),
    f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, {MATCH.format('x')} ORDER BY i) AS n FROM c)
    SELECT p_partkey, string_agg(x, '; ' ORDER BY i) AS place, CASE p_partkey % 4 WHEN 0 THEN place WHEN 2 THEN 'India ' || p_name || ' India ' || p_brand ELSE p_name END AS location
    FROM f WHERE n = 1 AND x <> '' GROUP BY p_partkey, p_name, p_brand""",
)
def n1(t: Tables) -> DataFrame:
    text = F.concat("p_name", F.lit(";"), "p_type", F.lit("; "), F.upper("p_name"), F.lit(" ;; "), "p_brand")
    own = F.concat("p_name", F.lit(" {'descriptor': 'India', 'alpha2Code': 'IN'}"))
    nested = F.concat(F.lit("{'city': '"), "p_name", F.lit("', 'descriptor': 'India', 'alpha2Code': None, 'country': {'name': 'India', 'region': '"), "p_brand", F.lit("'}}"))
    listed = F.concat(F.lit('["'), "p_name", F.lit(', India", {"name": "'), "p_name", F.lit('", "zip": 1}]'))
    location = F.get(F.array(text, own, nested, listed), (F.col("p_partkey") % 4).cast("int"))
    return t.part.select("p_partkey", V.flatten_text(text).alias("place"), V.flatten_location(location).alias("location"))


@query("n1_nested_location", f"""SELECT p_partkey, {CLEAN.format("p_name || ' ' || p_brand")} AS location FROM part""")
def n1_nested(t: Tables) -> DataFrame:
    """Ten levels, objects and lists in turn, in JSON or as literals, with brackets in the texts of other fields."""
    place = F.concat(F.lit("{'city': '"), "p_name", F.lit("', 'region': '"), "p_brand", F.lit("', 'zip': '}]'}"))
    for level in range(10):
        place = F.concat(F.lit("{'location': "), place, F.lit(", 'region': None, 'x': [{}]}")) if level % 2 else F.concat(F.lit("["), place, F.lit(", '', []]"))
    json = F.replace(F.replace(place, F.lit("'"), F.lit('"')), F.lit("None"), F.lit("null"))
    return spread(t.part.select("p_partkey", "p_name", "p_brand")).select("p_partkey", V.flatten_location(F.when(F.col("p_partkey") % 2 == 0, place).otherwise(json)).alias("location"))


@query("n2_flatten_fields", "SELECT c_custkey, c_name || ' ' || c_mktsegment || CASE WHEN c_nationkey > 10 THEN ' ' || c_nationkey ELSE '' END AS place FROM customer")
def n2(t: Tables) -> DataFrame:
    nation = F.when(F.col("c_nationkey") > 10, F.col("c_nationkey").cast("string"))
    return t.customer.select("c_custkey", V.flatten_fields([F.col("c_name"), F.lower("c_name"), F.lit(" "), F.col("c_mktsegment"), nation]).alias("place"))


@query("n3_merge_places", "SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN s_name || '; Pune' ELSE s_name || '; Pune' END AS places FROM supplier")
def n3(t: Tables) -> DataFrame:
    long, short = F.concat("s_name", F.lit(", India")), F.col("s_name")
    even = F.col("s_nationkey") % 2 == 0
    items = F.array(F.when(even, long).otherwise(short), F.lit("Pune"), F.when(even, short).otherwise(long), F.lit("pune IND"))
    return t.supplier.select("s_suppkey", V.merge_places(items).alias("places"))


@query("n4_schema_place", "SELECT s_suppkey, s_name || ' KA India' || CASE WHEN s_acctbal > 5000 THEN '; Remote India' ELSE '' END AS place FROM supplier")
def n4(t: Tables) -> DataFrame:
    place = F.array(F.struct(F.col("s_name").alias("locality"), F.lit("KA").alias("region"), F.lit("India").alias("country")))
    return t.supplier.select("s_suppkey", V.schema_place(place, F.col("s_acctbal") > 5000, F.array(F.lit("India"))).alias("place"))


@query("n5_nested_places", "SELECT o_custkey, string_agg(DISTINCT o_orderstatus || '; ' || o_orderpriority, '; ' ORDER BY o_orderstatus || '; ' || o_orderpriority) AS places FROM orders GROUP BY 1")
def n5(t: Tables) -> DataFrame:
    place = F.struct(F.struct(F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("city")).alias("address"))
    places = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set(place)).alias("l"))
    return places.select("o_custkey", V.nested_places(F.col("l"), lambda x: [x["address"]["state"], x["address"]["city"]]).alias("places"))


@query(
    "n6_facet_search",
    """WITH f AS (SELECT o_custkey, o_orderkey::VARCHAR AS id, CASE o_orderstatus WHEN 'F' THEN 'locationCountry' WHEN 'O' THEN 'locations' ELSE 'places' END AS parameter,
      CASE WHEN o_orderpriority = '2-HIGH' THEN 1 WHEN o_orderstatus = 'F' THEN 0 ELSE 2 END AS rank FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
    SELECT o_custkey, arg_min(parameter, [rank::VARCHAR, parameter, id]) AS parameter, arg_min(id, [rank::VARCHAR, parameter, id]) AS id FROM f GROUP BY 1""",
)
def n6(t: Tables) -> DataFrame:
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "INDIA").when(F.col("o_orderpriority") == "2-HIGH", "Karnataka, India").otherwise("Goa")
    parameter = F.when(F.col("o_orderstatus") == "F", "locationCountry").when(F.col("o_orderstatus") == "O", "locations").otherwise("places")
    value = F.struct(name.alias("descriptor"), F.col("o_orderkey").cast("string").alias("id"))
    facets = t.orders.groupBy("o_custkey", parameter.alias("facetParameter")).agg(F.collect_list(value).alias("values"))
    json = F.to_json(F.struct("facetParameter", "values"))
    json = F.when(F.col("facetParameter") == "places", F.concat(F.lit('{"facetParameter": "outer", "values": ['), json, F.lit("]}"))).otherwise(json)  # one level deeper
    found = facets.groupBy("o_custkey").agg(F.concat(F.lit("["), F.array_join(F.collect_list(json), ","), F.lit("]")).alias("facets"))
    return found.select("o_custkey", V.find_facet(F.col("facets")).alias("f")).where("f is not null").select("o_custkey", "f.parameter", "f.id")


@query(
    "n6_nested_facets",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'locationCountry' ELSE 'state' END AS parameter, 'deep' || o_orderkey AS id FROM orders",
)
def n6_nested(t: Tables) -> DataFrame:
    """A country ten levels down, before others on the way, or a state."""
    k = F.col("o_orderkey")
    deep = F.when(k % 3 > 0, F.format_string('{"facetParameter": "locationCountry", "values": [{"descriptor": "INDIA", "id": "deep%d"}]}', k))
    facet = deep.otherwise(F.format_string('{"facetParameter": "state", "values": [null, {"descriptor": "Karnataka", "id": "deep%d", "values": null}]}', k))
    for level in range(10):
        facet = F.concat(F.lit(f'{{"facetParameter": "level{level}", "values": [{{"descriptor": "Goa", "id": "g{level}"}}, '), facet, F.lit(f', {{"descriptor": "India", "id": "i{level}"}}]}}'))
    return spread(t.orders.select("o_orderkey")).select("o_orderkey", V.find_facet(F.concat(F.lit("["), facet, F.lit("]"))).alias("f")).select("o_orderkey", "f.parameter", "f.id")


PAY_SQL = "CASE WHEN p_size % 4 = 0 THEN 'Posted ₹' || p_size || '–' || (p_size + 2) || '.5 LPA' WHEN p_size % 4 = 1 THEN 'Posted ₹' || p_size || '–' || (p_size + 1) || ' LPA'"


def pay_source(t: Tables) -> DataFrame:
    n, m = F.col("p_size").cast("string"), F.col("p_size")
    short = F.concat(F.lit("Pay ₹ "), n, F.lit(" – "), (m + 2).cast("string"), F.lit(".5 LPA"))
    long = F.concat(F.lit("INR "), n, F.lit(",00,000 to "), (m + 1).cast("string"), F.lit(",00,000 per annum"))
    return t.part.withColumn("pay", F.when(m % 4 == 0, short).when(m % 4 == 1, long).when(m % 4 == 2, F.concat(n, F.lit("0 - 9 lpa"))).otherwise(""))


@query(
    "n7_posted_pay",
    "SELECT p_partkey, CASE WHEN p_size % 4 < 2 THEN p_size::DOUBLE END AS low, CASE WHEN p_size % 4 = 0 THEN p_size + 2.5::DOUBLE WHEN p_size % 4 = 1 THEN p_size + 1::DOUBLE END AS high FROM part",
)
def n7(t: Tables) -> DataFrame:
    return pay_source(t).select("p_partkey", V.posted_pay(F.col("pay")).alias("p")).select("p_partkey", "p.low", "p.high")


@query("n8_pay_label", f"SELECT p_partkey, {PAY_SQL} WHEN p_size % 3 = 0 THEN 'Est. ₹10–22 LPA' WHEN p_size % 3 = 1 THEN 'Est. ₹6–14 LPA' ELSE 'Est. ₹7–15 LPA' END AS pay FROM part")
def n8(t: Tables) -> DataFrame:
    m = F.col("p_size")
    title = F.when(m % 3 == 0, "ML-Engineer").when(m % 3 == 1, "BI Analyst").otherwise(F.col("p_name"))
    return pay_source(t).select("p_partkey", V.pay_label(title, F.col("pay")).alias("pay"))


@query("n9_lakh", "SELECT p_partkey, regexp_replace(printf('%.1f', p_size / 2.0), '\\.0$', '') AS pay FROM part")
def n9(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", V.lakh(F.col("p_size") / F.lit(2.0)).alias("pay"))


@query("n10_is_stale", "SELECT event_id, ts < TIMESTAMP '2024-01-20' OR coalesce(CASE WHEN user_id % 2 = 0 THEN ts END < TIMESTAMP '2024-01-26', false) AS stale FROM events")
def n10(t: Tables) -> DataFrame:
    through = F.when(F.col("user_id") % 2 == 0, F.col("ts"))
    return t.events.select("event_id", V.is_stale(through, F.col("ts"), F.lit("2024-01-26").cast("timestamp"), 6).alias("stale"))


@query("n11_mail_date", "SELECT event_id, date_trunc('second', ts) AS at FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def n11(t: Tables) -> DataFrame:
    written = F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return t.events.select("event_id", V.mail_date(written).alias("at")).where(F.col("at") >= F.lit("2024-01-10").cast("timestamp"))


@query("n12_safe_int", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN user_id::INT ELSE 0 END AS n FROM events")
def n12(t: Tables) -> DataFrame:
    return t.events.select("event_id", V.safe_int(F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).otherwise("n/a")).alias("n"))


ODD_NUMBERS = " .5 3.5.2 a12 b1.5 5%6 7+8 9%+ x"


@query(
    "n13_numbers_in",
    f"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(coalesce(text, '') || '{ODD_NUMBERS}', '([0-9]+(\\.[0-9]+)?%?\\+?)', '\\1' || chr(1), 'g'),
    '(?:^|[^A-Za-z])([0-9]+(\\.[0-9]+)?%?\\+?)', 1))), ' ') AS numbers FROM documents""",
)
def n13(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(F.array_sort(V.numbers_in(F.concat("text", F.lit(ODD_NUMBERS)))), " ").alias("numbers"))


@query("n14_token_set", f"SELECT doc_id, array_to_string(list_sort(list_distinct({TOKENS})), ' ') AS tokens FROM documents")
def n14(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(F.array_sort(V.token_set(F.col("text"))), " ").alias("tokens"))


@query("n15_signature", f"SELECT conv_id, turn, array_to_string(list_sort({TOKENS}), ' ') AS signature FROM conversations")
def n15(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.array_join(V.signature(F.col("text")), " ").alias("signature"))
