"""Queries of the grounding checks, over documents with the benchmark's items as evidence."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators import grounding as G
from larkspur.operators.relational import numbered
from larkspur.plans.base import Tables, query
from larkspur.plans.text import TECH
from larkspur.plans.values import TOKENS


def claims(t: Tables) -> DataFrame:
    """Each document with an item as its quote, and a claim made of both."""
    quotes = numbered(t.benchmark.select("item_id", F.col("text").alias("quote")), ["item_id"], "k")
    n = quotes.count()
    docs = t.documents.withColumn("k", F.pmod("doc_id", F.lit(n)) + 1)  # each item is some document's quote
    rows = docs.join(quotes.hint("merge"), "k")
    quote = F.substring("quote", 1, 60)
    source = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" "), "quote")).otherwise(F.col("text"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(quote, F.lit(" in 42% of cases"))).when(F.col("doc_id") % 5 == 0, "TBD").when(F.col("doc_id") % 7 == 0, F.substring("text", 1, 60)).otherwise(quote)
    return rows.select("doc_id", source.alias("source"), F.array(quote).alias("evidence"), text.alias("text"))


CLAIMS = """c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN d.text || ' ' || quote ELSE d.text END AS source, substr(quote, 1, 60) AS q,
  CASE WHEN doc_id % 3 = 0 THEN substr(quote, 1, 60) || ' in 42% of cases' WHEN doc_id % 5 = 0 THEN 'TBD' WHEN doc_id % 7 = 0 THEN substr(d.text, 1, 60) ELSE substr(quote, 1, 60) END AS text
  FROM documents d JOIN (SELECT row_number() OVER (ORDER BY item_id) AS k, count(*) OVER () AS n, text AS quote FROM benchmark) ON k = doc_id % n + 1)"""
VALID = f"(length(trim(q)) >= 4 AND contains({TECH.format('source')}, {TECH.format('q')}))"
NUMBERS = "regexp_extract_all(regexp_replace(coalesce({0}, ''), '([0-9]+(\\.[0-9]+)?%?\\+?)', '\\1' || chr(1), 'g'), '(?:^|[^A-Za-z])([0-9]+(\\.[0-9]+)?%?\\+?)', 1)"


@query("g1_evidence_valid", f"WITH {CLAIMS} SELECT doc_id, {VALID} AS ok FROM c")
def g1(t: Tables) -> DataFrame:
    return claims(t).select("doc_id", G.evidence_valid(F.col("evidence"), F.col("source")).alias("ok"))


Q_TOKENS = TOKENS.replace("coalesce(text, '')", "coalesce(q, '')")
TERMS = ", ".join(f"' {re.sub('[^a-z0-9+#./]+', ' ', t)} '" for t in G.TECH_TERMS)
PLACEHOLDERS = " OR ".join(f"contains(lower(text), '{p}')" for p in G.PLACEHOLDERS)
#: The rules of `grounding.rejection`, in its order; a missing text is an empty one.
REASON = f"""k AS (SELECT *, list_distinct({TOKENS}) AS tt, list_distinct({Q_TOKENS}) AS qt, ' ' || {TECH.format('text')} || ' ' AS tf, ' ' || {TECH.format('q')} || ' ' AS qf FROM c)
    SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN length(text) > 120 THEN 'too long' WHEN {PLACEHOLDERS} THEN 'placeholder' WHEN regexp_matches(text, '[\u200b\u200c\u200d]') THEN 'hidden character'
    WHEN NOT {VALID} THEN 'invalid evidence'
    WHEN len(list_filter({NUMBERS.format('text')}, lambda x: NOT list_contains({NUMBERS.format('q')}, x))) > 0 THEN 'unsupported number'
    WHEN len(list_filter([{TERMS}], lambda x: contains(tf, x) AND NOT contains(qf, x))) > 0 THEN 'unsupported term'
    WHEN len(tt) > 0 AND len(list_filter(tt, lambda x: NOT list_contains(qt, x))) / len(tt) > 0.35 THEN 'too many new words' END"""


@query("g2_rejection", f"WITH {CLAIMS}, {REASON} AS reason FROM k")
def g2(t: Tables) -> DataFrame:
    return claims(t).select("doc_id", G.rejection(F.col("text"), F.col("evidence"), F.col("source"), 120).alias("reason"))


#: The claims with sources of parts: a missing part is none, the others stay.
PARTS = CLAIMS.replace("d.text || ' ' || quote", "coalesce(d.text || ' ', '') || quote")


@query("g2_claims", f"WITH {PARTS}, {REASON} AS reject_reason FROM k")
def g2_claims(t: Tables) -> DataFrame:
    """Claims against the parts of their sources: a document, and for every other one the quote as a second part."""
    rows = claims(t).select("doc_id", "text", "evidence")
    quotes = numbered(t.benchmark.select("item_id", F.col("text").alias("quote")), ["item_id"], "k")
    n = quotes.count()
    docs = t.documents.withColumn("k", F.pmod("doc_id", F.lit(n)) + 1)
    second = docs.where("doc_id % 2 = 0").join(quotes.hint("merge"), "k").select("doc_id", F.lit(1).alias("idx"), F.col("quote").alias("text"))
    return G.check_claims(rows, docs.select("doc_id", F.lit(0).alias("idx"), "text").union(second), 120).select("doc_id", "reject_reason")


@query("g3_contains_phrase", f"SELECT doc_id, contains(' ' || {TECH.format('text')} || ' ', ' of the ') AS ok FROM documents")
def g3(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", G.contains_phrase(F.col("text"), F.lit("OF, the")).alias("ok"))


SKILLS = ("of the", "ndre", "de la Ville", "er.", "und, nicht")


def sql_skills(form: str) -> str:
    tests = {"of the": ("of the", "the"), "ndre": ("ndre",), "de la Ville": ("de la ville", "ville"), "er.": ("er.",), "und, nicht": ("und nicht", "und", "nicht")}
    each = [f"CASE WHEN {' OR '.join(f'contains({form}, chr(32) || {chr(39)}{p}{chr(39)} || chr(32))' for p in ps)} THEN '{s}' END" for s, ps in tests.items()]
    return f"list_filter([{', '.join(each)}], lambda x: x IS NOT NULL)"


@query("g4_skills_in", f"SELECT doc_id, array_to_string({sql_skills('f')}, ';') AS skills FROM (SELECT doc_id, ' ' || {TECH.format('text')} || ' ' AS f FROM documents)")
def g4(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(G.skills_in(F.array(*map(F.lit, SKILLS)), F.col("text")), ";").alias("skills"))


@query(
    "g5_gaps",
    f"""WITH f AS (SELECT conv_id, turn, ' ' || {TECH.format('text')} || ' ' AS p, ' ' || {TECH.format("lag(text) OVER (PARTITION BY conv_id ORDER BY turn)")} || ' ' AS s FROM conversations)
    SELECT conv_id, turn, array_to_string(list_filter(['the', 'and', 'of', 'de', 'la', 'is', 'to', 'der'], lambda x: contains(p, ' ' || x || ' ') AND NOT contains(s, ' ' || x || ' '))[1:5], ',') AS gaps FROM f""",
)
def g5(t: Tables) -> DataFrame:


    before = t.conversations.withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")))
    return before.select("conv_id", "turn", F.array_join(G.gaps(F.col("text"), F.col("before"), ("the", "and", "of", "de", "la", "is", "to", "der")), ",").alias("gaps"))


@query(
    "g6_proposal_reason",
    """SELECT event_id, CASE WHEN i IS NULL THEN 'malformed' WHEN i >= 40 THEN 'out of range' WHEN r > 0 THEN 'duplicate index' WHEN event_type = 'error' THEN 'ungrounded' WHEN value <= 50 THEN 'unchanged' END AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, i ORDER BY event_id) - 1 AS r FROM (SELECT *, CASE WHEN event_id % 9 <> 0 THEN regexp_extract(props, '([0-9]+)', 1)::INT % 50 END AS i FROM events))""",
)
def g6(t: Tables) -> DataFrame:


    rows = t.events.withColumn("i", F.when(F.col("event_id") % 9 != 0, F.get_json_object("props", "$.k").cast("int") % 50))
    repeat = F.row_number().over(W.partitionBy("user_id", "i").orderBy("event_id")) - 1
    text = F.when(F.col("value") > 50, "builder improved throughput").otherwise("throughput, better")
    return rows.withColumn("r", repeat).select(
        "event_id", G.proposal_reason(F.col("i"), F.lit(40), F.col("r"), F.col("event_type") != "error", text, F.lit("better: throughput")).alias("reason")
    )


@query(
    "g7_valid_permutation",
    """WITH l AS (SELECT o_custkey, list((o_orderkey % 4)::INT ORDER BY o_orderkey) AS l FROM orders GROUP BY 1)
    SELECT o_custkey, array_to_string(CASE WHEN list_sort(l) = range(0, len(l)) THEN l ELSE range(0, len(l)) END, ',') AS p FROM l""",
)
def g7(t: Tables) -> DataFrame:
    lists = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_orderkey") % 4).cast("int").alias("v")))).alias("l"))
    values = F.transform("l", lambda x: x["v"])
    return lists.select("o_custkey", F.array_join(G.valid_permutation(values, F.size("l")), ",").alias("p"))


@query(
    "g8_surfaced",
    f"""WITH f AS (SELECT conv_id, turn, ' ' || {TECH.format('text')} || ' ' AS a, ' ' || {TECH.format("lag(text) OVER (PARTITION BY conv_id ORDER BY turn)")} || ' ' AS b FROM conversations)
    SELECT conv_id, turn, array_to_string(list_filter({sql_skills('a')}, lambda x: NOT list_contains({sql_skills('b')}, x)), ';') AS surfaced FROM f""",
)
def g8(t: Tables) -> DataFrame:


    skills = F.array(*map(F.lit, SKILLS))
    rows = t.conversations.withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")))
    rows = rows.select("conv_id", "turn", G.skills_in(skills, F.col("before")).alias("b"), G.skills_in(skills, F.col("text")).alias("a"))
    return rows.select("conv_id", "turn", F.array_join(G.surfaced(F.col("b"), F.col("a")), ";").alias("surfaced"))


@query(
    "g9_improvement_reason",
    "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'no substantive summary change' WHEN p_size % 4 < least(2, p_size % 3) THEN 'not enough supported skills surfaced' WHEN p_size < 10 THEN 'nothing rewritten' END AS reason FROM part",
)
def g9(t: Tables) -> DataFrame:
    n = F.col("p_size")
    return t.part.select("p_partkey", G.improvement_reason(n % 5 != 0, n % 4, n % 3, F.floor(n / 10)).alias("reason"))


@query(
    "g10_change_labels",
    """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'summary rewritten' END, CASE WHEN p_size % 3 = 0 THEN 'skills prioritized' END, CASE WHEN p_size // 10 > 0 THEN 'items rewritten (' || p_size // 10 || ')' WHEN p_size % 7 = 0 THEN 'items reordered' END], lambda x: x IS NOT NULL), '; ') AS labels FROM part""",
)
def g10(t: Tables) -> DataFrame:
    n = F.col("p_size")
    return t.part.select("p_partkey", F.array_join(G.change_labels(n % 2 == 0, n % 3 == 0, F.floor(n / 10), n % 7 == 0), "; ").alias("labels"))


@query("g11_skill_catalog", "SELECT p_partkey, p_name || ';' || p_brand || CASE WHEN lower(p_type) = 'promo' THEN '' ELSE ';' || p_type END AS skills FROM part")
def g11(t: Tables) -> DataFrame:
    lines = F.array(F.concat(F.lit("Tools: "), "p_name", F.lit(", "), "p_brand", F.lit(" , "), F.upper("p_name")), F.concat(F.lit("Other:"), F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_type"))))
    return t.part.select("p_partkey", F.array_join(G.skill_catalog(lines), ";").alias("skills"))


