"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import urls as U
from larkspur.plans.base import Tables, query

#: Pieces of SQL that several queries use.
NAMES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "''", "nbsp": "\u00a0", "copy": "©", "middot": "·", "eacute": "é", "notin": "∉", "hellip": "…"}
DECODED = (
    "array_to_string(list_transform(string_split({0}, '&'), lambda x, i: CASE WHEN i = 1 THEN x"
    " WHEN regexp_matches(x, '^#[0-9]+;?') THEN chr(regexp_extract(x, '^#([0-9]+)', 1)::INT) || regexp_replace(x, '^#[0-9]+;?', '')"
    " WHEN regexp_matches(x, '^#[xX][0-9a-fA-F]+;?') THEN chr(('0x' || regexp_extract(x, '^#[xX]([0-9a-fA-F]+)', 1))::INT) || regexp_replace(x, '^#[xX][0-9a-fA-F]+;?', '') "
    + " ".join(f"WHEN starts_with(x, '{n};') THEN '{v}' || x[{len(n) + 2}:]" for n, v in NAMES.items())
    + " WHEN regexp_matches(x, '^(amp|lt|gt|copy)') THEN CASE WHEN starts_with(x, 'amp') THEN '&' || x[4:] WHEN starts_with(x, 'lt') THEN '<' || x[3:] WHEN starts_with(x, 'gt') THEN '>' || x[3:] ELSE '©' || x[5:] END"
    " ELSE '&' || x END), '')"
)
SPACED = "trim(regexp_replace({0}, '[\\s\\x0B\\x1c-\\x1f\\x85\\pZ]+', ' ', 'g'))"
BARE = (
    "regexp_replace({0}, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<template\\b[^>]*>.*?</template\\s*>|<[^>]*>', ' ', 'g')"
)
#: References twice where markup is stripped: as markup, then as text.
CLEAN = SPACED.format(DECODED.format("CASE WHEN contains({0}, '<') AND contains({0}, '>') THEN " + DECODED.format(BARE) + " ELSE {0} END"))
MATCH = "trim(regexp_replace(lower(replace(coalesce({0}, ''), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g'))"
TECH = "trim(regexp_replace(lower(replace(coalesce({0}, ''), 'ß', 'ss')), '[^a-z0-9+#./]+', ' ', 'g'))"


REFERENCES = " Men&#8217;s caf&eacute; &#x2014; x&notin;y &amp;lt; &bogus; & a&b &copy2 &hellip;"


@query("p1_clean_text", f"WITH s AS (SELECT page_id, html || '{REFERENCES}' AS html, regexp_replace(html, '[<>]', '', 'g') || '{REFERENCES}' AS plain FROM pages) SELECT page_id, {CLEAN.format('html')} AS clean, {CLEAN.format('plain')} AS plain FROM s")
def p1(t: Tables) -> DataFrame:
    pages = t.pages.select("page_id", F.concat("html", F.lit(REFERENCES)).alias("html"), F.concat(F.regexp_replace("html", "[<>]", ""), F.lit(REFERENCES)).alias("plain"))
    return pages.select("page_id", T.clean_text(F.col("html")).alias("clean"), T.clean_text(F.col("plain")).alias("plain"))


@query(
    "p2_clean_nested",
    f"WITH s AS (SELECT page_id, replace(replace(replace(html || '{REFERENCES}', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM pages), d AS (SELECT page_id, {DECODED.format('html')} AS html FROM s),"
    f" e AS (SELECT page_id, {DECODED.format('html')} AS html FROM d) SELECT page_id, {CLEAN.format('html')} AS clean FROM e",
)
def p2(t: Tables) -> DataFrame:
    escaped = F.concat("html", F.lit(REFERENCES))
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(char), F.lit(name))
    return t.pages.select("page_id", T.clean_nested(escaped).alias("clean"))


@query("p3_match_text", f"SELECT doc_id, {MATCH.format('text')} AS form FROM documents")
def p3(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.match_text(F.col("text")).alias("form"))


@query("p4_compact_text", "SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '', 'g') AS form FROM documents")
def p4(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.compact_text("text").alias("form"))


@query("p5_tech_text", f"SELECT doc_id, {TECH.format('text')} AS form FROM documents")
def p5(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.tech_text(F.col("text")).alias("form"))


@query("p6_slugify", f"SELECT p_partkey, coalesce(nullif(replace({MATCH.format('p_name')}, ' ', '-'), ''), 'job') AS slug FROM part")
def p6(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.slugify(F.col("p_name")).alias("slug"))


@query(
    "p7_title_from_slug",
    """SELECT p_partkey, array_to_string(list_transform(string_split(replace(p_name, ' ', '-'), '-'),
    lambda w: CASE WHEN w IN ('ai', 'bi', 'ds', 'epm', 'ii', 'iii', 'iv', 'ml', 'nlp', 'sql') THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ') AS title FROM part""",
)
def p7(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.title_from_slug(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("title"))


@query(
    "p8_cut_at_marker",
    """SELECT doc_id, regexp_replace(substr(text, 1, least(
      coalesce(CASE WHEN instr(lower(text), '.') > 1 THEN instr(lower(text), '.') END, 2147483647),
      coalesce(CASE WHEN instr(lower(text), ' and ') > 1 THEN instr(lower(text), ' and ') END, 2147483647),
      coalesce(CASE WHEN instr(lower(text), ' | ') > 1 THEN instr(lower(text), ' | ') END, 2147483647)) - 1), '[ \\-–—,|]+$', '') AS title FROM documents""",
)
def p8(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.cut_at_marker(F.col("text"), (".", " and ", " | ")).alias("title"))


@query("p9_labelled", "SELECT event_id, trim(regexp_extract(coalesce(props, ''), '\"k\":\\s*([0-9]+)', 1)) AS field FROM events")
def p9(t: Tables) -> DataFrame:
    return t.events.select("event_id", T.labelled(F.col("props"), r'"k":\s*([0-9]+)').alias("field"))


@query("p10_strip_age", "SELECT p_partkey, trim(p_name) AS name FROM part")
def p10(t: Tables) -> DataFrame:
    aged = F.concat("p_name", F.lit("  "), F.col("p_size").cast("string"), F.lit(" days ago"))
    return t.part.select("p_partkey", T.strip_age(aged).alias("name"))


@query(
    "p11_joined",
    "SELECT p_partkey, array_to_string(list_filter([p_name, CASE WHEN p_size > 25 THEN '' ELSE p_brand END, p_type], lambda x: x <> ''), ' | ') AS label FROM part",
)
def p11(t: Tables) -> DataFrame:
    brand = F.when(F.col("p_size") > 25, "").otherwise(F.col("p_brand"))
    return t.part.select("p_partkey", T.joined(" | ", F.col("p_name"), brand, F.col("p_type"), F.col("p_name"), distinct=True).alias("label"))


@query(
    "p12_experience_text",
    """SELECT p_partkey, CASE WHEN a IS NULL AND b IS NULL THEN '' ELSE 'Experience required: ' || coalesce(a, b) || ' to ' || coalesce(b, a) || ' years.' END AS line
    FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS a, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_size + 2 END AS b FROM part)""",
)
def p12(t: Tables) -> DataFrame:
    low = F.when(F.col("p_size") % 3 != 0, F.col("p_size"))
    high = F.when(F.col("p_size") % 2 != 0, F.col("p_size") + 2)
    return t.part.select("p_partkey", T.experience_text(low, high).alias("line"))


@query("p13_pay_text", "SELECT p_partkey, CASE WHEN p_size > 40 THEN '' ELSE 'INR ' || p_size || '-' || (p_size + 5) || ' per annum' END AS pay FROM part")
def p13(t: Tables) -> DataFrame:
    low = F.when(F.col("p_size") <= 40, F.col("p_size"))
    return t.part.select("p_partkey", T.pay_text(F.lit("INR"), low, low + 5).alias("pay"))


@query("p14_first_truthy", "SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, '([0-9]+)', 1)), ''), nullif(trim(source), ''), '') AS field FROM documents")
def p14(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.first_truthy(F.regexp_extract("text", "([0-9]+)", 1), F.col("source")).alias("field"))


@query("p15_build_url", "SELECT doc_id, 'https://example.org/' || source || '/jobs/' || doc_id || '?state=' || base64(encode('{\"id\":' || doc_id || '}')) AS url FROM documents")
def p15(t: Tables) -> DataFrame:
    state = U.encoded_state(F.struct(F.col("doc_id").alias("id")))
    return t.documents.select("doc_id", U.build_url("https://example.org/", [F.col("source"), F.lit("jobs"), F.col("doc_id")], {"state": state}).alias("url"))


@query(
    "p16_remote_label",
    "SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN CASE WHEN s_nationkey > 12 THEN 'Remote • ' || s_name ELSE 'Remote' END ELSE CASE WHEN s_nationkey > 12 THEN s_name ELSE '' END END AS place FROM supplier",
)
def p16(t: Tables) -> DataFrame:
    place = F.when(F.col("s_nationkey") > 12, F.col("s_name"))
    return t.supplier.select("s_suppkey", T.remote_label(F.col("s_acctbal") > 5000, place).alias("place"))


@query(
    "p17_multi_location",
    "SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN s_name || ' (multi-location)' WHEN s_nationkey % 3 = 0 THEN 'New Town' ELSE s_name END AS place FROM supplier",
)
def p17(t: Tables) -> DataFrame:
    n = F.col("s_nationkey")
    label = F.when(n % 2 == 0, F.concat(n.cast("string"), F.lit(" Locations"))).when(n % 3 == 0, "").otherwise(F.col("s_name"))
    return t.supplier.select("s_suppkey", T.multi_location(label, F.col("s_name"), F.lit("/x/job/new-town/12")).alias("place"))


@query(
    "p18_generic_title",
    """WITH s AS (SELECT page_id, regexp_extract(html, '<a[^>]*>([^<]*)</a>', 1) AS a, ['', 'Careers at ', ' - ', 'Apply at ', 'Know  more'][page_id % 5 + 1] AS b FROM pages),
    f AS (SELECT page_id, trim(lower(trim(regexp_replace(CASE WHEN page_id % 5 = 4 THEN b ELSE b || a END, '\\s+', ' ', 'g'))), ' -|:') AS t, lower(CASE WHEN page_id % 3 = 0 THEN a ELSE 'The' END) AS c FROM s)
    SELECT page_id, t = '' OR t IN ('apply', 'apply now', 'details', 'know more', 'view', 'view role', 'view job', 'read more', 'learn more', 'open role', 'careers', 'jobs')
      OR starts_with(t, 'apply at ') OR starts_with(t, 'opportunities await you at ') OR t = c OR t = 'careers at ' || c AS generic FROM f""",
)
def p18(t: Tables) -> DataFrame:
    link, k = F.regexp_extract("html", "<a[^>]*>([^<]*)</a>", 1), F.col("page_id")
    before = F.get(F.array(*map(F.lit, ("", "Careers at ", " - ", "Apply at ", "Know  more"))), (k % 5).cast("int"))
    title = F.when(k % 5 == 4, before).otherwise(F.concat(before, link))
    return t.pages.select("page_id", T.is_generic_title(title, F.when(k % 3 == 0, link).otherwise("The")).alias("generic"))
