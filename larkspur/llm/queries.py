"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, common, decontam, fim, html_text, lm, merkle, ngram_join, quality_rules, sharding, token_counts, token_output, toxicity, url_filters


def fold(doc_id: str, folds: int) -> Column:
    """Which fold an id is in: the CRC32 of its text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge_urls(pages, keep=["page_id"])


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    vocabulary = lm.count(docs.where(~held_out))
    coded = lm.encode(docs.withColumn("held_out", held_out), vocabulary, keep=["doc_id", "held_out"])
    scored = lm.score_units(coded, lm.fit(coded.where("not row.held_out"), vocabulary))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = common.fresh_path(spark, "tokens")
    shards = token_output.write_tokens(docs, out)
    tokens = token_output.read_tokens(spark, out, shards)
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, common.table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge(docs, common.table(spark, sf_dir, "labels"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, keep=["doc_id"])


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, keep=["doc_id"])
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    sharded = sharding.assign(docs, 24, keep=["doc_id"])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = fim.fill_in_middle(docs, keep=["doc_id"])
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(fold("doc_id", 5) == 0, common.ascii_lower(F.col("text"))).otherwise(F.col("text"))
    return merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], presented={"text": tampered}, keep=["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id,
    lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')) AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN regexp_matches(host || path, '^([^/]*\.)?example\.net/en/') THEN 'example.net/en/'
    WHEN regexp_matches(host || path, '^([^/]*\.)?example\.com/de/') THEN 'example.com/de/'
    WHEN regexp_matches(host || path, '^([^/]*\.)?org/fr/') THEN 'org/fr/'
    WHEN regexp_matches(host || path, '^([^/]*\.)?net/') THEN 'net/' END AS rule,
    CASE
    WHEN regexp_matches(host || path, '^([^/]*[.-])?ads[.-]') THEN 'host:ads'
    WHEN regexp_matches(host || path, '^([^/]*[.-])?adserver[.-]') THEN 'host:adserver'
    WHEN regexp_matches(host || path, '^([^/]*[.-])?casino[.-]') THEN 'host:casino'
    WHEN regexp_matches(host || path, '^([^/]*[.-])?doubleclick[.-]') THEN 'host:doubleclick'
    WHEN regexp_matches(host || path, '^([^/]*[.-])?porn[.-]') THEN 'host:porn'
    WHEN regexp_matches(host || path, '^([^/]*\.)?spam-farm\.') THEN 'host:spam-farm'
    WHEN regexp_matches(host || path, '^([^/]*[.-])?tracker[.-]') THEN 'host:tracker'
    WHEN regexp_matches(host || path, '^([^/]*[.-])?xxx[.-]') THEN 'host:xxx'
    WHEN regexp_matches(host || path, '/cart([/.]|$)') THEN 'path:cart'
    WHEN regexp_matches(host || path, '/checkout([/.]|$)') THEN 'path:checkout'
    WHEN regexp_matches(host || path, '/login([/.]|$)') THEN 'path:login'
    WHEN regexp_matches(host || path, '/logout([/.]|$)') THEN 'path:logout'
    WHEN regexp_matches(host || path, '/signin([/.]|$)') THEN 'path:signin'
    WHEN regexp_matches(host || path, '/signup([/.]|$)') THEN 'path:signup' END AS pattern
  FROM parts)
SELECT page_id, host, path, rule, pattern,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT item_id, least(len(w), 13) AS k, unnest(list_transform(range(1, (len(w) - least(len(w), 13) + 2)::BIGINT), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS g
  FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, unnest(range(1, (len(w) - k + 2)::BIGINT)) AS p, w FROM d, ks WHERE len(w) >= k),
hits AS (
  SELECT DISTINCT dw.doc_id, dw.p, dw.k, bw.item_id FROM dw JOIN bw ON bw.k = dw.k AND bw.g = array_to_string(dw.w[dw.p:dw.p + dw.k - 1], ' ')),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT array_to_string(w, ' ') AS body, min(doc_id) AS copy_id, any_value(w) AS w FROM d GROUP BY 1),
p AS (SELECT copy_id, len(w) AS n, generate_subscripts(w, 1) AS p, unnest(w) AS x FROM c),
s AS (
  SELECT copy_id, n, p, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS x
  FROM p WINDOW o AS (PARTITION BY copy_id ORDER BY p)),
g AS (SELECT DISTINCT copy_id, x FROM s WHERE p <= greatest(n - 4, 1)),
e AS (SELECT copy_id, x, count(*) OVER (PARTITION BY copy_id) AS n FROM g),
pairs AS (SELECT a.copy_id AS a, b.copy_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b USING (x) WHERE a.copy_id <> b.copy_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 10 * k >= 8 * (na + nb - k)),
reach(a, b) AS (SELECT copy_id, copy_id FROM c UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
class AS (SELECT a AS copy_id, min(b) AS class_id FROM reach GROUP BY a),
n AS (SELECT a AS copy_id, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, class.class_id, c.copy_id, coalesce(n.n_links, 0)::BIGINT AS n_links
FROM d JOIN c ON c.body = array_to_string(d.w, ' ') JOIN class USING (copy_id) LEFT JOIN n USING (copy_id)
"""


#: crc(x): the unsigned CRC32 of a text's UTF-8 bytes, over a table of remainders that comes from the polynomial.
CRC_SQL = """b(n, c, i) AS (SELECT n, n, 0 FROM range(256) r(n) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i + 1 FROM b WHERE i < 8),
t AS (SELECT list(c ORDER BY n) AS t FROM b WHERE i = 8)"""


def crc_sql(text: str) -> str:
    step = "xor(a >> 8, t[(xor(a, x) & 255) + 1])"
    return f"xor(list_reduce(list_transform(regexp_extract_all(hex({text}), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, x: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


#: The heap step by step: each group to the shard of the least load; of groups of equal size the first ones by digest go to the first shards.
OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL},
d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 8 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32, sha256(coalesce(text, '')) AS key FROM documents, t),
s AS (SELECT key, sum(size)::BIGINT AS load FROM d GROUP BY 1),
g AS (SELECT key, (load >> greatest(length(bin(load)) - 15, 0)) << greatest(length(bin(load)) - 15, 0) AS load FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY load DESC, key) AS i, row_number() OVER (PARTITION BY load ORDER BY key) AS place FROM g),
h(i, load, shard, loads) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, list_transform(range(24), lambda x: 0::BIGINT)
  UNION ALL SELECT o.i, o.load, list_position(h.loads, list_min(h.loads)), list_transform(h.loads, lambda x, j: CASE WHEN j = list_position(h.loads, list_min(h.loads)) THEN x + o.load ELSE x END)
  FROM h JOIN o ON o.i = h.i + 1),
c AS (SELECT load, shard, count(*) AS n FROM h WHERE i > 0 GROUP BY ALL),
n AS (SELECT *, sum(n) OVER (PARTITION BY load ORDER BY shard) AS upto FROM c),
p AS (SELECT key, shard - 1 AS shard FROM o JOIN n ON n.load = o.load AND place <= upto AND place > upto - n)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, key) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN p USING (key)
"""

OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS e FROM d),
f AS (SELECT *, CASE WHEN n = 0 OR regexp_matches(x, '<[PSM]>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form,
  substr(x, 1, least(a, b)) AS p, substr(x, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m, substr(x, greatest(a, b) + 1) AS s FROM k),
o AS (SELECT *, CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS y FROM f),
r AS (SELECT *, string_split_regex(y, '<[PSM]>') AS l FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars, sha256(y) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN y WHEN 'psm' THEN l[2] || l[4] || l[3] ELSE l[3] || l[4] || l[2] END) AS restored_sha256
FROM r
"""


def leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: All levels of all trees as one table of nodes; a row's path meets its run at each level. Level 100 and above is the tree of sources.
OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL},
d AS (SELECT *, {leaf_sql("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc_sql("doc_id::VARCHAR")} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS shown_text FROM documents, t),
l AS (SELECT doc_id, leaf, {leaf_sql("shown_text")} AS shown, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
n1(tree, k, i, h) AS (SELECT tree, 0, i, leaf FROM l UNION ALL SELECT tree, k + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM n1) WHERE n > 1 GROUP BY tree, k, i // 16),
tops AS (SELECT tree, max(k) AS k, max_by(h, k) AS subroot FROM n1 GROUP BY 1),
n2(k, i, h) AS (SELECT 0, tree, subroot FROM tops UNION ALL SELECT k + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM n2) WHERE n > 1 GROUP BY k, i // 16),
root AS (SELECT max(k) AS k, max_by(h, k) AS root FROM n2),
nodes AS (SELECT n1.tree, n1.k, i, h, n1.k = tops.k AS last FROM n1 JOIN tops USING (tree) UNION ALL SELECT -1, k, i, h, k = (SELECT k FROM root) FROM n2),
runs AS (
  SELECT tree, k, i, last, string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
  FROM nodes WINDOW w AS (PARTITION BY tree, k, i // 16 ORDER BY i)),
paths(tree, start, up, k, i, folded, proof) AS (
  SELECT tree, i, tree, 0, i, shown, '' FROM l
  UNION ALL
  SELECT p.tree, p.start, CASE WHEN b.last THEN -1 ELSE p.up END, CASE WHEN b.last THEN 0 ELSE p.k + 1 END, CASE WHEN b.last THEN p.tree ELSE p.i // 16 END,
    CASE WHEN b.last THEN p.folded ELSE sha256(coalesce(b.before, '') || p.folded || coalesce(b.after, '')) END, CASE WHEN b.last THEN p.proof ELSE p.proof || coalesce(b.before, '') || coalesce(b.after, '') END
  FROM paths p JOIN runs b ON b.tree = p.up AND b.k = p.k AND b.i = p.i WHERE NOT (b.last AND p.up = -1)),
ends AS (SELECT tree, start, folded, proof FROM paths WHERE up = -1 AND k = (SELECT k FROM root))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM l JOIN tops USING (tree) JOIN ends ON ends.tree = l.tree AND ends.start = l.i, root
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op5_decontamination": OP5_SQL, "op6_ngram_join": OP6_SQL, "op11_sharding": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
