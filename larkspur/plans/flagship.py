"""The flagship plan: pages as postings, scored by a weighted term list, one per title, ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import clean_text, hits, match_text
from larkspur.functions.urls import canonical_url
from larkspur.operators.relational import first_per_key
from larkspur.operators.scoring import once
from larkspur.plans.base import Tables, query
from larkspur.plans.links import CANONICAL
from larkspur.plans.text import CLEAN, MATCH

TERMS = ("the", "and", "of", "de", "la", "der", "que", "with", "pour", "und")
LIMIT, LEAST = 50, 20


def scored_pages(pages: DataFrame) -> DataFrame:
    title = clean_text(F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1))
    found = pages.select("page_id", canonical_url(F.col("url"), False).alias("url"), title.alias("title"), clean_text(F.col("html")).alias("body"))
    n = F.size(hits(match_text(F.col("body")), TERMS, phrase=True))
    score = F.least(5 * n, F.lit(40)) + F.when(F.length("body") > 2000, 20).otherwise(0)
    return once(once(found).select("page_id", "url", "title", score.alias("score")))


def ranked_pages(spark: SparkSession, sf_dir: str, least: int = LEAST, limit: int = LIMIT) -> DataFrame:
    kept = scored_pages(Tables(spark, sf_dir).pages).where(F.col("score") >= least).withColumn("fingerprint", match_text(F.col("title")))
    return first_per_key(kept, ["fingerprint"], ["page_id"]).orderBy(F.desc("score"), "page_id").limit(limit).select("page_id", "url", "title", "score")


@query(
    "q0_flagship",
    f"""WITH {CANONICAL}, b AS (SELECT page_id, loose AS url, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h, {CLEAN.format('html')} AS body FROM c),
    m AS (SELECT *, {CLEAN.format('h')} AS title, ' ' || {MATCH.format('body')} || ' ' AS form FROM b),
    s AS (SELECT page_id, url, title, (least(5 * len(list_filter(['the', 'and', 'of', 'de', 'la', 'der', 'que', 'with', 'pour', 'und'], lambda x: contains(form, ' ' || x || ' '))), 40) + CASE WHEN length(body) > 2000 THEN 20 ELSE 0 END)::INT AS score FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY {MATCH.format('title')} ORDER BY page_id) AS n FROM s WHERE score >= {LEAST})
    SELECT page_id, url, title, score FROM r WHERE n = 1 ORDER BY score DESC, page_id LIMIT {LIMIT}""",
)
def flagship(t: Tables) -> DataFrame:
    return ranked_pages(t.spark, t.sf_dir)
