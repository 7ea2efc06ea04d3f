"""The corpus pipeline over `documents`: five stages, each one operator of `larkspur.llm`.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but
the last return the columns of `docs`. `run` writes each stage's result as Parquet into
the shared folder and rereads it for the next one. Models are fitted on the
labelled rows of the documents that reach the stage. Nulls, empty and repeated rows and
extra columns are treated as the operators say; a document with a null id stays a row of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, common, decontam, ngram_join, quality_rules, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the toxicity grammar scores 0.5 or more."""
    grammar = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return toxicity.score(row, grammar, keep=["row"]).where("predicted = 0").select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that fail the base rules or that the learned decision list rejects."""
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("text"))
    rules = quality_rules.fit(docs, common.table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(row, common.table(spark, sf_dir, "labels"), keep=["row"], rules=rules)
    return judged.where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates: the one with the smallest id. Documents
    without an id come after all others; of rows that repeat id and words the one with the least hash stays."""
    words = common.split_words(common.ascii_lower(F.col("text")))
    no_id = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62)
    named = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("doc_id", no_id).alias("key"), F.col("text"), ngram_join.copy_key(words).alias("copy"))
    classes = ngram_join.near_duplicates(named, doc_id="key", details=True)
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").alias("key"), "copy")).alias("first")).select("first.*")
    kept = named.drop("text").join(common.written(first, "first").hint("merge"), ["key", "copy"], "left_semi")
    return kept.groupBy("key", "copy").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents of whose words a twentieth or more lie in windows of the benchmark."""
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    found = decontam.find_contamination(row, common.table(spark, sf_dir, "benchmark"), keep=["row"])
    return found.where(~decontam.contaminated(F.col("n_hit"), F.col("n_words"))).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents: their number and the digests of the ids and of the decoded bytes."""
    ids = bpe.encode(docs, keep=["doc_id", "lang", "source"])
    return ids.select("doc_id", "lang", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", encoded),
]

#: The fitted stages can't be stated in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
