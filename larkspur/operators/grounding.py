"""Checks of proposed texts against their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import has_phrase, let, tech_text
from larkspur.functions.values import numbers_in, signature, token_set

# What a grounded text may not hold, terms that need evidence, terms of gap reports.
PLACEHOLDERS = ("[company]", "[role]", "[job id]", "<company>", "<role>", "tbd", "todo", "lorem ipsum")
TECH_TERMS = (
    "airflow", "aws", "azure", "bigquery", "c++", "databricks", "dbt", "docker", "gcp", "git", "github", "groovy", "hadoop", "jenkins",
    "jfrog", "kafka", "keras", "kubernetes", "langchain", "linux", "llm", "looker", "matplotlib", "mlflow", "mongodb", "mysql", "nlp",
    "numpy", "oracle", "pandas", "podman", "postgresql", "power bi", "pytorch", "rag", "redshift", "scikit-learn", "seaborn",
    "snowflake", "spark", "sql", "tableau", "tensorflow", "terraform", "vector database",
)
GAP_TERMS = (
    "AWS", "Azure", "GCP", "Kubernetes", "Terraform", "Spark", "Airflow", "Kafka", "Databricks", "Snowflake", "dbt", "Tableau", "Looker",
    "PyTorch", "TensorFlow", "LLM", "RAG", "NLP", "MLflow",
)


def contains_phrase(haystack: Column, needle: Column) -> Column:
    return has_phrase(tech_text(haystack), tech_text(needle))


def evidence_valid(evidence: Column, source: Column) -> Column:
    """Quotes are given, each of four characters or more and found in the source."""
    found = let(tech_text(source), lambda s: F.forall(evidence, lambda q: (F.length(F.trim(q)) >= 4) & F.contains(s, tech_text(q))))
    return F.coalesce((F.size(evidence) > 0) & found, F.lit(False))


def rejection(text: Column, evidence: Column, source: Column, max_length: Column | int, terms: tuple[str, ...] = TECH_TERMS, placeholders: tuple[str, ...] = PLACEHOLDERS, novel: float = 0.35) -> Column:
    """Why a claim isn't grounded, in the order of the checks; null if it is."""
    max_length = F.lit(max_length) if isinstance(max_length, int) else max_length
    quoted = F.array_join(evidence, " ")
    listed = F.array(*(F.lit(t) for t in terms))
    foreign = let(
        F.struct(tech_text(text).alias("t"), tech_text(quoted).alias("q")),
        lambda f: F.exists(listed, lambda t: has_phrase(f["t"], tech_text(t)) & ~has_phrase(f["q"], tech_text(t))),
    )
    ratio = let(token_set(text), lambda t: F.when(F.size(t) > 0, F.size(F.array_except(t, token_set(quoted))) / F.size(t)).otherwise(0.0))
    return (
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty")
        .when(F.length(text) > max_length, "too long")
        .when(F.exists(F.array(*map(F.lit, placeholders)), lambda p: F.contains(F.lower(text), p)), "placeholder")
        .when(text.rlike("[​‌‍]"), "hidden character")
        .when(~evidence_valid(evidence, source), "invalid evidence")
        .when(F.size(F.array_except(numbers_in(text), numbers_in(quoted))) > 0, "unsupported number")
        .when(foreign, "unsupported term")
        .when(ratio > novel, "too many new words")
    )


def skills_in(skills: Column, posting: Column) -> Column:
    """The skills that a posting names: as a phrase, or by one of their words of three letters or more."""
    words = lambda s: F.filter(F.split(tech_text(s), " "), lambda w: F.length(w) >= 3)
    return let(tech_text(posting), lambda p: F.filter(skills, lambda s: has_phrase(p, tech_text(s)) | F.exists(words(s), lambda w: has_phrase(p, w))))


def gaps(posting: Column, source: Column, terms: tuple[str, ...] = GAP_TERMS, most: int = 5) -> Column:
    """The first terms that the posting has and the source lacks."""
    both = F.struct(tech_text(posting).alias("p"), tech_text(source).alias("s"))
    listed = F.array(*map(F.lit, terms))
    return F.slice(let(both, lambda f: F.filter(listed, lambda t: has_phrase(f["p"], tech_text(t)) & ~has_phrase(f["s"], tech_text(t)))), 1, most)


def proposal_reason(index: Column, size: Column, repeat: Column, grounded: Column, text: Column, original: Column) -> Column:
    """Why a proposed edit is refused; null if it isn't. `repeat` counts the earlier proposals of the index."""
    return (
        F.when(index.isNull(), "malformed").when((index < 0) | (index >= size), "out of range").when(repeat > 0, "duplicate index")
        .when(~grounded, "ungrounded").when(signature(text) == signature(original), "unchanged")
    )


def valid_permutation(values: Column, size: Column) -> Column:
    """values if it permutes 0 to size - 1, else those in order."""
    identity = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.array_sort(values) == identity, values).otherwise(identity)


def surfaced(before: Column, after: Column) -> Column:
    """Keywords that are new after an edit."""
    return let(F.transform(before, tech_text), lambda b: F.filter(after, lambda k: ~F.array_contains(b, tech_text(k))))


def improvement_reason(summary_changed: Column, new_keywords: Column, available: Column, rewritten: Column) -> Column:
    """Why an edit improves nothing; null if it does."""
    return (
        F.when(~summary_changed, "no substantive summary change")
        .when(new_keywords < F.least(F.lit(2), available), "not enough supported skills surfaced")
        .when(rewritten < 1, "nothing rewritten")
    )


def change_labels(summary: Column, skills: Column, rewritten: Column, reordered: Column, what: str = "items") -> Column:
    """What an edit changed, as labels in order."""
    count = F.concat(F.lit(f"{what} rewritten ("), rewritten.cast("string"), F.lit(")"))
    return F.array_compact(
        F.array(F.when(summary, "summary rewritten"), F.when(skills, "skills prioritized"), F.when(rewritten > 0, count).when(reordered, f"{what} reordered"))
    )


def skill_catalog(lines: Column) -> Column:
    """Skills of lines `Label: a, b, c`, each once by its normal form, in order."""
    parts = F.flatten(F.transform(lines, lambda x: F.split(F.substring_index(x, ":", -1), ",")))
    trimmed = F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")
    return let(F.struct(trimmed.alias("t"), F.transform(trimmed, tech_text).alias("f")), lambda r: F.filter(r["t"], lambda s, i: F.array_position(r["f"], tech_text(s)) == i + 1))


def check_claims(claims: DataFrame, sources: DataFrame, max_length: int = 400) -> DataFrame:
    """claims(doc_id, text, evidence, …) with `reject_reason` by sources(doc_id, idx, text), whose parts are joined in order."""
    whole = sources.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda p: p["text"]), "\n").alias("__source"))
    joined = claims.join(whole, "doc_id", "left")
    reason = rejection(F.col("text"), F.col("evidence"), F.coalesce("__source", F.lit("")), max_length)
    return joined.withColumn("reject_reason", reason).drop("__source")
