"""Counts and lists that a run reports: by status, by name, by page, and what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def status_counts(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def effective_counts(df: DataFrame, status: Column, resolved: Column, promotable: Column) -> DataFrame:
    """(effective, n, promotable): counts by the resolved status where there is one, else the status; `promotable` is a condition on
    rows, in which the column `effective` can be used."""
    rows = df.withColumn("effective", F.coalesce(resolved, status))
    return rows.groupBy("effective").agg(F.count("*").alias("n"), F.count_if(promotable).alias("promotable"))


def conditional_counts(df: DataFrame, status: str, names: dict[str, str], failing: str = "failed") -> DataFrame:
    """One row with the count of each status under its name, and whether any is counted under the name `failing`."""
    count = {name: F.count_if(F.col(status) == value) for name, value in names.items()}
    return df.agg(*(c.alias(name) for name, c in count.items()), (count[failing] > 0).alias("failing"))


def coverage_summary(df: DataFrame, label: str, enabled: Column, nonempty: Column, failed: Column) -> DataFrame:
    """One row on sources: how many there are, are enabled, have rows and failed, and their labels."""
    return df.agg(
        F.count("*").alias("configured"), F.count_if(enabled).alias("enabled"), F.count_distinct(label).alias("labels"),
        F.count_if(nonempty).alias("nonempty"), F.count_if(failed).alias("failed"),
    )


def duplicates(df: DataFrame, form: Column, name: str = "name") -> DataFrame:
    """(name, n): forms that several rows have."""
    return df.groupBy(form.alias(name)).agg(F.count("*").alias("n")).where("n > 1")


def link_counts(pages: DataFrame, key: str, target: str, html: str = "html", most: int = 10) -> DataFrame:
    """(key, links, targets): a page's distinct links and those that fit a pattern, `most` at most. Pages without links are left out."""
    links = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    fits = F.when(F.col("href").rlike(target), F.col("href"))
    return links.groupBy(key).agg(F.count_distinct("href").alias("links"), F.least(F.count_distinct(fits), F.lit(most)).alias("targets"))


def changes(runs: DataFrame, key: str, run: str, value: str) -> DataFrame:
    """runs with `changed`: whether a key's value differs from its run before; the first run is a change."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(run))
    first = F.row_number().over(W.partitionBy(key).orderBy(run)) == 1
    return runs.withColumn("changed", first | ~F.col(value).eqNullSafe(before))


def limit_per_group(df: DataFrame, group: str, order: list, most: int, name: str = "n") -> DataFrame:
    """The first `most` rows of each group with their place; ranks are limited within each task before a group's rows meet."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col(name) <= most)


def top_rows(df: DataFrame, order: list, most: int) -> DataFrame:
    """The first `most` rows with `remaining`: how many are left for later."""
    rest = df.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("remaining"))
    return df.orderBy(*order).limit(most).join(F.broadcast(rest), F.lit(True))  # one row


def fresh(df: DataFrame, time: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the last `days` days before a moment."""
    return df.where(F.col(time) >= as_of - F.make_interval(days=F.lit(days)))
