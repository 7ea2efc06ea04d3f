"""Seen-state, registry documents, summaries, alert records and run lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.values import pay_label


def write_state(state: DataFrame, folder: str, version: int, key: str = "state_key") -> str:
    """The whole state, ordered by key, as a new version of the folder; a reader never sees half of one."""
    path = f"{folder}/version={version:08d}"
    state.orderBy(key).write.mode("errorifexists").parquet(path)
    return path


def write_registry(rows: DataFrame, path: str, note: str, as_of: Column, name: str = "name") -> None:
    """Rows in order of the lower-cased name, and one metadata row with the time, the counts and a note."""
    rows.orderBy(F.lower(name)).write.mode("overwrite").json(f"{path}/rows")
    rows.agg(as_of.alias("generated_at"), F.count("*").alias("total"), F.lit(note).alias("note")).write.mode("overwrite").json(f"{path}/metadata")


def summary(df: DataFrame, status: str, name: str, working: str = "WORKING") -> DataFrame:
    """(status, n, name): the count of each status with each name of what doesn't work as a row, so that a status with many names
    is spread out; one row without a name where all work."""
    counts = df.groupBy(status).agg(F.count("*").alias("n"))
    names = df.where(F.col(status) != working).select(status, name).distinct()
    return counts.join(names.hint("merge"), status, "left")


def alert_records(df: DataFrame) -> DataFrame:
    """(key, payload): what a delivery sends, as JSON, with its texts cut to the receiver's limits."""
    short = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n)
    fields = F.struct(
        short("title", 250).alias("title"), short("company", 250).alias("company"), short("location", 1000).alias("location"),
        F.concat(F.col("score").cast("string"), F.lit("/100")).alias("score"), F.array_join(F.slice("reasons", 1, 5), "\n").alias("reasons"),
        pay_label(F.col("title"), F.col("description")).alias("pay"), F.nullif(F.col("requisition_id"), F.lit("")).alias("job_id"),
    )
    return df.select("key", F.to_json(fields).alias("payload"))


def run_line(results: DataFrame, label: str, rows: str, error: str) -> DataFrame:
    """One row on a run: sources, labels, completed, empty and failed ones."""
    return results.agg(F.count_distinct(label).alias("labels"), *run_counts(rows, error)).select("configured", "labels", "completed", "zero", "failed")


def run_counts(rows: str, error: str) -> list[Column]:
    none = F.col(error).isNull()
    return [
        F.count(F.lit(1)).alias("configured"), F.count_if(none).alias("completed"),
        F.count_if(none & (F.col(rows) == 0)).alias("zero"), F.count_if(~none).alias("failed"),
    ]


RUN_SCHEMA = "run string, configured long, completed long, zero long, failed long"


def record_run(results: DataFrame, path: str, runs: str, run: str, rows: str, error: str) -> dict[str, int]:
    """Writes a run's results to path and adds its line to the table of runs: the counts are observed while the rows are written, in one pass.

    A run that is repeated replaces its results and its line.
    """
    seen = Observation()
    results.observe(seen, *run_counts(rows, error)).write.mode("overwrite").parquet(path)
    counts = dict(seen.get)
    line = results.sparkSession.createDataFrame([(run, *(counts[c] for c in ("configured", "completed", "zero", "failed")))], RUN_SCHEMA)
    line.write.mode("overwrite").parquet(f"{runs}/line={run}")
    return counts


def run_table(spark: SparkSession, runs: str) -> DataFrame:
    """The lines of all recorded runs."""
    return spark.read.schema(RUN_SCHEMA).parquet(f"{runs}/line=*")
