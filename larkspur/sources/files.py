"""Line files, registries, states and part files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str, named: bool = True, strict: bool = True) -> DataFrame:
    """(name, url) of lines `Name|URL` or `Name: URL`, or (name) of one name per line; blank lines and # comments are skipped.

    A line without its URL raises when it is read, or with strict off is left out.
    """
    text = spark.read.text(path).select(F.trim("value").alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    if not named:
        return text.select(F.col("line").alias("name"))
    pattern = r"^([^|]+?)\s*(?:\||:\s)\s*(https?://\S+)$"
    rows = text.select("line", F.trim(F.regexp_extract("line", pattern, 1)).alias("name"), F.regexp_extract("line", pattern, 2).alias("url"))
    if not strict:
        return rows.where("url <> ''").drop("line")
    return rows.select("name", F.when(F.col("url") != "", F.col("url")).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), F.col("line")))).alias("url"))


def registry(spark: SparkSession, path: str, schema: str, rows: str = "companies") -> DataFrame:
    """Rows of a registry document."""
    return spark.read.schema(f"{rows} array<struct<{schema}>>").json(path, multiLine=True).select(F.inline(rows))


def latest_version(spark: SparkSession, folder: str) -> str | None:
    """The newest complete version that sinks.write_state has written below folder, read through Spark's file system; None without one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "version=*/_SUCCESS"))
    versions = sorted(f.getPath().getParent().toString() for f in found or [])
    return versions[-1] if versions else None


def state(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Keyed records: the newest version in a folder of states, or a file of JSON records. A missing path or unreadable records give an
    empty state, or raise if strict."""
    from pyspark.errors import AnalysisException

    version = latest_version(spark, path)
    if version is not None:
        return spark.read.schema(schema).option("ignoreCorruptFiles", not strict).parquet(version)
    reader = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "FAILFAST" if strict else "PERMISSIVE")
    try:
        found = reader.json(path)
    except AnalysisException:
        if strict:
            raise
        return spark.createDataFrame([], schema)
    return found.where("_corrupt is null").drop("_corrupt")


def parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results of all files part-*.json below path, with the index of their batch."""
    reader = spark.read.schema(f"batch_index int, results array<struct<{schema}>>")
    found = reader.json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter="part-*.json")
    return found.select("batch_index", F.inline_outer("results"))
