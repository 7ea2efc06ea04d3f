"""Shared helpers: table access, shared scratch folder, row identity, word columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: White space of the word contracts: space, tab, line feed, vertical tab, form feed, return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: What lies between the words of the decontamination contract.
NON_WORD_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new temporary folder in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("larkspur.shared.dir", None)
    if root is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("larkspur.shared.dir", root)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch of long texts takes in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def with_outputs(df: DataFrame, text: str, keep: list[str] | None, outputs: dict[str, T.DataType], compute: Callable[[], Callable[[list], dict[str, list]]]) -> DataFrame:
    """df's columns `keep` (all by default, but for those named like an output) with columns computed from its texts.

    `compute()` is called once in a task and gives a function from the texts of a batch (nulls
    as None) to the outputs. Kept columns pass through as Arrow arrays, untouched.
    """
    kept = [c for c in (keep if keep is not None else df.columns) if c not in outputs]
    taken = df.select(*kept, F.col(text).alias("__text"))
    fields = [f for f in taken.schema.fields if f.name != "__text"]
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in outputs.items())])
    arrow = {n: to_arrow_type(t) for n, t in outputs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compute()
        for batch in batches:
            found = made(batch.column(len(kept)).to_pylist())
            columns = [batch.column(i) for i in range(len(kept))] + [pa.array(found[n], t) for n, t in arrow.items()]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    modest_batches(df.sparkSession)
    return taken.mapInArrow(run, schema)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def split_words(c: Column, between: str = SPACE_CLASS) -> Column:
    """Non-empty words of a text column; null has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), between), lambda w: w != "")


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A key of each row, so that repeated rows stay apart.

    The ids depend on the partitioning; they hold within one job over files.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def settled(df: DataFrame) -> DataFrame:
    """df behind a one-row generator, which the optimiser moves no expression across.

    Without it a later filter or projection may be merged into expressions with lambdas, and an
    array that is made once would be made for each element.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df as a written table with `name`: the place (from 0) of each row in the given order.

    Rows are dealt by ranges of the order and of a row id, so equal rows don't meet in one task, and sorted
    within each range; the place is the row's number in its file behind the rows of the ranges before. Only the ranges'
    row counts go to the driver.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "placed")
    rows = df.withColumn("__id", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order, F.col("__id")).sortWithinPartitions(*order, "__id").drop("__id").withColumn("__part", F.spark_partition_id())
    rows.write.option("maxRecordsPerFile", 0).parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    starts, before = [], 0
    for part, n in sorted(tuple(r) for r in stored.groupBy("__part").count().collect()):
        starts.append((part, before))
        before += n
    first = F.broadcast(spark.createDataFrame(starts, "__part int, __first long"))  # a row for each range
    numbered = stored.select("*", F.col("_metadata.row_index").alias("__row")).join(first, "__part")
    return numbered.withColumn(name, F.col("__first") + F.col("__row")).drop("__part", "__first", "__row")
