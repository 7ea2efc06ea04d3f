"""Incremental runs: landed payloads to alerts once ever, health notices, reconciled states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from larkspur.operators.relational import greedy_dedupe, stored
from larkspur.operators.state import BucketState, anti_join_seen


def posting_stream(spark: SparkSession, path: str, schema: str, transform: Callable[[DataFrame], DataFrame], max_files: int = 1000) -> DataFrame:
    """A stream of the payload files that land in path, each batch of at most max_files put through transform."""
    return transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path))


class Batches:
    """Rows by micro-batch, one folder each, in a shared folder; a batch that is run again overwrites its own."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def read(self, batch: int) -> DataFrame:
        """The rows of one batch; none if it wrote no folder."""
        path = f"{self.path}/batch={batch}"
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not files.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(path)

    def write(self, rows: DataFrame, batch: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return self.read(batch)

    def remove(self, batch: int, part: str) -> None:
        """Removes a part (`column=value`) of a batch that no later one reads."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={batch}/{part}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_rows(batch: DataFrame, seen: DataFrame, keys: str, order: str) -> DataFrame:
    """Rows none of whose keys was delivered, each key once within the batch."""
    return greedy_dedupe(anti_join_seen(batch, seen, keys, order), keys, order)


def with_runs(stream: DataFrame, runs: DataFrame, *keep: str) -> DataFrame:
    """The stream with a row, marked `__run`, for each row of another one, of which it has the columns `keep`: a scheduled run then makes a batch even if nothing landed."""
    return stream.withColumn("__run", F.lit(False)).unionByName(runs.select(*keep, F.lit(True).alias("__run")), allowMissingColumns=True)


def alert_once(
    stream: DataFrame, seen_path: str, out_path: str, checkpoint: str, keys: str, order: str, top: int | None = None, rank: list | None = None,
    runs: DataFrame | None = None, buckets: int = 64,
) -> StreamingQuery:
    """Writes each batch's new rows to out_path and their keys to the seen table, of which a batch reads and rewrites the buckets of
    its own keys alone. New rows beyond the first `top` wait in a table beside it and are taken up by the next batch: with
    `runs`, a stream with a row for each scheduled run, also if no payload has landed since.

    A batch that is run again doesn't see what it wrote and overwrites it, so a failure between the writes loses and doubles nothing.
    """
    if runs is not None:
        stream = with_runs(stream, runs)

    def deliver(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if runs is not None:
            batch = batch.where("not __run").drop("__run")
        seen = BucketState(spark, seen_path, "key string, batch long", "key", buckets)
        sent, waiting = Batches(spark, out_path, batch.schema.toDDL()), Batches(spark, f"{seen_path}-waiting", batch.schema.toDDL())
        both = stored(batch.unionByName(waiting.read(number - 1)).dropDuplicates([order]))  # a row that waits may land again
        known = seen.read(seen.touched(both.select(F.explode(keys).alias("key")))).where(F.col("batch") < number)
        rows = new_rows(both, known, keys, order)
        if top is not None:
            delivered = sent.write(rows.orderBy(*(rank or [order])).limit(top), number)
            waiting.write(rows.join(delivered.select(order).hint("merge"), order, "left_anti").select(batch.columns), number)
        else:
            delivered = sent.write(rows, number)
        seen.upsert(delivered.select(F.explode(keys).alias("key")).where("key is not null").distinct().withColumn("batch", F.lit(number).cast("long")), prefer="old")

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_alerts(stream: DataFrame, key: str) -> DataFrame:
    """The rows of a stream whose key came first, for alerts with one key: the keys are streaming state that never expires."""
    return stream.dropDuplicates([key])


def recent_alerts(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The rows of a stream whose key didn't come within `delay` before, by event time. The state is bounded: rows later than the watermark
    are left out, and a key alerts again once its last alert is older than the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def deliver_by_runs(stream: DataFrame, runs: DataFrame, key: str, rank: list[str], top: int, path: str, checkpoint: str, time: str = "run") -> StreamingQuery:
    """`carry_over` for many keys, as tables: each batch is a run, named by the latest `time` of the rows that landed and of `runs`. It delivers at most
    `top` of each key's new and waiting rows, in ascending order of rank (nulls first); the rest waits for the next one. `delivered` reads the result.

    A run is one window over the rows that are left, written once, so it costs the same for few keys and for many; a key's rows are sorted
    in one task and may spill. Rows without a key are those of one key; the stream has no columns `batch` and `sent`. A batch that is run again overwrites its own folder; rows that wait are kept of the last two.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        now = F.timestamp_micros(F.lit(batch.agg(F.unix_micros(F.max(time))).first()[0]))
        landed = batch.where("not __run").drop("__run", time)
        batches = Batches(batch.sparkSession, path, f"{landed.schema.toDDL()}, {time} timestamp, sent boolean")
        both = landed.unionByName(batches.read(number - 1).where("not sent").drop(time, "sent"))
        place = F.row_number().over(W.partitionBy(key).orderBy(*rank))
        both.select("*", now.alias(time), (place <= top).alias("sent")).write.mode("overwrite").partitionBy("sent").parquet(f"{path}/batch={number}")
        batches.remove(number - 2, "sent=false")

    return with_runs(stream, runs, time).writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delivered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that `deliver_by_runs` delivered, with their `batch`; schema: its stream's, with the time."""
    return spark.read.schema(f"{schema}, batch int, sent boolean").parquet(path).where("sent").drop("sent")


class CarryOver(StatefulProcessor):
    """The state of a key: its rows that wait. A run delivers the first `top` of new and waiting ones, by rank; what is left goes out in the next runs."""

    def __init__(self, top: int, schema: StructType) -> None:
        self.top, self.schema = top, schema  # the rank's columns and the row as JSON

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)

    def send(self, rows: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        rows.sort()
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if len(rows) > self.top:
            self.waiting.put(rows[self.top :])
            self.handle.registerTimer(now + 1)  # due as soon as a later run moves the watermark
        else:
            self.waiting.clear()
        sent = [r[-1] for r in rows[: self.top]]
        yield pd.DataFrame({"row": pd.Series(sent, dtype=object), "run": pd.Series([pd.Timestamp(now, unit="ms")] * len(sent), dtype="datetime64[ns]")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        landed = pd.concat(list(rows))
        now, landed = int(landed["carry_at"].max()), landed[~landed["carry_run"].astype(bool)]
        if not landed.empty:
            new = zip(*(landed[c].tolist() for c in self.schema.names), strict=True)  # Python's own numbers, which the state takes
            yield from self.send([tuple(r) for r in self.waiting.get()] + list(new), now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self.send([tuple(r) for r in self.waiting.get()], timerValues.getCurrentWatermarkInMs())


#: Rows wait as JSON, with times to the microsecond.
ROW_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def carry_over(stream: DataFrame, runs: DataFrame, key: str, rank: list[str], top: int, time: str = "run") -> DataFrame:
    """A stream's rows with the `run` that delivers them: at most `top` of each key in a run, in ascending order of rank, the rest in later runs.

    `runs` is a stream of the times of scheduled runs, by which the watermark moves and waiting rows go out on a feed where nothing
    lands any more; `time` is when a row landed. Needs the RocksDB state store, and takes some milliseconds of Python for a key in each run: `deliver_by_runs` is for many keys. A key's waiting rows are its state, and keys share no task; rows
    without a key are those of one key. Columns of rank are numbers or texts without nulls.
    """
    columns = [c for c in stream.columns if c != time]
    schema = stream.select(*columns).schema
    ranks = [StructField(f"carry_rank{i}", stream.schema[c].dataType) for i, c in enumerate(rank)]
    # no column of a group is ever null: a null would make pandas read whole numbers, keys among them, as floats
    rows = stream.select(
        F.coalesce(F.concat(F.lit("+"), F.col(key).cast("string")), F.lit("-")).alias("carry_key"), F.col(time).alias("carry_time"), F.lit(False).alias("carry_run"),
        *(F.col(c).alias(f.name) for c, f in zip(rank, ranks, strict=True)), F.to_json(F.struct(*columns), ROW_OPTIONS).alias("carry_row"),
    )
    ticks = runs.select(
        F.lit("").alias("carry_key"), F.col(time).alias("carry_time"), F.lit(True).alias("carry_run"),
        *((F.lit("") if isinstance(f.dataType, StringType) else F.lit(0).cast(f.dataType)).alias(f.name) for f in ranks), F.lit("").alias("carry_row"),
    )
    both = rows.unionByName(ticks).withColumn("carry_at", F.unix_millis("carry_time")).withWatermark("carry_time", "0 seconds")
    state = StructType([*ranks, StructField("carry_row", StringType())])
    out = StructType([StructField("row", StringType()), StructField("run", TimestampType())])
    sent = both.groupBy("carry_key").transformWithStateInPandas(CarryOver(top, state), out, "Append", "EventTime")
    return sent.select(F.from_json("row", schema, ROW_OPTIONS).alias("row"), "run").select("row.*", "run")


NOTICE_SCHEMA = StructType([StructField("source", StringType()), StructField("run", LongType()), StructField("kind", StringType()), StructField("failed", StringType())])


def notice_kind(failed: str, before: str, run: int, last: int | None, every: int) -> str | None:
    """issues, recovered or daily if a notice is due: the failed set changed, or `every` seconds went by since the last delivered one."""
    if failed == before and last is not None and run - last < every:
        return None
    if failed:
        return "issues"
    return "recovered" if before else "daily"


def fold_runs(runs: pd.DataFrame, source: str, state: tuple[str, int | None], every: int) -> tuple[list[tuple], tuple[str, int | None]]:
    """The notices of a source's runs(run, failed, delivered) in order and the state after them: only a delivered notice changes it."""
    out, (before, last) = [], state
    for r in runs.sort_values("run").itertuples(index=False):
        if kind := notice_kind(r.failed, before, r.run, last, every):
            out.append((source, r.run, kind, r.failed))
            if r.delivered:
                before, last = r.failed, r.run
    return out, (before, last)


def with_delivery(runs: DataFrame) -> DataFrame:
    """runs(source, run, failed, delivered): without the last column every notice counts as delivered."""
    delivered = F.coalesce("delivered", F.lit(True)) if "delivered" in runs.columns else F.lit(True)
    return runs.select("source", "run", "failed", delivered.alias("delivered"))


def notices(runs: DataFrame, every: int = 86_400) -> DataFrame:
    """Notices of each source's runs in order: the batch form, a fold over each source's own runs."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fold_runs(group, group["source"].iat[0], ("", None), every)[0], columns=NOTICE_SCHEMA.names)

    return with_delivery(runs).groupBy("source").applyInPandas(fold, NOTICE_SCHEMA)


class NoticeProcessor(StatefulProcessor):
    """The streaming form of `notices`: a source's last delivered notice is its state. With a clock, a timer sends the notice that falls due while no run of the source lands."""

    def __init__(self, every: int, clocked: bool = False) -> None:
        self.every, self.clocked = every, clocked

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("failed", StringType()), StructField("run", LongType())]))

    def remember(self, state: tuple[str, int | None]) -> None:
        self.last.update(state)
        if self.clocked and state[1] is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((state[1] + self.every) * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        state = tuple(self.last.get()) if self.last.exists() else ("", None)
        landed = pd.concat(list(rows))
        landed = landed[landed["source"].notna()]
        out, after = fold_runs(landed, key[0], state, self.every)
        if after != state:
            self.remember(after)
        yield pd.DataFrame(out, columns=NOTICE_SCHEMA.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        failed, _ = self.last.get()
        now = timerValues.getCurrentWatermarkInMs() // 1000
        self.remember((failed, now))
        yield pd.DataFrame([(key[0], now, "issues" if failed else "daily", failed)], columns=NOTICE_SCHEMA.names)


def notice_stream(runs: DataFrame, every: int = 86_400, clock: DataFrame | None = None) -> DataFrame:
    """notices over a stream of runs; needs the RocksDB state store. `clock`, a stream of times (run, in seconds), lets
    a source's notice go out `every` seconds after its last one though none of its own runs lands; rows without a source are then left out."""
    rows = with_delivery(runs)
    if clock is None:
        return rows.groupBy("source").transformWithStateInPandas(NoticeProcessor(every), NOTICE_SCHEMA, "Append", "none")
    timed = rows.unionByName(clock.select("run"), allowMissingColumns=True).withColumn("__time", F.timestamp_seconds("run")).withWatermark("__time", "0 seconds")
    return timed.groupBy("source").transformWithStateInPandas(NoticeProcessor(every, True), NOTICE_SCHEMA, "Append", "EventTime")
