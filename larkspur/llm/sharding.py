"""Sharding by longest processing time: groups, largest first, each to the least-loaded shard.

Rows with equal texts are a group and stay together; a group's size is the sum of its rows' sizes (UTF-8 bytes of the
text and `ROW_BYTES`). Groups of equal size are alike to the schedule, so the driver needs only
how many groups there are of each size: a heap of shards takes runs of equal sizes, long runs in one step up to
the level at which the heap decides again. Sizes count with their first `SIZE_BITS` bits (those below 32,768 bytes exactly,
larger ones to a part in 16,384), which bounds the number of runs whatever the corpus holds: 32,768 and 16,384 for each doubling
beyond, a row of `n_shards` numbers each. Which group
of a run goes where is then a matter of its place among its equals, counted over sorted ranges: the first ones go to the first shard.

A null text has no bytes and goes with the empty ones; repeated rows are rows of one group; ties go by the digest of the
text and to the shard of the least number. A group larger than a shard's share stays whole, and
its shard gets nothing else as long as others have less. Columns named like an output give way to it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common

ROW_BYTES, SIZE_BITS = 8, 15
#: Numbers in the schedule up to which it is broadcast (16 MB); a larger one is joined by a shuffle.
MAX_NUMBERS = 2_000_000


def counted_size(size: Column) -> Column:
    """A size with all bits after the first SIZE_BITS cleared."""
    spare = F.greatest(F.length(F.bin(size)) - SIZE_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, spare), spare)


def schedule(sizes: np.ndarray, groups: np.ndarray, n_shards: int) -> np.ndarray:
    """[runs, shards] how many of a run's groups of equal size, the largest size first, each shard gets."""
    loads, taken = [0] * n_shards, np.zeros((len(sizes), n_shards), np.int64)
    for run, (size, n) in enumerate(zip(sizes.tolist(), groups.tolist(), strict=True)):
        got = level(loads, size, n) if n > 4 * n_shards else [0] * n_shards
        heap = [(load + g * size, shard) for shard, (load, g) in enumerate(zip(loads, got, strict=True))]
        heapq.heapify(heap)
        for _ in range(n - sum(got)):
            load, shard = heap[0]
            got[shard] += 1
            heapq.heapreplace(heap, (load + size, shard))
        for load, shard in heap:
            loads[shard] = load
        taken[run] = got
    return taken


def level(loads: list[int], size: int, groups: int) -> list[int]:
    """What each shard has got when the heap has brought all below the highest level that the groups suffice for."""
    below = lambda mark: [max(0, -(-(mark - load) // size)) for load in loads]
    low, high = min(loads), max(loads) + size * (groups + 1)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(below(mid)) <= groups else (low, mid)
    return below(low)


def assign(docs: DataFrame, n_shards: int = 24, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (all by default) with size, text_crc32, shard and slot: the row's place in its shard, by id, without gaps."""
    outputs = ("size", "text_crc32", "shard", "slot")
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in outputs]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = common.written(
        docs.select(
            F.struct(*kept).alias("row"), F.col(doc_id).alias("id"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("key"),
        ), "sized",
    )
    groups = rows.groupBy("key").agg(counted_size(F.sum("size")).alias("load"))
    groups = common.placed(groups, [F.col("load").desc(), F.col("key")], "place")
    counts = groups.groupBy("load").count().orderBy(F.desc("load")).toArrow()  # bounded by SIZE_BITS
    sizes, numbers = (counts.column(c).to_numpy().astype(np.int64) for c in ("load", "count"))
    ends = np.cumsum(schedule(sizes, numbers, n_shards), axis=1) + (np.cumsum(numbers) - numbers)[:, None]  # among all groups
    lists = pa.ListArray.from_arrays(np.arange(0, ends.size + 1, n_shards, dtype=np.int32), ends.ravel())
    spark = docs.sparkSession
    runs = spark.createDataFrame(pa.table({"load": pa.array(sizes), "ends": lists}), "load long, ends array<long>")
    runs = F.broadcast(runs) if ends.size <= MAX_NUMBERS else common.written(runs, "runs").hint("merge")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("place"))).alias("shard")
    shards = common.written(groups.join(runs, "load").select("key", shard), "group-shards")
    sharded = common.placed(rows.join(shards.hint("merge"), "key"), [F.col("shard"), F.col("id"), F.col("key")], "place")
    starts, before = [], 0
    rows_of = dict(tuple(r) for r in sharded.groupBy("shard").count().collect())
    for shard in range(n_shards):
        starts.append(before)
        before += rows_of.get(shard, 0)
    slot = F.col("place") - F.get(F.array(*map(F.lit, starts)).cast("array<long>"), F.col("shard"))
    return sharded.select("row.*", "size", "text_crc32", "shard", slot.alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes assigned rows to one folder for each shard, in the order of their slots; a shard may span several files."""
    ranges = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ranges.write.partitionBy("shard").parquet(path)
