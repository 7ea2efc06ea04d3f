"""The seen state: its keys, a Bloom filter of them that keeps most rows out of the shuffle, and a table in hash buckets of which an upsert rewrites only those it touches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.urls import dedupe_keys
from larkspur.operators.relational import add_missing, stored, upsert

#: Bits of a filter block (what Spark's bitmap aggregate holds), bits for each key, probes for each key, and the most blocks
#: (64 MB): a filter of more keys has fewer bits for each, so it lets more rows through but loses none.
BLOCK_BITS, KEY_BITS, PROBES, MAX_BLOCKS = 32_768, 10, 4, 16_384
#: Rows and bytes of keys up to which the possible hits are broadcast.
MAX_HITS, MAX_HIT_BYTES = 500_000, 64_000_000


def state_keys(state: DataFrame, key: str = "state_key", require_identity: bool = True) -> DataFrame:
    """(key): the keys of a state as they are stored, and those that its records give now.

    state: the key, company, title, location, url and requisition_id. Only records with a company, a title and a location give
    keys anew, so that a record stored under an older form of its key is still found.
    """
    have = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    again = dedupe_keys(F.col("company"), F.col("title"), F.col("location"), text("url"), text("requisition_id"), require_identity)
    full = have("company") & have("title") & have("location")
    return state.select(F.explode(F.concat(F.array(key), F.when(full, again).otherwise(F.array().cast("array<string>")))).alias("key")).where("key is not null")


def block_of(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def spots_of(key: Column) -> list[Column]:
    """The bits of a key within its block, fifteen bits of one hash each."""
    return [F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(PROBES)]


def key_filter(keys: DataFrame) -> tuple[DataFrame, int]:
    """Blocks (block, bits as numbers of 64) of a Bloom filter of keys(key), and how many there may be: set by tasks, merged by block."""
    n_blocks = min(MAX_BLOCKS, max(1, math.ceil(keys.count() * KEY_BITS / BLOCK_BITS)))
    bits = keys.select(block_of(F.col("key"), n_blocks).alias("block"), F.explode(F.array(*spots_of(F.col("key")))).alias("spot"))
    blocks = bits.groupBy("block").agg(F.bitmap_construct_agg("spot").alias("bits"))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda i: F.conv(F.hex(F.substring(F.col("bits"), i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    return stored(blocks.select("block", numbers.alias("bits")), lean=True), n_blocks


def possible(pairs: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Rows of pairs whose key may be in the filter: none whose key is in it is missing. No row of pairs is shuffled."""
    place = lambda spot: spot.bitwiseAND(F.lit(63)).bitwiseXOR(F.lit(56))  # a number's first byte is its highest
    is_set = lambda spot: F.getbit(F.get(F.col("bits"), F.shiftright(spot, 6).cast("int")), place(spot).cast("int")) != 0
    met = pairs.withColumn("block", block_of(F.col("key"), n_blocks)).join(F.broadcast(blocks), "block")  # at most MAX_BLOCKS
    for spot in spots_of(F.col("key")):
        met = met.where(is_set(spot))
    return met.select(pairs.columns)


def anti_join_seen(df: DataFrame, seen_keys: DataFrame, keys: str, row_id: str) -> DataFrame:
    """Rows of df none of whose keys is in seen_keys(key).

    The filter of the seen keys leaves few rows to look up; these are broadcast to the seen keys if they are
    few indeed, so neither side is shuffled, and joined by a shuffle if they aren't. Null keys are never seen, rows without keys stay.
    """
    seen = seen_keys.select("key").where("key is not null")
    pairs = df.select(row_id, F.explode(keys).alias("key")).where("key is not null")
    maybe = stored(possible(pairs, *key_filter(seen)))
    rows, size = maybe.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    side = F.broadcast if rows <= MAX_HITS and size <= MAX_HIT_BYTES else (lambda d: d.hint("merge"))
    found = stored(seen.join(side(maybe.select("key").distinct()), "key").distinct())
    hit = stored(maybe.join(side(found), "key", "left_semi").select(row_id).distinct())
    return df.join(side(hit), row_id, "left_anti")


class BucketState:
    """A keyed table in folders by a hash of the key. An upsert reads and rewrites the buckets of its keys and no others, each as a whole,
    so that a bucket never gathers small files. Of `buckets` a large state needs enough that one of them fits a few tasks; the number stays with the table."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def bucket(self) -> Column:
        """The first 32 bits of the key's MD5, modulo the number of buckets."""
        return (F.conv(F.substring(F.md5(F.col(self.key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % self.buckets).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the rows' keys, at most `buckets` numbers."""
        return sorted(r.b for r in rows.select(self.bucket().alias("b")).where("b is not null").distinct().collect())

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows with their bucket, of some buckets only if they are given."""
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not files.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        found = self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)
        return found if buckets is None else found.where(F.col("bucket").isin(buckets) if buckets else F.lit(False))

    def upsert(self, new: DataFrame, prefer: str = "new") -> list[int]:
        """Merges rows with unique keys that aren't null; with prefer `old` a key's stored row stays. Returns the buckets that are rewritten.

        Merging the same rows again changes nothing, so a failed run is repeated as a whole.
        """
        new = stored(new)
        changed = self.touched(new)
        old = self.read(changed).drop("bucket")
        merged = (upsert if prefer == "new" else add_missing)(old, new.select(old.columns), self.key)
        merged = stored(merged.withColumn("bucket", self.bucket()))
        rows = merged.hint("rebalance", "bucket").sortWithinPartitions("bucket", self.key)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return changed
