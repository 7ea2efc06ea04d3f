"""Benchmark decontamination with DataFrame functions only.

The benchmark's items become a hash set of normalised n-word windows (an item of
fewer words, but not none, is one window of its own length). Documents are
normalised the same way, cut into chunks of window starts, and the 64-bit hash of each window is
looked up in the set by a broadcast hash join. A hit counts if the words are the same:
only then the window's text is made. Hits are gathered per document: which words lie in a hit, which
items they come from. The set is broadcast while it has at most MAX_WINDOWS
windows and MAX_BYTES of text and item ids. Beyond that the hashes of both sides are shuffled (documents stay
out of that join), and what they hit is verified against the written chunks.

Null texts have no words; an item or document without words hits nothing; an
empty table of either kind gives no hits; items with the same text all count;
repeated rows of documents stay apart; an input column with an output's name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common

MAX_WINDOWS, MAX_BYTES = 1_000_000, 1 << 27
#: Window starts in a chunk of a document.
CHUNK = 2048


def words_of(text: Column) -> Column:
    return common.split_words(common.ascii_lower(text), common.NON_WORD_CLASS)


def window_hash(hashes: Column, first: Column, size: Column | int) -> Column:
    """Of `size` words from position `first` (from 1), given the words' hashes."""
    return F.xxhash64(F.slice(hashes, first, size))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", n: int = 13) -> DataFrame:
    """hash, window, size, items (the ids of all items that have it)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(n))).withColumn("hashes", word_hashes(F.col("words")))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)
    each = F.transform(
        starts, lambda i: F.struct(window_hash(F.col("hashes"), i, F.col("size")).alias("hash"), F.array_join(F.slice("words", i, F.col("size")), " ").alias("window"))
    )
    windows = items.select("item", "size", F.explode(each).alias("w")).select("item", "size", "w.hash", "w.window")
    return windows.groupBy("hash", "window", "size").agg(F.collect_set("item").alias("items"))


PLACES = "array<struct<pos:int,size:int,hash:bigint>>"


def windows_in(hashes: Column, size: int) -> Column:
    """(pos, size, hash) of the windows of a chunk that begin within it; pos from 0."""
    starts = F.sequence(F.lit(1), F.least(F.size(hashes) - size + 1, F.lit(CHUNK)))
    found = F.transform(starts, lambda i: F.struct((i - 1).alias("pos"), F.lit(size).alias("size"), window_hash(hashes, i, size).alias("hash")))
    return F.when(F.size(hashes) >= size, found).otherwise(F.array().cast(PLACES))


def same_words(window: Column, words: Column, pos: Column, size: Column) -> Column:
    return window == F.array_join(F.slice(words, pos + 1, size), " ")


def merged(hits: Column) -> Column:
    """Word spans [first, end) that the hits (pos, size) cover, merged, in order."""
    spans = "array<struct<first:int,end:int>>"
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["pos"].alias("first"), (h["pos"] + h["size"]).alias("end"))))

    def step(acc: Column, h: Column) -> Column:
        joined = (F.size(acc["open"]) > 0) & (h["first"] <= F.get(acc["open"], F.lit(0))["end"])
        last = F.get(acc["open"], F.lit(0))
        grown = F.array(F.struct(last["first"].alias("first"), F.greatest(last["end"], h["end"]).alias("end")))
        return F.struct(
            F.when(joined, acc["done"]).otherwise(F.concat(acc["done"], acc["open"])).alias("done"),
            F.when(joined, grown).otherwise(F.array(h)).alias("open"),
        )

    start = F.struct(F.array().cast(spans).alias("done"), F.array().cast(spans).alias("open"))
    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["done"], acc["open"]))


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 13,
    keep: list[str] | None = None,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """documents' columns `keep` (all by default) with n_words, spans (merged word spans
    within benchmark windows), items (ids, as sorted strings) and n_hit."""
    outputs = ("n_words", "spans", "items", "n_hit")
    kept = [c for c in (keep if keep is not None else documents.columns) if c not in outputs]
    known = common.written(item_windows(benchmark, item_id, item_text, n), "windows")
    held = F.sum(F.octet_length("window") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 16))
    sizes = {r["size"]: (r.n, r.held) for r in known.groupBy("size").agg(F.count("*").alias("n"), held.alias("held")).collect()}  # n rows at most
    small = sum(k for k, _ in sizes.values()) <= max_windows and sum(k for _, k in sizes.values()) <= MAX_BYTES
    known = known.select(F.col("hash").alias("known_hash"), "window", "items")

    docs = documents.select(F.struct(*kept).alias("row"), words_of(F.col(text)).alias("words"))
    docs = common.with_row_id(docs).withColumn("n_words", F.size("words"))
    at = F.sequence(F.lit(0), F.greatest(F.col("n_words") - 1, F.lit(0)), F.lit(CHUNK))
    pieces = F.transform(at, lambda a: F.struct(a.alias("at"), F.slice("words", a + 1, CHUNK + n - 1).alias("words")))
    # the document itself goes with its first chunk only
    chunks = docs.select("row_id", "row", "n_words", F.explode(pieces).alias("piece"))
    chunks = chunks.select(
        "row_id", F.when(F.col("piece.at") == 0, F.col("row")).alias("row"), "n_words", F.col("piece.at").alias("at"), F.col("piece.words").alias("words")
    )
    if not small:
        chunks = common.written(chunks, "chunks")  # its row ids hold from here on
    hashed = common.settled(chunks.withColumn("hashes", word_hashes(F.col("words"))))
    windows = F.concat(*(windows_in(F.col("hashes"), s) for s in sorted(sizes))) if sizes else F.array().cast(PLACES)
    place = ((F.col("at") + F.col("w.pos")).alias("pos"), F.col("w.size").alias("size"), "items")
    if small:
        # a mark keeps each document; generator, join and check are one stage, in which only hits are rows with words
        mark = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("size"), F.lit(None).cast("long").alias("hash")))
        marks = F.when(F.col("at") == 0, mark).otherwise(F.array().cast(PLACES))
        each = hashed.select("row_id", "row", "n_words", "at", "words", F.explode(F.concat(marks, windows)).alias("w"))
        hits = each.join(F.broadcast(known), F.col("w.hash") == F.col("known_hash"), "left")
        hits = hits.where((F.col("w.size") == 0) | same_words(F.col("window"), F.col("words"), F.col("w.pos"), F.col("w.size")))
        hits = hits.select("row_id", F.when(F.col("w.pos") < 0, F.col("row")).alias("row"), "n_words", *place)
    else:
        each = hashed.select("row_id", "at", F.explode(windows).alias("w"))
        found = each.join(known.hint("merge"), F.col("w.hash") == F.col("known_hash")).select("row_id", "at", "w", "window", "items")
        found = found.join(chunks.select("row_id", "at", "words").hint("merge"), ["row_id", "at"])
        found = found.where(same_words(F.col("window"), F.col("words"), F.col("w.pos"), F.col("w.size")))
        none = [F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("array<string>").alias("items")]
        hits = chunks.where("at = 0").select("row_id", "row", "n_words", *none)
        hits = hits.unionByName(found.select("row_id", *place), allowMissingColumns=True)
    gathered = hits.groupBy("row_id").agg(
        F.first("row", ignorenulls=True).alias("row"),
        F.first("n_words", ignorenulls=True).cast("long").alias("n_words"),
        F.collect_list(F.when(F.col("items").isNotNull(), F.struct("pos", "size"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    spans = gathered.select("row.*", "n_words", merged(F.col("hits")).alias("spans"), "items")
    n_hit = F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["end"] - s["first"])
    return spans.withColumn("n_hit", n_hit.cast("long"))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """A document with a hit whose hit words are at least a twentieth of its words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def remove_spans(text: Column, spans: Column) -> Column:
    """The text without the words of spans and the characters that follow each of them."""
    pieces = F.regexp_extract_all(text, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x60\x7B-\x7F]*)"), F.lit(1))
    lead = F.regexp_extract(text, r"^[\x00-\x2F\x3A-\x60\x7B-\x7F]*", 0)
    left = F.filter(pieces, lambda _, i: ~F.exists(spans, lambda s: (s["first"] <= i) & (i < s["end"])))
    return F.concat(lead, F.array_join(left, ""))
