"""N-gram Jaccard self-join: a MinHash LSH forest, exact verification, near-duplicate classes.

Texts are lower-cased (A-Z) and cut into words at white space; a text's set holds its
`n`-word shingles (a text of fewer words, but not none, is one shingle). Two texts
are linked if the Jaccard similarity of their sets is at least `threshold`.

1. Texts with the same words form one *copy class*; its smallest id represents it,
   and only representatives go on.
2. A representative has a signature of `max_depth` minhash values in each of `trees` prefix
   tries. The floor of its prefixes is the longest length at which its expected recall,
   1 - (1 - s^length)^trees, reaches `target_recall`; s is the least similarity from the threshold up that a
   text with a set of its size can have to another set, so small sets have longer floors. Texts that share no prefix of the
   floor that the threshold itself needs leave before any other prefix is made.
3. A node of a trie is a prefix with two texts or more. In each trie a text begins at its longest prefix that is a node, and shortens it
   as long as that brings a text that it hasn't met there, down to its floor (or that of a text it meets, if that
   is shorter: two texts meet if they share what either one looks for). Where it stops is its *bucket*, and depends on who else
   shares its prefixes. Further shortening to the floor would add nobody, so stopping early costs no recall. The tries are tables of
   nodes that Spark sorts and groups, so that no task walks a trie.
4. Buckets with the same members are one bucket. A bucket of more than `block` texts
   (or of much text) is split into blocks; each pair of blocks is one verification
   group, so that no task holds a whole bucket.
5. Groups get the shingle sets of their texts and verify all pairs exactly by matrix
   products. A pair is counted in the first bucket that its texts share and nowhere
   else. No pairs leave a group: only the count of links of each text, and the edges of
   a spanning forest of the verified links.
6. Connected components over these edges (star contraction) are the near-duplicate
   classes. The number of links of a text is exact for the pairs that share a bucket.

Null texts count as empty; texts without words link to nothing, but are copies of each other;
texts are read whole, however long; rows that repeat an id are copies of it or, with another text, a text of their own; a null id counts as a
row of its own text and never represents a class that has another id; an empty table
gives an empty result; columns of the input aren't kept, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import common

U = np.uint64
#: Odd multipliers of the shingle and minhash mixers.
GOLDEN = 0x9E3779B97F4A7C15
MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * MIX[0]
    x = (x ^ (x >> U(27))) * MIX[1]
    return x ^ (x >> U(31))


def shingles(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles of texts laid end to end in `words` (text k from starts[k] to
    starts[k+1]) and where each text's shingles start."""
    sizes = np.diff(starts)
    counts = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], counts) + np.repeat(starts[:-1], counts)
    text_end = np.repeat(starts[1:], counts)
    h = np.full(len(at), GOLDEN, U)
    last = max(0, len(words) - 1)
    for k in range(n):
        here = at + k
        h = np.where(here < text_end, mixed(h + words[np.minimum(here, last)]), h) if len(words) else h
    return h, first


def prefix_keys(h: np.ndarray, first: np.ndarray, trees: int, low: int, high: int) -> np.ndarray:
    """[texts, trees, high - low + 1] keys of the prefixes of low to high minhash values; texts without shingles get 0."""
    full = np.flatnonzero(np.diff(first) > 0)
    keys = np.zeros((len(first) - 1, trees, high - low + 1), U)
    if not len(full):
        return keys
    at = first[:-1][full]
    for t in range(trees):
        key = np.full(len(full), t + 1, U)
        for d in range(1, high + 1):
            salt = mixed(np.array([GOLDEN * (t * 64 + d) & 0xFFFFFFFFFFFFFFFF], U))[0]
            x = h ^ salt
            key = mixed(key + np.minimum.reduceat(x * MIX[0] ^ (x >> U(29)), at))
            if d >= low:
                keys[full, t, d - low] = key
    return keys


def least_similarity(size: int, threshold: float) -> float:
    """The least Jaccard similarity, from the threshold up, of a set of `size` elements to another set."""
    best = 1.0
    for shared in range(size, 0, -1):
        either = int(shared / threshold + 1e-9)
        if either < size:
            break
        best = min(best, shared / either)
    return best


def prefix_length(similarity: float, trees: int, max_depth: int, target_recall: float) -> int:
    """The length at which shortening stops: the longest whose expected recall at this similarity reaches the target."""
    length = max_depth
    while 1 - (1 - similarity**length) ** trees < target_recall:
        length -= 1
        if not length:
            raise ValueError(f"{trees} tries can't reach a recall of {target_recall} at {similarity}")
    return length


def prefix_lengths(h: np.ndarray, first: np.ndarray, threshold: float, trees: int, max_depth: int, target_recall: float, most: int = 200) -> np.ndarray:
    """The length for each text by the size of its set; sets of more than `most` shingles count as any similarity from the threshold up."""
    table = [max_depth, *(prefix_length(least_similarity(m, threshold), trees, max_depth, target_recall) for m in range(1, most + 1))]
    table.append(prefix_length(threshold, trees, max_depth, target_recall))
    counts = np.diff(first)
    sizes = [len(np.unique(h[a : a + k])) if k <= 4 * most else most + 1 for a, k in zip(first[:-1], counts, strict=True)]
    return np.array(table, np.int32)[np.minimum(np.array(sizes, np.int64), most + 1)]


def list_starts(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    values = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).view(U)
    return values, np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def chunked(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """batch in slices of about `most` list values."""
    ends = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def with_keys(df: DataFrame, n: int, threshold: float, trees: int, low: int, high: int, target_recall: float) -> DataFrame:
    """df(.., hashes) with n_words, keys (of all tries, one after the other, and in each by length from low to high)
    and length (what the text looks for) in place of hashes."""
    kept = [f for f in df.schema.fields if f.name != "hashes"]
    schema = T.StructType([*kept, *T.StructType.fromDDL("n_words long, length int, keys array<long>").fields])
    width = trees * (high - low + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunked(batch, "hashes"):
                words, starts = list_starts(part.column("hashes"))
                h, first = shingles(words, starts, n)
                keys = prefix_keys(h, first, trees, low, high).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, width, dtype=np.int32), keys.ravel())
                lengths = prefix_lengths(h, first, threshold, trees, high, target_recall) if high > low else np.full(len(keys), low, np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(np.diff(starts).astype(np.int64)), pa.array(lengths), lists], schema.names)

    return df.mapInArrow(run, schema)


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """[texts, texts] whether the Jaccard similarity of two sets is at least the threshold."""
    size = np.array([len(s) for s in sets], np.int64)
    owner, value = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # what one text alone has adds to no intersection
    owner, column = owner[shared], column[shared]
    both = np.zeros((len(sets), len(sets)), np.int64)
    if len(column):
        column = np.cumsum(np.concatenate([[False], column[1:] != column[:-1]]))
        width = 4096
        for low in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, (low, low + width))
            has = np.zeros((len(sets), width), np.float32)
            has[owner[a:b], column[a:b] - low] = 1
            both += (has @ has.T).astype(np.int64)
    either = size[:, None] + size[None, :] - both
    return both >= np.ceil(threshold * either - 1e-9)


def verified(group: pd.DataFrame, n: int, threshold: float) -> pd.DataFrame:
    """Links of one pair of blocks: (id, n_links, parent), where the edges id-parent span the links."""
    group = group.sort_values(["id"]).reset_index(drop=True)
    ids, side = group["id"].to_numpy(np.int64), group["part"].to_numpy(np.int64)
    lengths = np.array([len(x) for x in group["hashes"]], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    words = np.concatenate([np.asarray(x, np.int64) for x in group["hashes"]]).view(U)
    h, first = shingles(words, starts, n)
    sets = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    on = linked(sets, threshold)
    np.fill_diagonal(on, False)
    low, high, bucket = group["low"].iat[0], group["high"].iat[0], group["bucket"].iat[0]
    if low != high:  # pairs within a block belong to the group of that block alone
        on &= side[:, None] != side[None, :]
    # a pair counts in the first bucket that both have
    a, b = np.nonzero(np.triu(on))
    held = [np.asarray(x, np.int64) for x in group["buckets"]]
    sizes = np.array([len(x) for x in held], np.int64)
    table = np.zeros((len(held), sizes.max()), np.int64)
    filled = np.arange(table.shape[1]) < sizes[:, None]  # any value can be a bucket, so none marks the padding
    for i, x in enumerate(held):
        table[i, : len(x)] = np.sort(x)
    mine = np.zeros(len(a), bool)
    for k in range(0, len(a), 1 << 16):
        i, j = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
        x, y = table[i], table[j]
        common_bucket = ((x[:, :, None] == y[:, None, :]) & filled[i][:, :, None] & filled[j][:, None, :]).any(2)
        mine[k : k + (1 << 16)] = x[np.arange(len(x)), common_bucket.argmax(1)] == bucket
    a, b = a[mine], b[mine]
    count = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
    parent = np.arange(len(ids))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
    for i in range(len(parent)):  # parents come before their children
        parent[i] = parent[parent[i]]
    some = np.flatnonzero(count)
    return pd.DataFrame({"id": ids[some], "n_links": count[some], "parent": ids[parent[some]]})


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root): the smallest id of each connected component of edges(id, parent), for ids with an edge.

    Alternates star contractions (large and small stars of Kiveris and others, 2014) until nothing changes.
    """
    pairs = common.written(edges.where("id > parent").select(F.col("id").alias("u"), F.col("parent").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # Smallest neighbours are aggregated and written before they meet all neighbours, so that a join
        # has shuffles alone below it and a star's centre can be split.
        # large star: each neighbour above u goes to the smallest in u's neighbourhood
        both = pairs.union(pairs.select("v", "u"))
        least = common.written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = common.written(both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: each neighbour below u, and u, go to the smallest of them
        least = common.written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least.hint("merge"), "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = common.written(small.select("e.*").where("u > v").distinct(), "edges")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    roots = pairs.select(F.col("v").alias("id")).distinct().withColumn("root", F.col("id"))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots)


def word_hashes(text: Column) -> Column:
    return F.transform(common.split_words(common.ascii_lower(text)), lambda w: F.xxhash64(w))


def copy_key(words: Column) -> Column:
    """What texts with the same words share."""
    return F.unhex(F.sha2(F.array_join(words, " "), 256))


def buckets_of(inside: DataFrame) -> DataFrame:
    """(rep, depth, bucket) in each trie from a text's nodes (rep, tree, depth, texts, open, node): the longest prefix from which shortening, level by
    level, brings no other text down to the shortest open one. Nodes below one another hold the same texts if they hold as many."""
    path = inside.groupBy("rep", "tree").agg(F.collect_list(F.struct("depth", "texts", "open", "node")).alias("l"))  # a node for each length
    floor = F.array_min(F.transform(F.filter("l", lambda x: x["open"]), lambda x: F.struct(x["depth"].alias("depth"), x["texts"].alias("texts"))))
    path = path.select("rep", "l", floor.alias("floor")).where("floor is not null")
    same = F.filter("l", lambda x: (x["depth"] >= F.col("floor.depth")) & (x["texts"] == F.col("floor.texts")))
    stop = F.array_max(F.transform(same, lambda x: F.struct(x["depth"].alias("depth"), x["node"].alias("node"))))
    return path.select("rep", stop.alias("stop")).select("rep", "stop.depth", F.col("stop.node").alias("bucket"))


def near_duplicates(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    trees: int = 12,
    max_depth: int = 8,
    target_recall: float = 0.999,
    block: int = 256,
    block_words: int = 1 << 20,
    details: bool = False,
) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its near-duplicate class), copy_id
    (smallest id with the same words) and n_links (other texts linked to its text); with details also copy (its
    copy_key) and root (the same for all of a class, whatever the ids)."""
    common.modest_batches(df.sparkSession, 2000)
    low = prefix_length(threshold, trees, max_depth, target_recall)
    forest = lambda hashed, high: with_keys(hashed, n, threshold, trees, low, high, target_recall)
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = docs.withColumn("words", common.split_words(common.ascii_lower(F.col("text"))))
    texts = texts.select("id", F.xxhash64("text").alias("body"), copy_key(F.col("words")).alias("copy"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    rows = common.written(forest(texts, low).drop("length"), "keys")

    # 1: copy classes, numbered by their rows in the written table. A class's text stands for all its copies
    # the row whose text stands for a class: the one of its smallest id, or without ids any of one text
    body = F.coalesce(F.min_by("body", "id"), F.min("body"))
    classes = rows.groupBy("copy").agg(F.min("id").alias("copy_id"), body.alias("body"), F.first("n_words").alias("n_words"), F.first("keys").alias("keys"))
    classes = common.written(common.with_row_id(classes, "rep"), "classes")

    # 2: texts that share the shortest prefix of a trie with another text, and all their prefixes
    short = classes.where("n_words > 0").select("rep", F.explode("keys").alias("node"))
    crowded = common.written(short.groupBy("node").agg(F.count("*").alias("texts")).where("texts > 1").select("node"), "crowded")
    some = common.written(short.join(crowded.hint("merge"), "node", "left_semi").select("rep").distinct(), "some")
    some = classes.select("rep", "copy", "body", F.coalesce("copy_id", "body").alias("id")).join(some.hint("merge"), "rep", "left_semi")
    # their texts, by the id and a hash of the text, since ids may repeat with other texts or be missing, and then the words
    some = common.written(some, "wanted")
    whole = docs.withColumn("body", F.xxhash64("text")).withColumn("id", F.coalesce("id", "body")).join(some.hint("merge"), ["id", "body"])
    whole = whole.withColumn("words", common.split_words(common.ascii_lower(F.col("text")))).where(copy_key(F.col("words")) == F.col("copy"))
    whole = whole.groupBy("rep").agg(F.first("words").alias("words")).select("rep", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    whole = common.written(whole, "texts")
    deep = common.written(forest(whole, max_depth), "prefixes")
    levels = max_depth - low + 1
    each = deep.select("rep", "length", F.posexplode("keys").alias("at", "node"))
    each = each.select("rep", "length", "node", F.floor(F.col("at") / levels).alias("tree"), (F.col("at") % levels + low).alias("depth"))

    # 3: nodes with the number of their texts; those at a text's floor are open
    counted = each.groupBy("node").agg(F.count("*").alias("texts"), F.max(F.col("depth") == F.col("length")).alias("open"))
    counted = common.written(counted.where("texts > 1"), "nodes")
    inside = common.written(each.join(counted.hint("merge"), "node").select("rep", "tree", "depth", "texts", "open", "node"), "inside")
    sequences = common.written(buckets_of(inside).join(deep.select("rep", "n_words").hint("merge"), "rep"), "sequences")

    # 4: buckets with two texts or more, one for each set of members
    member = F.xxhash64("rep", F.lit(1)).cast("decimal(38,0)")
    buckets = sequences.groupBy("bucket").agg(
        F.count("*").alias("members"), F.sum("n_words").alias("size"), F.sum(member).alias("sum"), F.min("rep").alias("low"), F.max("rep").alias("high")
    )
    buckets = buckets.where("members > 1").groupBy("members", "sum", "low", "high").agg(F.min("bucket").alias("bucket"), F.max("size").alias("size"))
    blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("size") / block_words)).cast("int")
    buckets = common.written(buckets.select("bucket", blocks.alias("blocks")), "bucket-sizes")
    inside = common.written(sequences.select("rep", "bucket").join(buckets.hint("merge"), "bucket"), "buckets")
    held = inside.groupBy("rep").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))  # `trees` at most

    # 5: word hashes of the texts in buckets, sent to each group that needs them
    wanted = common.written(whole.join(held.hint("merge"), "rep"), "held")
    members = inside.select("rep", "bucket", "blocks", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("blocks")).cast("int").alias("part"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("rep", "bucket", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    groups = members.join(wanted.hint("merge"), "rep").withColumnRenamed("rep", "id")
    groups = groups.select("id", "bucket", "part", "low", "high", "hashes", "buckets")
    schema = T.StructType.fromDDL("id long, n_links long, parent long")
    links = groups.groupBy("bucket", "low", "high").applyInPandas(lambda g: verified(g, n, threshold), schema)
    links = common.written(links, "links")

    # 6: classes of near duplicates, by their texts' hashes, then by the smallest document id
    roots = common.written(components(links.select("id", "parent")).withColumnRenamed("id", "rep"), "roots")
    counts = common.written(links.groupBy("id").agg(F.sum("n_links").alias("n_links")).withColumnRenamed("id", "rep"), "link-counts")
    near = classes.select("rep", "copy", "copy_id").join(roots.hint("merge"), "rep", "left")
    near = common.written(near.join(counts.hint("merge"), "rep", "left").withColumn("root", F.coalesce("root", "rep")), "near")
    smallest = common.written(near.groupBy("root").agg(F.min("copy_id").alias("class_id")), "smallest")
    near = near.join(smallest.hint("merge"), "root").select("copy", "root", "class_id", "copy_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    found = rows.select("id", "copy").join(common.written(near, "classes").hint("merge"), "copy")
    return found.select(F.col("id").alias("doc_id"), "class_id", "copy_id", "n_links", *(["copy", "root"] if details else []))
