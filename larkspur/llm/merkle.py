"""Merkle manifest of a dataset: a tree of digests for each source, a tree of sources above, and every row's proof.

A leaf digests a row's columns, each as `-` if null, else as its UTF-8 byte count, a colon and its value. The
leaves of a tree are numbered in order over sorted ranges (so a source with most rows spans many tasks) and
cut into aligned blocks of FANOUT ** BLOCK_LEVELS; a block's task hashes the lowest levels. Above the blocks the upper levels
are a butterfly exchange: in round k, blocks whose numbers differ in digit k (to base FANOUT)
alone swap the roots of their subtrees, and each hashes the run into the ancestor that all of them share. After the last round every block
has the root and its siblings of every level: no task holds a tree, and nothing is sent down again. A ragged last
subtree has fewer blocks than there are lanes, so its blocks take turns in serving the lanes that lack one.
Trees' roots, in order of their sources, are the leaves of one more tree, by the same exchange.

A run of one node is hashed like any other; a tree of one leaf has that leaf as its root. Null sources are one
tree, before all others; null ids come before all others and ties of an id go by the leaf, so repeated rows are equal leaves side by side.
An empty table has an empty manifest. Columns named like an output give way to it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from larkspur.llm import common

FANOUT, BLOCK_LEVELS = 16, 3
#: Trees up to which what is known of each tree is broadcast; beyond, it is joined by a shuffle.
MAX_TREES, MAX_TREE_BYTES = 50_000, 16_000_000
PROOF = "array<struct<place:int,siblings:array<string>>>"


def encoded(value: Column) -> Column:
    """A value as `-` or as its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def tree_levels(leaves: list[str], levels: int | None = None) -> list[list[str]]:
    """The nodes of each level from the leaves up: up to the root, or `levels` times."""
    found = [leaves]
    while len(found[-1]) > 1 if levels is None else len(found) <= levels:
        nodes = found[-1]
        found.append([digest(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)])
    return found


def exchange(units: DataFrame, most: int) -> DataFrame:
    """units(tree, unit, units, digest) with the tree's root as digest and the proof from the unit to it.

    `units` is the number of units of the tree, `most` the largest such number; one grouped step for each level.
    """
    now = units.withColumn("proof", F.array().cast(PROOF))
    span = 1  # units below a node of this level
    while span < most:
        at, done = F.floor(F.col("unit") / span), F.col("units") <= span
        run, lane = F.floor(at / FANOUT), F.col("unit") % span
        width = F.least(F.lit(span), F.col("units") - at * span)  # less in a ragged last subtree
        alone = (at % FANOUT == 0) & (F.col("units") <= (at + 1) * span)
        lanes = F.when(done | alone | (width == span), F.array(lane)).otherwise(F.sequence(lane, F.lit(span - 1), width))
        sent = now.select(
            "tree", "units", F.when(done, F.col("unit")).otherwise(run).alias("run"), F.explode(lanes).alias("lane"), lane.alias("__own"),
            F.when(done, F.lit(0)).otherwise(at % FANOUT).cast("int").alias("place"), "digest", "unit", "proof",
        )
        message = F.struct("place", "digest", (F.col("lane") == F.col("__own")).alias("own"), "unit", "proof")
        met = sent.groupBy("tree", "units", "run", "lane").agg(F.collect_list(message).alias("l"))  # at most FANOUT
        met = met.withColumn("l", F.array_sort(F.transform("l", lambda x: F.struct(x["place"], x["digest"], x["own"], x["unit"], x["proof"]))))
        parent = F.when(done, F.col("l")[0]["digest"]).otherwise(F.sha2(F.array_join(F.transform("l", lambda x: x["digest"]), ""), 256))
        members = met.select("tree", "units", parent.alias("digest"), "l", F.explode(F.filter("l", lambda x: x["own"])).alias("m"))
        others = F.transform(F.filter("l", lambda x: x["place"] != F.col("m.place")), lambda x: x["digest"])
        step = F.array(F.struct(F.col("m.place").alias("place"), others.alias("siblings")))
        proof = F.when(done, F.col("m.proof")).otherwise(F.concat("m.proof", step))
        now = members.select("tree", F.col("m.unit").alias("unit"), "units", "digest", proof.alias("proof"))
        span *= FANOUT
    return now


def manifest(
    docs: DataFrame, columns: list[str], tree: str = "source", order: str = "doc_id", presented: dict[str, Column] | None = None,
    keep: list[str] | None = None, proofs: bool = False, block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """docs' columns `keep` (all by default) with leaf, subroot, root, proof_sha256, folded_root and verified (and proof, if asked for).

    proof_sha256 digests the siblings, level by level from the leaf to the root, left to right. `presented`
    has the values of columns as a holder of the row presents them: folded_root is what their leaf and the proof give, `verified`
    whether that is the root. Without it the row's own leaf is folded.
    """
    outputs = {"leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"}
    outputs |= {"proof": PROOF} if proofs else {}
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in outputs]
    shown = {c: F.col(c) for c in columns} | (presented or {})
    own, other = leaf([F.col(c) for c in columns]), leaf([shown[c] for c in columns])
    name = F.coalesce(F.concat(F.lit("+"), F.col(tree).cast("string")), F.lit(""))  # null before all others
    rows = docs.select(F.struct(*kept).alias("row"), name.alias("name"), F.col(order).alias("key"), own.alias("leaf"), (other if presented else F.lit(None).cast("string")).alias("shown"))
    rows = common.placed(rows, [F.col("name"), F.col("key"), F.col("leaf")], "at")

    trees = common.placed(rows.groupBy("name").agg(F.min("at").alias("start"), F.count("*").alias("leaves")), [F.col("name")], "tree")
    n_trees, most, n_bytes = trees.agg(F.count("*"), F.coalesce(F.max("leaves"), F.lit(0)), F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()
    few = n_trees <= MAX_TREES and n_bytes <= MAX_TREE_BYTES
    side = (lambda d: F.broadcast(d)) if few else (lambda d: d.hint("merge"))
    if not few:
        trees = common.written(trees, "trees")
    size = FANOUT**block_levels
    index = F.col("at") - F.col("start")
    numbered = rows.join(side(trees), "name").select("row", "tree", "leaves", (index / size).cast("long").alias("unit"), (index % size).cast("int").alias("at"), "leaf", "shown")

    def height(leaves: int) -> int | None:
        """Levels that a block hashes: to the root in a tree of one block."""
        return None if leaves <= size else block_levels

    root_schema = T._parse_datatype_string("tree long, unit long, units long, digest string")

    def block_root(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        tree_no, unit, leaves = (table.column(c)[0].as_py() for c in ("tree", "unit", "leaves"))
        top = tree_levels(table.column("leaf").to_pylist(), height(leaves))[-1][0]
        return pa.table([[tree_no], [unit], [-(-leaves // size)], [top]], schema=pa.schema([(f.name, to_arrow_type(f.dataType)) for f in root_schema.fields]))

    blocks = numbered.select("tree", "unit", "leaves", "at", "leaf").groupBy("tree", "unit").applyInArrow(block_root, root_schema)
    blocks = common.written(exchange(common.written(blocks, "blocks"), -(-most // size)), "block-proofs")
    subroots = blocks.where("unit = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("unit"), F.lit(n_trees).cast("long").alias("units"), "digest")
    tops = exchange(subroots, n_trees).select(F.col("unit").alias("tree"), F.col("digest").alias("root"), F.col("proof").alias("top_proof"))
    tops = common.written(tops, "tops")
    upper = blocks.join(F.broadcast(tops) if few else tops.hint("merge"), "tree").select("tree", "unit", F.col("digest").alias("subroot"), "root", F.concat("proof", "top_proof").alias("proof"))

    fields = [f for f in docs.select(*kept).schema.fields]
    schema = T.StructType([T.StructField("row", T.StructType(fields)), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in outputs.items())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def prove(table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        subroot, root, steps = (above.column(c)[0].as_py() for c in ("subroot", "root", "proof"))
        upper_steps = [(s["place"], s["siblings"]) for s in steps]
        leaves, shown = table.column("leaf").to_pylist(), table.column("shown").to_pylist()
        levels = tree_levels(leaves, height(table.column("leaves")[0].as_py()))[:-1]
        tail, folds = "".join(x for _, s in upper_steps for x in s), [("".join(s[:p]), "".join(s[p:])) for p, s in upper_steps]
        out = {n: [] for n in outputs if n not in ("leaf", "subroot", "root")}
        for i, node in enumerate(leaves):
            around, at = [], i
            for nodes in levels:
                start = at - at % FANOUT
                around.append((nodes[start:at], nodes[at + 1 : start + FANOUT]))
                at //= FANOUT
            sides = [("".join(a), "".join(b)) for a, b in around]
            folded = shown[i] or node
            for before, after in [*sides, *folds]:
                folded = hashlib.sha256(f"{before}{folded}{after}".encode()).hexdigest()
            out["proof_sha256"].append(hashlib.sha256(("".join(a + b for a, b in sides) + tail).encode()).hexdigest())
            out["folded_root"].append(folded)
            out["verified"].append(folded == root)
            if proofs:
                out["proof"].append([{"place": len(a), "siblings": a + b} for a, b in around] + steps)
        n = len(leaves)
        columns = {"row": table.column("row"), "leaf": leaves, "subroot": [subroot] * n, "root": [root] * n} | out
        return pa.table([columns[f.name].combine_chunks().cast(f.type) if f.name == "row" else pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    proved = numbered.groupBy("tree", "unit").cogroup(upper.groupBy("tree", "unit")).applyInArrow(prove, schema)
    return proved.select("row.*", *outputs)


def fold(leaf_digest: str, proof: list[dict]) -> str:
    """The root that a leaf and a proof (places and siblings, from the leaf up) give."""
    for step in proof:
        before, after = step["siblings"][: step["place"]], step["siblings"][step["place"] :]
        leaf_digest = digest([*before, leaf_digest, *after])
    return leaf_digest
