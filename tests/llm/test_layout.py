"""Sharding, fill-in-middle and the Merkle manifest against plain versions."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import fim, merkle, queries, sharding

ROWS = [(1, "b", "ab"), (2, "b", "ab"), (2, "b", "ab"), (3, None, ""), (4, None, None), (None, "a", "Xy <S> z"), (5, "é", "é😀 long " * 400), (6, "a", "q"), (7, "a", "Q"), (8, "a", None)]
SCHEMA = "doc_id long, source string, text string"


@pytest.mark.parametrize("name", ["op11_sharding", "op12_fill_in_middle", "op13_merkle_manifest"])
def test_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


def plain_schedule(runs, n):
    heap, got = [(0, s) for s in range(n)], []
    for size, groups in runs:
        taken = [0] * n
        for _ in range(groups):
            load, s = heapq.heappop(heap)
            taken[s] += 1
            heapq.heappush(heap, (load + size, s))
        got.append(taken)
    return got


def test_runs_are_the_heap():
    rng = random.Random(3)
    for n in (1, 2, 7, 24):
        runs = sorted({rng.randrange(1, 4000): rng.choice((1, 2, 30, 700)) for _ in range(40)}.items(), reverse=True)
        runs = [(10**7, 1), *runs]
        assert sharding.schedule(*np.array(runs).T, n).tolist() == plain_schedule(runs, n)
    assert sharding.schedule(np.array([9]), np.array([10**15]), 24).sum() == 10**15


def test_counted_size(spark):
    found = spark.createDataFrame([(8,), (32767,), (32769,), (10**12 + 1,)], "n long").select("n", sharding.counted_size(F.col("n")).alias("c")).collect()
    assert [r.c for r in found[:2]] == [8, 32767] and all(0 <= r.n - r.c <= r.n >> 14 for r in found) and found[2].c == 32768


def test_shards(spark):
    rng = random.Random(1)
    rows = [(i, f"text {i} " * rng.randrange(1, 60)) for i in range(600)] + [(1000 + i, "same " * 30) for i in range(50)] + [(None, None), (None, ""), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, text string, slot int, extra string")
    found = sharding.assign(docs, 6).collect()
    assert len(found) == len(rows) and set(found[0].asDict()) == {"doc_id", "text", "extra", "size", "text_crc32", "shard", "slot"}
    of, sizes, ids = {}, [0] * 6, [[] for _ in range(6)]
    for r in found:
        body = (r.text or "").encode()
        assert (r["size"], r.text_crc32) == (len(body) + 8, zlib.crc32(body)) and of.setdefault(body, r.shard) == r.shard
        sizes[r.shard] += r["size"]
        ids[r.shard].append((r.slot, -1 if r.doc_id is None else r.doc_id))
    assert all([s for s, _ in sorted(x)] == list(range(len(x))) and [i for _, i in sorted(x)] == sorted(i for _, i in x) for x in ids)
    groups = sorted((sum(r["size"] for r in found if (r.text or "") == t.decode()) for t in of), reverse=True)
    heap = [0] * 6
    for g in groups:
        heapq.heapreplace(heap, heap[0] + g)
    assert sorted(sizes) == sorted(heap) and max(sizes) - min(sizes) < 0.02 * sum(sizes)


def test_shards_without_rows_and_written(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert sharding.assign(docs.limit(0)).count() == 0
    monkeypatch.setattr(sharding, "MAX_NUMBERS", 0)
    sharded = sharding.assign(docs, 3)
    sharding.write_shards(sharded, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(map(repr, back.select(sharded.columns).collect())) == sorted(map(repr, sharded.collect())) and sharded.count() == len(ROWS)


@pytest.mark.parametrize("pattern", [None, r"\s*\w+", r"x*", r"[\w']+|\s"])
def test_skip_list(pattern):
    rng = random.Random(5)
    for n in (0, 1, 63, 64, 65, 513, 5000):
        text = "".join(rng.choice("ab x'é😀\n") for _ in range(n))
        units = None if pattern is None else re.compile(pattern)
        starts = list(range(n + 1)) if units is None else [0, *fim.unit_ends(text, units)]
        lanes = fim.SkipList(text, units)
        assert lanes.n_units == len(starts) - 1 and (n < 5000 or len(lanes.lanes) > 1)
        assert starts[-1] == n and [lanes.reach(r) for r in range(len(starts))] == starts


def test_fill_in_middle(spark):
    rows = [*ROWS, *((100 + i, "s", f"wörd{i} <x " * 30) for i in range(200)), (9, "s", "y" * 300_000), (10, "s", "ends in <"), (11, "s", "<S"), (12, "s", ">")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], f"{SCHEMA}, form int")
    cut = fim.fill_in_middle(docs).withColumn("restored", fim.restored(F.col("output"), F.col("form")))
    found = cut.collect()
    assert len(found) == len(rows) and {r.form for r in found} == {"plain", "psm", "spm"}
    for r in found:
        text = r.text or ""
        h = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
        assert r.restored == text and r.n == len(text)
        if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
            assert (r.form, r.output, r.prefix_chars, r.middle_chars) == ("plain", text, None, None)
            continue
        a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
        parts = {"P": text[:a], "M": text[a:b], "S": text[b:]}
        order = "SPM" if h4 % 100 < 20 else "PSM"
        assert (r.form, r.prefix_chars, r.middle_chars) == (order.lower(), a, b - a)
        assert r.output == "".join(f"<{k}>{parts[k]}" for k in order)
    words = fim.fill_in_middle(docs, pattern=r"\s*\S+", rate=100, keep=["doc_id"]).where("doc_id = 150").first()
    assert words.n == 61 and words.form != "plain"
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def climb(nodes, i):
    """Root and the siblings of node i by level."""
    around = []
    while len(nodes) > 1:
        start = i - i % 16
        around.append((nodes[start:i], nodes[i + 1 : start + 16]))
        nodes, i = [sha("".join(nodes[j : j + 16])) for j in range(0, len(nodes), 16)], i // 16
    return nodes[0], around


def brute_manifest(rows, tamper):
    trees = {}
    for doc_id, source, text in rows:
        node = sha(enc(doc_id) + enc(source) + enc(text))
        shown = sha(enc(doc_id) + enc(source) + enc(tamper(doc_id, text)))
        trees.setdefault(source, []).append((doc_id is not None, doc_id or 0, node, shown))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(trees[s]) for s in names}
    tops = [climb([x[2] for x in trees[s]], 0)[0] for s in names]
    out = []
    for k, s in enumerate(names):
        for i, (known, doc_id, node, shown) in enumerate(trees[s]):
            subroot, low = climb([x[2] for x in trees[s]], i)
            root, high = climb(tops, k)
            folded = shown
            for before, after in low + high:
                folded = sha("".join(before) + folded + "".join(after))
            out.append((doc_id if known else None, node, subroot, root, sha("".join(x for a, b in low + high for x in a + b)), folded, folded == root))
    return sorted(out, key=repr)


def lowered(spark_side):
    if spark_side:
        return {"text": F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lower("text")).otherwise(F.col("text"))}
    return lambda i, t: t.lower() if t is not None and i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else t


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("levels", [1, 2])
def test_manifest(spark, levels, few, monkeypatch):
    monkeypatch.setattr(merkle, "MAX_TREES", 50_000 if few else 0)
    rows = [*ROWS, *((i, "large", f"Text {i}") for i in range(4500)), *((i, f"s{i % 19}", f"T{i}") for i in range(5000, 5380)), *((i, "seventeen", "A") for i in range(17)), *((i, "sixteen", "A") for i in range(16))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], f"{SCHEMA}, root int")
    found = merkle.manifest(docs, ["doc_id", "source", "text"], presented=lowered(True), keep=["doc_id", "root"], block_levels=levels)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert found.columns == names
    expected = brute_manifest(rows, lowered(False))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected and {r[6] for r in expected} == {True, False}


def test_proofs_and_small_tables(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    columns = ["doc_id", "source", "text"]
    found = merkle.manifest(docs, columns, proofs=True).collect()
    assert len(found) == len(ROWS) and all(r.verified and merkle.fold(r.leaf, [p.asDict() for p in r.proof]) == r.root for r in found)
    assert merkle.manifest(docs.limit(0), columns).count() == 0
    one = merkle.manifest(docs.where("doc_id = 6"), columns).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == sha("")
