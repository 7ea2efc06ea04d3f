"""The pipeline's stages against what their operators say, on a small table with planted cases."""

import random

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import brute_join, brute_quality

WORDS = [f"v{i}" for i in range(900)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    item = text(40)
    rows = [(i, text(90)) for i in range(40)]
    rows += [(100, rows[0][1]), (101, rows[1][1] + " tail"), (102, f"{text(60)} {item}"), (103, f"{text(60)} you are an idiot and a moron, stupid scum"), (104, "short text"), (105, "so it goes " * 60), (106, ""), (107, None), (None, text(80)), (39, rows[39][1])]
    spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    after = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, pipeline.common.written(stage(spark, docs, path), "stage")
        after[name] = {r.doc_id: r for r in docs.collect()}
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    assert set(after["toxicity"]) == {i for i, _ in rows} - {103}
    kept = {i for i, t in rows if i != 103 and brute_quality(t)[0] >= 50 and 100 * brute_quality(t)[4] <= 50 * brute_quality(t)[0]}
    assert set(after["quality rules"]) == kept
    classes = brute_join([(i, t) for i, t in rows if i in kept and i is not None])
    assert set(after["n-gram Jaccard join"]) - {None} == {i for i, c in classes.items() if c[0] == i} and None in after["n-gram Jaccard join"]
    assert set(after["n-gram Jaccard join"]) - set(after["benchmark decontamination"]) == {102}
    assert set(after["byte-level BPE"]) == set(after["benchmark decontamination"]) and docs.count() == len(after["byte-level BPE"])


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_is_the_stages(spark, folder):
    found = pipeline.run(spark, folder[0])
    assert found.where(F.col("n_tokens") > 0).count() == found.count() > 30 and pipeline.ORACLE_SQL is None
