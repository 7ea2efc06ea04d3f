"""The seen state, its filter and buckets, quiet feeds, layers, path rules and consolidation."""

import json
import os
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from larkspur.functions.urls import build_url, dedupe_keys
from larkspur.operators import classify as C
from larkspur.operators import relational as R
from larkspur.operators import reports
from larkspur.operators import state as S
from larkspur.streaming import postings as stream


@pytest.mark.parametrize(("blocks", "hits"), [(16_384, 500_000), (1, 0)])
def test_filter_loses_no_row(spark, monkeypatch, blocks, hits):
    monkeypatch.setattr(S, "MAX_BLOCKS", blocks)
    monkeypatch.setattr(S, "MAX_HITS", hits)
    rng = random.Random(2)
    seen = [f"k{rng.randrange(40_000)}" for _ in range(12_000)] + [None]
    rows = [(i, rng.choice((None, [], [f"k{rng.randrange(60_000)}"], [f"k{rng.randrange(60_000)}", f"x{i}", None]))) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, keys array<string>")
    keys = spark.createDataFrame([(k,) for k in seen], "key string")
    known = set(seen) - {None}
    assert sorted(r.id for r in S.anti_join_seen(df, keys, "keys", "id").collect()) == [i for i, k in rows if not known & set(k or [])]
    blocks_of, n = S.key_filter(keys.where("key is not null"))
    pairs = spark.createDataFrame([(f"k{i}",) for i in range(60_000)], "key string")
    let_through = {r.key for r in S.possible(pairs, blocks_of, n).collect()}
    assert known <= let_through and (blocks == 1 or len(let_through - known) < 0.05 * 60_000)
    assert S.anti_join_seen(df, keys.limit(0), "keys", "id").count() == len(rows)


def test_legacy_state_is_found_under_its_keys_of_today(spark):
    schema = "state_key string, company string, title string, location string, url string, requisition_id string"
    state = spark.createDataFrame(
        [
            ("legacy-key", "Example", "Data Analyst", "Bengaluru", "https://example.com/en-US/jobs/12345?utm_campaign=old", None),
            ("bare-key", "Example", "Data Analyst", None, "https://example.com/jobs/777", ""),
            ("no-url", "Example", "Data Engineer", "Pune", None, None),
        ],
        schema,
    )
    c = F.col
    batch = spark.createDataFrame(
        [
            (1, "Example", "Data Analyst", "Bengaluru; Karnataka; India", "https://example.com/jobs/12345"),
            (2, "Example", "Data Analyst", "Pune", "https://example.com/jobs/777"),
            (3, "Example", "Data Engineer", "Pune", ""),
            (4, "Example", "Data Engineer", "Delhi", ""),
        ],
        "id long, company string, title string, location string, url string",
    ).withColumn("keys", dedupe_keys(c("company"), c("title"), c("location"), c("url"), F.lit("")))
    keys = S.state_keys(state)
    assert {"legacy-key", "bare-key", "no-url"} <= {r.key for r in keys.collect()}
    assert sorted(r.id for r in S.anti_join_seen(batch, keys, "keys", "id").collect()) == [2, 4]


def test_buckets(spark, tmp_path):
    path = str(tmp_path / "state")
    table = S.BucketState(spark, path, "key string, v long", "key", 8)
    assert table.read().count() == 0 and table.upsert(table.read().drop("bucket")) == []
    rows = lambda ids, v: spark.createDataFrame([(f"k{i}", v) for i in ids], "key string, v long")
    files = lambda: {f"{d}/{f}" for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    assert table.upsert(rows(range(100), 1)) == list(range(8))
    before = files()
    changed = table.upsert(rows([3, 200], 2))
    stay = {f for f in before if not any(f"bucket={b}/" in f for b in changed)}
    assert 0 < len(changed) <= 2 and stay and stay <= files() and not (before - stay) & files()
    table.upsert(rows([4, 201], 3), prefer="old")
    found = {r.key: r.v for r in table.read().collect()}
    assert len(found) == table.read().count() == 102 and (found["k3"], found["k200"], found["k4"], found["k201"]) == (2, 2, 1, 3)
    assert table.upsert(rows([3, 200], 2)) == changed and {r.key: r.v for r in table.read().collect()} == found
    assert {r.bucket for r in table.read(changed).collect()} == set(changed)


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_waiting_rows_go_out_on_a_quiet_feed(spark, tmp_path):
    """One landing of seven rows, three runs, a limit of three."""
    land(tmp_path / "in", "0.json", [{"ord": o, "keys": [f"k{o}"]} for o in range(7)])
    for k in range(4):
        land(tmp_path / "runs", f"{k}.json", [{"run": k}])
        rows = stream.posting_stream(spark, str(tmp_path / "in"), "ord long, keys array<string>", lambda d: d)
        runs = stream.posting_stream(spark, str(tmp_path / "runs"), "run long", lambda d: d)
        stream.alert_once(rows, str(tmp_path / "seen"), str(tmp_path / "out"), str(tmp_path / "check"), "keys", "ord", top=3, runs=runs, buckets=4).awaitTermination()
    sent = {(r.batch, r.ord) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sent == {(0, 0), (0, 1), (0, 2), (1, 3), (1, 4), (1, 5), (2, 6)}


def test_carry_over_of_many_keys(spark, tmp_path):
    """Two landings and a quiet run: whole numbers beyond a float's, nulls and rows without a key come out as they went in, in order of rank."""
    rng = random.Random(6)
    big = 2**53 + 1
    rows = [(rng.choice((None, *range(40))), big + i, rng.choice((None, big)), rng.choice((0.5, 1.5)), f"2024-01-01 00:00:00.{i:06d}") for i in range(400)]
    schema = "k long, id long, note long, value double, at timestamp, run timestamp"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k in range(3):
        now = f"2024-02-01 0{k}:00:00"
        land(tmp_path / "in", f"{k}.json", [dict(zip(("k", "id", "note", "value", "at", "run"), (*r, now), strict=True)) for r in rows[k * 200 : k * 200 + 200]] if k < 2 else [])
        land(tmp_path / "runs", f"{k}.json", [{"run": now}])
        stream_of = lambda name, s: stream.posting_stream(spark, str(tmp_path / name), s, lambda d: d)
        found = stream.carry_over(stream_of("in", schema), stream_of("runs", "run timestamp"), "k", ["value", "id"], 2)
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    spark.conf.set(provider, before)
    expected, waiting = [], {}
    for k in range(3):
        for r in rows[k * 200 : k * 200 + 200] if k < 2 else []:
            waiting.setdefault(r[0], []).append(r)
        for key, of in waiting.items():
            of.sort(key=lambda r: (r[3], r[1]))
            expected += [(*r, f"2024-02-01 0{k}:00:00") for r in of[:2]]
            waiting[key] = of[2:]
    sent = [(r.k, r.id, r.note, r.value, r.at.strftime("%Y-%m-%d %H:%M:%S.%f"), str(r.run)) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(sent, key=repr) == sorted(expected, key=repr)


def test_deliver_by_runs(spark, tmp_path):
    """As carry_over, without state of keys: two landings and two quiet runs, of which the last is run again; only the last two keep rows that wait."""
    rng = random.Random(6)
    big = 2**53 + 1
    rows = [(rng.choice((None, *range(40))), big + i, rng.choice((None, big)), rng.choice((0.5, 1.5)), f"2024-01-01 00:00:00.{i:06d}") for i in range(400)]
    schema = "k long, id long, note long, value double, at timestamp, run timestamp"
    stream_of = lambda name, s: stream.posting_stream(spark, str(tmp_path / name), s, lambda d: d)
    for k in (0, 1, 2, 3, 3):
        now = f"2024-02-01 0{k}:00:00"
        land(tmp_path / "in", f"{k}.json", [dict(zip(("k", "id", "note", "value", "at", "run"), (*r, now), strict=True)) for r in rows[k * 200 : k * 200 + 200]] if k < 2 else [])
        land(tmp_path / "runs", f"{k}.json", [{"run": now}])
        if (tmp_path / "c" / "commits" / "3").exists():  # as if it had failed at its end
            (tmp_path / "c" / "commits" / "3").unlink()
            (tmp_path / "c" / "commits" / ".3.crc").unlink(missing_ok=True)
        found = stream.deliver_by_runs(stream_of("in", schema), stream_of("runs", "run timestamp"), "k", ["value", "id"], 2, str(tmp_path / "out"), str(tmp_path / "c"))
        found.awaitTermination()
        assert found.lastProgress is None or not found.lastProgress["stateOperators"]
    expected, waiting = [], {}
    for k in range(4):
        for r in rows[k * 200 : k * 200 + 200] if k < 2 else []:
            waiting.setdefault(r[0], []).append(r)
        for key, of in waiting.items():
            of.sort(key=lambda r: (r[3], r[1]))
            expected += [(*r, f"2024-02-01 0{k}:00:00", k) for r in of[:2]]
            waiting[key] = of[2:]
    sent = stream.delivered(spark, str(tmp_path / "out"), schema).collect()
    assert sorted(((r.k, r.id, r.note, r.value, r.at.strftime("%Y-%m-%d %H:%M:%S.%f"), str(r.run), r.batch) for r in sent), key=repr) == sorted(expected, key=repr)
    assert sorted(p.parent.name for p in (tmp_path / "out").glob("batch=*/sent=false")) == ["batch=2", "batch=3"]


def test_daily_notice_on_a_quiet_feed(spark, tmp_path):
    """A source that failed once and is silent since is reported again a day later, by the clock alone."""
    day = 86_400
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    land(tmp_path / "in", "0.json", [{"source": "s", "run": day, "failed": "a"}, {"source": "t", "run": day, "failed": ""}])
    for k, now in enumerate((day, day + day // 2, 2 * day + 60)):
        land(tmp_path / "clock", f"{k}.json", [{"run": now}])
        runs = stream.posting_stream(spark, str(tmp_path / "in"), "source string, run long, failed string", lambda d: d)
        clock = stream.posting_stream(spark, str(tmp_path / "clock"), "run long", lambda d: d)
        found = stream.notice_stream(runs, day, clock)
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    spark.conf.set(provider, before)
    sent = {(r.source, r.run, r.kind, r.failed) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sent == {("s", day, "issues", "a"), ("t", day, "daily", ""), ("s", 2 * day + 60, "issues", "a"), ("t", 2 * day + 60, "daily", "")}


def test_layers_are_the_chain_of_layers(spark):
    rng = random.Random(4)
    fields = ("a", "b", "c")
    row = lambda n: (f"{rng.choice('nN')}{n}", *(rng.choice((None, rng.randrange(99))) for _ in fields), rng.sample(fields, rng.randrange(4)))
    tables = [[row(n) for n in rng.sample(range(40), 25)] for _ in range(11)]
    frames = [spark.createDataFrame(t, "name string, a int, b int, c int, present array<string>") for t in tables]
    for named in (True, False):
        expected = {r[0].lower(): dict(zip(fields, r[1:4], strict=True)) for r in tables[0]}
        for t in tables[1:]:
            for r in t:
                mine = expected.setdefault(r[0].lower(), dict.fromkeys(fields))
                mine.update({f: v for f, v in zip(fields, r[1:4], strict=True) if (f in r[4] if named else v is not None)})
        base = frames[0].drop("present")
        found = R.overlay(base, *frames[1:], key="name", present="present" if named else None)
        assert {r.name.lower(): {f: r[f] for f in fields} for r in found.collect()} == expected
        assert found.columns == base.columns
    nameless = spark.createDataFrame([(None, 1), (None, 2)], "name string, a int")
    assert R.overlay(nameless, nameless.limit(0), key="name").count() == 2


def test_numbers_of_equal_rows(spark):
    df = spark.createDataFrame([(1,)] * 500 + [(0,)] * 3 + [(None,)], "k int").repartition(6)
    assert sorted((r.n, r.k) for r in R.numbered(df, ["k"], "n").collect()) == [(1, None), *((i, 0) for i in (2, 3, 4)), *((i, 1) for i in range(5, 505))]
    assert R.numbered(df.limit(0), ["k"], "n").count() == 0


@pytest.mark.parametrize("most", [100_000, 0])
def test_path_rules(spark, monkeypatch, most):
    monkeypatch.setattr(C, "MAX_RULES", most)
    rules = [(3, "path", "/Jobs/", "jobs", {"tenant": "{label}"}), (2, "path", "x", "x", None), (1, "path", "zz", "zz", None), (5, "host", "a.org", "host", None), (4, "name", "Acme", "name", None), (9, "path", "/jobs/more", "more", None), (0, "path", "", "never", None)]
    rows = [("https://b.a.org/jobs/more", "q", "jobs"), ("https://a.org/xyz", "acme", "x"), ("https://c.org/JOBS/zz/", "acme", "zz"), ("https://c.org/", "ACME", "name"), ("https://c.org", None, "direct_job_html"), (None, None, "direct_job_html")]
    found = C.classify_sources(spark.createDataFrame(rows, "url string, name string, expected string"), spark.createDataFrame(rules, C.RULE_SCHEMA), "name", "url").collect()
    assert len(found) == len(rows) and [(r.url, r.ats) for r in found if r.ats != r.expected] == []
    assert C.classify_sources(spark.createDataFrame(rows, "url string, name string, expected string"), spark.createDataFrame([], C.RULE_SCHEMA), "name", "url").where("ats = 'direct_job_html'").count() == len(rows)


def test_path_rules_have_few_lookups(spark, monkeypatch):
    """Numbers of which no run of twelve characters is one rule's own: each rule is found by its whole word, and no run of a path is looked up."""
    monkeypatch.setattr(C, "MAX_RULES", 0)
    numbers = [f"1{a:03}0000000000{b:03}" for a in range(20) for b in range(20)]
    rules = spark.createDataFrame([(i, "path", f"/{n}-", n, None) for i, n in enumerate(numbers)], C.RULE_SCHEMA)
    index = C.indexed_rules(rules)
    assert index.groupBy("__key").count().agg({"count": "max"}).first()[0] == 1 and index.where("startswith(__key, 'path:')").count() == 0
    urls = spark.createDataFrame([(f"https://x.org/a/{n}-{i % 7}/apply", "x", n) for i, n in enumerate(numbers)], "url string, name string, expected string")
    assert C.classify_sources(urls, rules, "name", "url").where("ats <=> expected").count() == len(numbers)


@pytest.mark.parametrize("most", [100_000, 0])
def test_path_rules_in_turns(spark, monkeypatch, most):
    """Lookups in turns give what one turn gives, and what they shuffle is gone when they are done (but for counts)."""
    monkeypatch.setattr(C, "MAX_RULES", most)
    numbers = [f"{i * 7919:07}" for i in range(2000)]
    extra = [(900, "host", "a.org", "host", {"site": "{origin}"}), (901, "name", "Acme", "name", None), (902, "path", "jobs", "jobs", None), (0, "path", f"/{numbers[1]}-", "earlier", None)]
    rules = spark.createDataFrame([(i + 1, "path", f"/{n}-", n, None) for i, n in enumerate(numbers)] + extra, C.RULE_SCHEMA)
    rows = [(f"https://x.org/a/{n}-1/{numbers[i - 1]}-x/apply", "q", "earlier" if 0 < i < 3 else numbers[max(0, i - 1)] if i else n) for i, n in enumerate(numbers)]
    rows += [("https://b.a.org/x", "q", "host"), ("https://b.org/x", "ACME", "name"), ("https://b.org/jobs", "acme", "name"), ("https://b.org/jobs", None, "jobs"), ("host:a.org", "host:a.org", "direct_job_html"), (None, None, "direct_job_html")]
    df = spark.createDataFrame(rows, "url string, name string, expected string").repartition(3)
    local = spark.sparkContext.getConf().get("spark.local.dir")
    files = lambda: {f: f.stat().st_size for f in Path(local).rglob("shuffle_*.data")}
    monkeypatch.setattr(C, "stored", lambda *parts, **how: (counts.append(len(parts)), R.stored(*parts, **how))[1])
    for turn in (5000, 500):
        monkeypatch.setattr(C, "TURN", turn)
        counts, before = [], files()
        found = C.classify_sources(df, rules, "name", "url")
        time.sleep(3)  # files are removed after the job
        left = sum(size for f, size in files().items() if f not in before)
        print("left", left)
        assert left < 10_000 and max(counts) == -(-len(rows) // turn)
        got = found.collect()
        assert len(got) == len(rows) and [(r.url, r.name, r.ats, r.expected) for r in got if r.ats != r.expected] == []
        assert {r.attrs["site"] for r in got if r.ats == "host"} == {"https://b.a.org"}


def test_index_of_rules_with_one_pattern(spark):
    """Of rules with one kind and pattern the index has the first, and addresses are looked up by the kinds of keys that it has."""
    patterns = (("path", "/one/"), ("path", "two"), ("host", "a.org"), ("name", "Acme"))
    rules = [(i, kind, pattern, f"r{i}", None) for kind, pattern in patterns for i in range(30, 20, -1)]
    index = C.indexed_rules(spark.createDataFrame(rules, C.RULE_SCHEMA)).collect()
    assert sorted((r["__key"], r.rule.priority) for r in index) == [("host:a.org", 21), ("name:acme", 21), ("path:two", 21), ("word:/one", 21)]
    low = spark.createDataFrame([(1, "https://x.org/one/two/three", "Acme")], "__id long, url string, name string")
    asked = lambda *kinds, lengths=(): sorted(r.key for r in C.keys_of(low, "name", "url", set(kinds), list(lengths)).collect())
    assert asked() == [] and asked("word") == ["word:/one", "word:/two"] and asked("name", "host") == ["host:org", "host:x.org", "name:acme"]
    assert asked("path", lengths=[12, 13]) == sorted("path:" + "/one/two/three"[i : i + n] for n in (12, 13) for i in range(15 - n))


def test_consolidation_fails_on_conflicts(spark):
    aliases = spark.createDataFrame([("b", "A"), ("c", "C")], "alias string, canonical string")
    rows = lambda *r: spark.createDataFrame(r, "name string, ord long, identity string, terms array<string>")
    run = lambda df: R.consolidated(df, aliases, "name", "ord", "identity", ["terms"])
    found = {r.canonical: (r.ord, r.identity, r.terms) for r in run(rows(("A", 2, "x", ["t"]), ("B", 1, "x", ["u", "t"]), ("c", 3, None, None))).collect()}
    assert found == {"A": (1, "x", ["u", "t"]), "C": (3, None, [])}
    with pytest.raises(Exception, match="conflicting identities of A"):
        run(rows(("A", 1, "x", []), ("b", 2, "y", []))).collect()
    with pytest.raises(Exception, match="another name has the identity of"):
        run(rows(("A", 1, "x", []), ("c", 2, "x", []))).collect()


def test_reports(spark):
    runs = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("a", 3, None), ("a", 4, None), ("b", 1, None)], "source string, run int, failed int")
    assert sorted((r.source, r.run, r.changed) for r in reports.changes(runs, "source", "run", "failed").collect()) == [("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", 4, False), ("b", 1, True)]
    names = spark.createDataFrame([("A",), ("b",), (None,)], "name string")
    assert sorted(str(r.name) for r in R.without_names(names, "name", names.where("name = 'b'"), names.where("name = 'x'")).collect()) == ["A", "None"]
    listed = R.with_deferred(names, spark.createDataFrame([("b", "later")], "name string, status string"), "name").collect()
    assert {(r.name, r.enabled, r.status) for r in listed} == {("A", True, None), ("b", False, "later"), (None, True, None)}
    assert reports.top_rows(names.limit(0), ["name"], 3).count() == 0 and reports.top_rows(names, ["name"], 2).first().remaining == 1
    row = spark.createDataFrame([("x/", None, 5)], "base string, a string, b int").select(build_url(F.col("base"), [F.lit("p"), F.col("b")], {"a": F.col("a"), "b": F.col("b")}).alias("u"), build_url("x", [F.col("b")]).alias("v"), build_url("x", [F.col("a")]).alias("w")).first()
    assert tuple(row) == ("x/p/5?b=5", "x/5", None)


def test_clean_shared(spark):
    table = R.stored(spark.range(3))
    assert table.count() == 3
    R.clean_shared(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST|FAILED_READ"):
        table.collect()
    assert R.stored(spark.range(3)).count() == 3
