"""The training-data operators against brute force, round trips and hostile inputs."""

import collections
import hashlib
import random
import re
import zlib
from functools import partial
from html import unescape

import duckdb
import numpy as np
import public_tokenizers
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from larkspur.llm import bpe, common, decontam, html_text, lm, ngram_join, quality_rules, queries, token_counts, token_output, toxicity, url_filters

BIG = 2**62 + 1
WORDS = [f"w{i}" for i in range(400)]
ODD = ["", None, " ", "one", "a  b\n\n c\t\x0b", "Émile’s café — 日本語 🙂", "x" * 5000, "the the the the the the", "it's <|endoftext|> we'll", "a b c " * 9000, "\n" * 50]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, very long texts, and columns named like outputs."""
    rows = [(BIG + i if i % 3 else i, t, 7, "x") for i, t in enumerate(ODD)] + [(1, "one", 7, "x"), (1, "one", 7, "x"), (None, "no id", 7, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, score string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, DATA, "documents").select("doc_id", "text")


def ids_of(df):
    return collections.Counter(r.doc_id for r in df.select("doc_id").collect())


def test_url_filters(spark, same):
    same(queries.queries()["op1_url_filters"], queries.OP1_SQL)
    urls = [None, "", "no scheme", "http://NET/x", "http://a.net", "http://a.net/", "https://x.example.net/en/1?q#f", "https://EXAMPLE.com/de/", "http://org/fr/x", "http://myexample.com/de/", "https://ads.x.com/", "https://x.com/login?a", "http://x.net/"]
    rows = url_filters.judge_urls(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(12, "http://x.net/", "h")], "page_id int, url string, host string"))
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows.collect()}
    assert rows.count() == len(urls) + 1
    assert found[0] == found[1] == found[2] == ("", "", None, "allow")
    assert found[3] == ("net", "/x", "net/", "block") and found[4] == ("a.net", "", None, "allow") and found[5][3] == "block"
    assert found[6] == ("x.example.net", "/en/1", "example.net/en/", "allow") and found[7] == ("example.com", "/de/", "example.com/de/", "block")
    assert found[8][2:] == ("org/fr/", "allow") and found[9][2:] == (None, "allow") and found[10][3] == found[11][3] == "block"
    assert url_filters.judge_urls(spark.createDataFrame([], "url string")).count() == 0
    ties = (url_filters.list_rule("a.net/", "allow"), url_filters.list_rule("a.net/", "block"))
    long = spark.createDataFrame([("http://a.net/" + "x/" * 500_000,)], "url string")
    r = url_filters.judge_urls(long, list_rules=ties).first()
    assert r.verdict == "block" and len(r.path) == 1_000_001


@pytest.mark.parametrize("max_rules", [0, 2, 17])
def test_url_filters_by_shuffle(spark, same, max_rules):
    """More rules than are broadcast, some without a token, some stored under a token that every URL has."""
    keep = lambda s, sf: url_filters.judge_urls(common.table(s, sf, "pages").select("page_id", "url"), keep=["page_id"], max_rules=max_rules)
    same(keep, queries.OP1_SQL)
    rules = (*url_filters.PATTERN_RULES, *(url_filters.pattern_rule(f"free{i}", rf"/{i}+$", ()) for i in range(5)), url_filters.pattern_rule("often", "com/zz", ("com",)))
    urls = spark.createDataFrame([(i, f"http://h{i % 7}.com/{'zz' if i % 11 == 0 else i}") for i in range(300)] + [(1, None), (1, None)], "page_id long, url string")
    judge = lambda m: collections.Counter(url_filters.judge_urls(urls, pattern_rules=rules, max_rules=m).collect())
    assert judge(max_rules) == judge(1000) and sum(judge(max_rules).values()) == 302


def test_bpe_equals_the_library(spark, odd, none, docs):
    codec = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    for r in bpe.encode(odd.union(docs.select("*", F.lit(7), F.lit("x"))), chunk_chars=50).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == codec.encode_ordinary(r.text or "") and r.n_tokens == len(ids) and r.decoded == (r.text or "").encode() and r.score == "x"
    assert ids_of(bpe.encode(odd)) == ids_of(odd) and bpe.encode(none).count() == 0


def test_token_counts_equal_the_library(spark, odd, none, docs):
    sp, _ = token_counts.processor(public_tokenizers.path(token_counts.MODEL))
    for chunk, overlap in ((1 << 16, 512), (300, 8)):
        for r in token_counts.count_tokens(odd, chunk_chars=chunk, overlap=overlap, limit=5).collect():
            assert r.n_tokens == len(sp.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 5)
    for r in token_counts.count_tokens(docs, chunk_chars=700, overlap=4).collect():
        assert r.n_tokens == len(sp.encode(r.text))
    assert ids_of(token_counts.count_tokens(odd)) == ids_of(odd) and token_counts.count_tokens(none).count() == 0


def test_token_files(spark, odd, none, docs, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_output.TOKENIZER))
    for df, folder in ((odd, "odd"), (docs, "docs")):
        out = f"file://{tmp_path}/{folder}"
        shards = token_output.write_tokens(df, out, frame_bytes=4096, cache_pieces=50)
        found = sorted(token_output.read_tokens(spark, out, shards).collect(), key=lambda r: r.start)
        expected = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        assert [r.doc_id for r in found] == [i for i, _ in expected]
        start = 0
        for r, (_, text) in zip(found, expected, strict=True):
            ids = [*library.encode(text, add_special_tokens=False).ids, 2]
            assert (r.start, r.n_tokens) == (start, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
            start += len(ids)
    wanted = token_output.read_tokens(spark, out, shards, [3, 5]).collect()
    assert {r.doc_id for r in wanted} == {3, 5} and {r.start for r in wanted} == {r.start for r in found if r.doc_id in (3, 5)}
    assert token_output.read_tokens(spark, out, token_output.write_tokens(none, f"file://{tmp_path}/none")).count() == 0
    file = shards[0][0]
    data = bytearray(open(file, "rb").read())
    with open(file, "rb") as f:
        reader = token_output.ShardReader(f)
        reader.frames = reader.frames.copy()
        reader.frames[0, 2] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            reader.frame_data(0)
    assert data[-4:] == (token_output.SEEKABLE_MAGIC).to_bytes(4, "little")


@pytest.mark.parametrize("max_windows", [decontam.MAX_WINDOWS, 0])
def test_decontamination(spark, same, none, monkeypatch, max_windows):
    monkeypatch.setattr(decontam, "find_contamination", partial(decontam.find_contamination, max_windows=max_windows))
    same(queries.queries()["op5_decontamination"], queries.OP5_SQL)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(1, text(30)), (2, text(5)), (3, None), (4, ""), (5, text(13))]
    items.append((6, items[1][1].upper()))
    bench = spark.createDataFrame(items, "item_id long, text string")
    body = f"{text(2100)} {items[0][1]}, {text(100)} {items[1][1].upper()}!? {text(60)}"
    rows = [(1, body), (2, None), (3, ""), (4, items[1][1]), (5, text(40)), (1, body), (6, f"{text(2040)} {items[4][1]} {text(2040)}")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, items string")
    found = decontam.find_contamination(df, bench)
    by = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(rows) and by[1].n_hit == 35 and by[1].items == ["1", "2", "6"] and by[1].n_words == 2295
    assert [(s["first"], s["end"]) for s in by[1].spans] == [(2100, 2130), (2230, 2235)]
    assert by[2].n_words == by[3].n_words == 0 and by[4].n_hit == 5 and by[5].n_hit == 0 and by[6].n_hit == 13
    cut = found.where("doc_id = 4").select(decontam.remove_spans(F.col("text"), F.col("spans")).alias("t")).first()
    assert cut.t == ""
    left = found.where("doc_id = 1").select(decontam.remove_spans(F.col("text"), F.col("spans")).alias("t")).first().t
    assert len(left.split()) == 2260 and items[0][1] not in left
    assert decontam.find_contamination(none, bench).count() == 0 and decontam.find_contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0


def shingle_sets(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset(), " ".join(w)


def brute_join(rows):
    classes = collections.defaultdict(list)
    for i, t in rows:
        classes[shingle_sets(t)[1]].append(i)
    reps = {min(v): shingle_sets(k)[0] for k, v in classes.items()}
    links = collections.defaultdict(set)
    for a, x in reps.items():
        for b, y in reps.items():
            if a < b and x and y and len(x & y) >= 0.8 * len(x | y):
                links[a].add(b)
                links[b].add(a)
    out = {}
    for members in classes.values():
        rep = min(members)
        seen, todo = {rep}, [rep]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        for m in members:
            out[m] = (min(seen), rep, len(links[rep]))
    return out


@pytest.mark.parametrize("block", [256, 8])
def test_ngram_join_equals_brute_force(spark, block):
    rng = random.Random(5)
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(30, 120))]
        for _ in range(rng.randrange(1, 14)):
            copy = [rng.choice(WORDS) if rng.random() < 0.008 else w for w in base]
            rows.append((n, " ".join(copy) if n % 5 else "  ".join(copy).upper()))
            n += 1
    rows += [(1000, ""), (1001, None), (1002, "one two"), (1003, "ONE two"), (1004, "three"), (1005, rows[0][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    found = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in ngram_join.near_duplicates(df, block=block).collect()}
    assert found == brute_join(rows)


def test_ngram_join_counts_each_link_of_groups(spark):
    rng = random.Random(17)
    rows, groups = [], []
    for _ in range(250):
        base = [f"w{rng.randrange(5000)}" for _ in range(104)]
        groups.append(range(len(rows), len(rows) + rng.randrange(3, 7)))
        for k in range(len(groups[-1])):
            at = rng.randrange(5, 99) if k else -1  # one other word: 0.90 to the base, from 0.82 to other copies
            rows.append((len(rows), " ".join("other" + str(k) if i == at else w for i, w in enumerate(base))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = df.select("doc_id", ngram_join.word_hashes(F.col("text")).alias("hashes"))
    keys = {r.doc_id: set(r["keys"]) for r in ngram_join.with_keys(hashed, 5, 0.8, 12, 3, 3, 0.999).collect()}
    sets, unmet = [shingle_sets(t)[0] for _, t in rows], collections.Counter()  # links whose texts share no key
    for group in groups:
        for a in group:
            unmet[a] = sum(a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and not keys[a] & keys[b] for b in group)
    expected = {i: (c, copy, n - unmet[i]) for i, (c, copy, n) in brute_join(rows).items()}
    found = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()}
    assert found == expected and sum(unmet.values()) <= 0.001 * sum(n for _, _, n in expected.values())


def test_ngram_forest_lengths():
    lengths = {m: ngram_join.prefix_length(ngram_join.least_similarity(m, 0.8), 12, 8, 0.999) for m in range(1, 60)}
    for m in range(1, 40):  # by hand: all pairs of sizes
        found = [i / (m + k - i) for k in range(1, 60) for i in range(1, min(m, k) + 1) if i >= 0.8 * (m + k - i) - 1e-9]
        assert ngram_join.least_similarity(m, 0.8) == pytest.approx(min(found))
        assert 1 - (1 - min(found) ** lengths[m]) ** 12 >= 0.999 and (lengths[m] == 8 or 1 - (1 - min(found) ** (lengths[m] + 1)) ** 12 < 0.999)
    assert lengths[3] == 8 and lengths[5] == 3 and lengths[7] == 5 and len(set(lengths.values())) > 3


def test_ngram_forest_recall(spark):
    """Pairs at just about 0.8, and small sets of all sizes: nine of ten at the least are linked."""
    rng = random.Random(23)
    rows, expected = [], 0
    for k in range(600):
        m = rng.randrange(4, 12) if k % 3 else 45
        base = [f"w{rng.randrange(10**6)}" for _ in range(m + 4)]
        more = m // 4 if m > 11 else rng.randrange(1, 3)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + [f"x{k}-{i}" for i in range(more)]))]
        expected += m >= 0.8 * (m + more) - 1e-9
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links = 1").count()
    assert 0.98 * 2 * expected <= found <= 2 * expected and expected > 300


def test_ngram_join_hostile(spark, odd, none):
    found = ngram_join.near_duplicates(odd)
    assert ids_of(found) == ids_of(odd) and ngram_join.near_duplicates(none).count() == 0
    by = collections.defaultdict(list)
    for r in found.collect():
        by[r.doc_id].append((r.class_id, r.copy_id, r.n_links))
    ids = [BIG + i if i % 3 else i for i in range(len(ODD))]
    assert by[1] == [(1, 1, 0)] * 2 and by[ids[3]] == [(1, 1, 0)]  # the text "one" under three ids
    assert by[None] == [(None, None, 0)]  # the only row of its text
    assert {by[ids[k]][0][:2] for k in (0, 1, 2, 10)} == {(0, 0)}  # texts without words are copies of each other
    body = " ".join(f"v{i}" for i in range(60))
    rows = [(5, body), (5, "another text of the same id"), (6, body + " end"), (None, body), (7, "another text of the same id"), (4, None)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, copy string, n_links int")
    found = collections.Counter((r.doc_id, r.class_id, r.copy_id, r.n_links) for r in ngram_join.near_duplicates(df).collect())
    assert found == collections.Counter([(5, 5, 5, 1), (5, 5, 5, 0), (6, 5, 6, 1), (None, 5, 5, 1), (7, 5, 5, 0), (4, 4, 4, 0)])


def test_ngram_join_meets_rows_without_ids_by_their_texts(spark, monkeypatch):
    """Of 300 near copies without an id and 300 under one id, each text meets its own row, not all rows of the same id."""
    body = [f"v{i}" for i in range(80)]
    rows = [(k, " ".join([*body, f"{k}-{i}"])) for k in (None, 7) for i in range(300)]
    sizes = {}
    written = ngram_join.common.written

    def kept(df, name):
        sizes[name] = written(df, name)
        return sizes[name]

    monkeypatch.setattr(ngram_join.common, "written", kept)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.near_duplicates(df).groupBy("class_id", "n_links").count().collect()
    assert [tuple(r) for r in found] == [(7, 599, 600)] and sizes["texts"].count() == 600
    docs = df.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("body")).withColumn("id", F.coalesce("id", "body"))
    assert docs.join(sizes["wanted"], ["id", "body"]).count() == 600


def test_ngram_forest_stops_where_shortening_brings_nobody(spark, monkeypatch):
    """Pairs at several similarities: where a text's prefix stops follows from whom it shares its prefixes with, and no pair is lost."""
    rng, rows = random.Random(8), []
    for i in range(400):
        body = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        rows.append((2 * i, " ".join(body)))
        for k in range(rng.randrange(0, 3)):
            body[20 + 30 * k] = f"x{i}-{k}"
        rows.append((2 * i + 1, " ".join([*body, "end"])))
    stops, made = [], ngram_join.buckets_of

    def kept(inside):
        found = made(inside)
        stops.extend((r.rep, r.depth) for r in found.collect())
        walk = collections.defaultdict(dict)
        for r in inside.collect():
            walk[r.rep, r.tree][r.depth] = (r.texts, r.open, r.node)
        expected = []
        for (rep, _), nodes in walk.items():
            floor = min((d for d, x in nodes.items() if x[1]), default=None)
            at = max(nodes)
            while floor is not None and at > floor and any(nodes[d][0] > nodes[at][0] for d in range(floor, at)):
                at -= 1
            if floor is not None:
                expected.append((rep, at, nodes[at][2]))
        assert sorted(expected) == sorted((r.rep, r.depth, r.bucket) for r in found.collect())
        return found

    monkeypatch.setattr(ngram_join, "buckets_of", kept)
    found = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = {i: c[2] for i, c in brute_join(rows).items()}
    assert sum(found.values()) >= 0.98 * sum(expected.values()) and all(found[i] <= n for i, n in expected.items())
    texts = collections.defaultdict(set)
    for rep, depth in stops:
        texts[rep].add(depth)
    lengths, shortest = collections.Counter(d for _, d in stops), collections.Counter(min(d) for d in texts.values())
    assert set(lengths) == set(range(3, 9)) and max(lengths.values()) <= 0.8 * len(stops)
    assert max(shortest.values()) <= 0.8 * len(texts) and sum(len(d) > 1 for d in texts.values()) >= 0.5 * len(texts)


def brute_quality(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_statistics(spark, odd, docs, none):
    texts = docs.select("text").union(odd.select("text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in quality_rules.measure(texts).collect():
        assert tuple(r[n] for n in names) == brute_quality(r.text)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    judged = quality_rules.judge(odd.withColumn("kept", F.lit(1)), labels)
    assert ids_of(judged) == ids_of(odd) and judged.where("kept and base_failed").count() == 0 and quality_rules.judge(none, labels).count() == 0


def test_decision_list_learns_and_prunes():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    bad = ((x[:, 0] > 0.8) & (x[:, 1] < 0.5)) | (x[:, 2] > 0.95)
    rules = quality_rules.learn_rules(x, bad, names=("a", "b", "c"))
    caught = np.zeros(len(x), bool)
    for r in rules:
        caught |= quality_rules.meets(x, [("abc".index(f), at_least, t) for f, at_least, t in r.conditions])
    assert (caught == bad).mean() > 0.98 and len(rules) <= 4
    noise = quality_rules.learn_rules(rng.random((2000, 3)), rng.random(2000) < 0.3, names=("a", "b", "c"))
    assert not noise


def test_quality_on_labels(spark):
    docs, labels = common.table(spark, DATA.replace("sf0.001", "sf0.01"), "documents"), common.table(spark, DATA.replace("sf0.001", "sf0.01"), "labels")
    judged = quality_rules.judge(docs, labels, keep=["doc_id"]).join(labels, "doc_id").where(~F.col("base_failed")).cache()
    good, lost = judged.where("quality = 1").count(), judged.where("quality = 1 and not kept").count()
    assert lost <= 0.03 * good
    # the rules reject what the base leaves of the bad rows; a list without rules rejects none
    bad, caught = judged.where("quality = 0").count(), judged.where("quality = 0 and not kept").count()
    assert bad >= 20 and caught >= 0.9 * bad and judged.where("not kept and rule is null").count() == 0
    judged.unpersist()


def test_learned_rules_by_hand(spark):
    """Every row's verdict is that of the first learned rule whose thresholds its statistics meet, taken row by row in Python."""
    docs, labels = common.table(spark, DATA, "documents"), common.table(spark, DATA.replace("sf0.001", "sf0.01"), "labels")
    rules = quality_rules.fit(common.table(spark, DATA.replace("sf0.001", "sf0.01"), "documents"), labels)
    assert rules
    rows = quality_rules.judge(docs, labels, rules=rules).collect()
    met = lambda r, rule: all(r[f] >= t if at_least else r[f] <= t for f, at_least, t in rule.conditions)
    for r in rows:
        first = next((k for k, rule in enumerate(rules, 1) if met(r, rule)), 0)
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert (r.rule, r.base_failed, r.kept) == (first, failed, not failed and not first)
    assert any(r.rule for r in rows) and len(rows) == docs.count()


def test_toxicity_clauses():
    g = toxicity.Grammar({"idiot": 3.0, "stupid": 2.5}, {"moro": 3.0})
    taken = lambda t: [dict(zip(toxicity.NAMES, p.tolist(), strict=True)) for p in g.clauses(t)]
    none = g.score(None)
    assert none == g.score("") == g.score("a plain text") < 0.1 and not taken("a plain text")
    assert none < g.score("idiot") < g.score("You idiot") < g.score("You complete idiot") < 1
    assert g.score("idiot") > 0.5 and taken("You are a moronic person")[0]["aimed"] == 1 and taken("idiot, you")[0]["aimed"] == 1
    for calm in ("He is not an idiot", "Nobody stupid is here.", "He said the boss was an idiot", "I will not hurt you", "She said that I will hurt you", "Never hurt you, he will"):
        assert g.score(calm) == none, calm
    assert g.score("I will hurt you") > g.score("You idiot") and taken("You. An idiot")[0]["aimed"] == 0
    assert g.score("idiot. idiot") > g.score("idiot") and g.score("Not an idiot. You idiot") == g.score("You idiot")
    assert taken("a " * 200_000 + "idiot")[0]["lexical"] == 3


def test_toxicity_composition():
    """The composed machine is the cascade of its machines, path by path."""
    one, two = toxicity.insults(), toxicity.scope("negation", 2, "negated")
    both = toxicity.compose(one, two)

    def paths(m, symbols):
        states = [(m.start, (), ())]
        for c in symbols:
            states = [(n, out + (z,), names + f) for s, out, names in states for n, z, f in m.arcs[s, c]]
        return sorted((out, names) for s, out, names in states if s in m.final)

    rng = random.Random(1)
    for _ in range(100):
        symbols = [rng.choice(toxicity.SYMBOLS) for _ in range(5)]
        cascade = [(out, f + g) for y, f in paths(one, symbols) for out, g in paths(two, y)]
        assert [(out, sorted(f)) for out, f in paths(both, symbols)] == sorted((out, sorted(f)) for out, f in cascade)


def test_best_path_is_the_best_of_all_paths():
    """The weight of a clause's best path is the largest of all paths through the five machines, listed one by one."""
    machines = [toxicity.insults(), toxicity.scope("negation", 2, "negated"), toxicity.scope("report", 6, "reported"), toxicity.targets(), toxicity.threats()]
    rng = random.Random(5)
    hot = {"idiot": 3.0, "fool": 1.5}
    words = ["idiot", "fool", "you", "not", "said", "will", "kill", "so", "word"]
    classes = {w: "insult" if w in hot else toxicity.KNOWN.get(w, "other") for w in words}

    def listed(tokens, weights):
        found = [(tuple(classes[w] for w in tokens), ())]
        for m in machines:
            after = []
            for symbols, names in found:
                states = [(m.start, (), names)]
                for c in symbols:
                    states = [(n, out + (z,), taken + f) for s, out, taken in states for n, z, f in m.arcs[s, c]]
                after += [(out, taken) for s, out, taken in states if s in m.final]
            found = after
        lexical = lambda out: weights[1] * sum(hot[w] for w, z in zip(tokens, out, strict=True) if z == "insult")
        return max(lexical(out) + sum(weights[toxicity.NAMES.index(n)] for n in names) for out, names in found)

    for _ in range(400):
        weights = toxicity.PRIOR if rng.random() < 0.5 else np.array([rng.uniform(a, b) for a, b in zip(toxicity.LOW, toxicity.HIGH, strict=True)])
        tokens = rng.choices(words, k=rng.randint(1, 7))
        path = toxicity.Grammar(hot, {}, weights).best_path(tokens, hot)
        assert (0.0 if path is None else path[1:] @ weights[1:]) == pytest.approx(max(0.0, listed(tokens, weights))), tokens


def test_toxicity_held_out(spark, odd, none):
    sf = DATA.replace("sf0.001", "sf0.1")
    labels = common.table(spark, sf, "labels")
    held = queries.fold("doc_id", 5) == 0
    grammar = toxicity.fit(common.table(spark, sf, "documents"), labels.where(~held))
    assert (grammar.weights >= toxicity.LOW).all() and (grammar.weights <= toxicity.HIGH).all()
    texts = common.table(spark, sf, "documents").select("doc_id", "text").join(labels.where(held), "doc_id")
    rows = toxicity.score(texts, grammar).select("text", "toxic", "predicted", "score").collect()
    assert sum(r.toxic == r.predicted for r in rows) >= 0.95 * len(rows)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    # clean held-out texts with one more sentence: a match of words alone would flag all of them
    clean = [r.text for r in rows if not r.toxic and not r.predicted][:200]
    flagged = lambda sentence: sum(grammar.score(f"{t}\n{sentence}\n{t}") >= 0.5 for t in clean) / len(clean)
    assert flagged("You are an idiot.") == flagged("You moron!") == flagged("I will hurt you.") == 1
    assert flagged("He is not an idiot.") == flagged("They said he was an idiot.") == flagged("This is no moron.") == 0
    found = toxicity.score(odd, toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int")))
    assert ids_of(found) == ids_of(odd) and dict(found.dtypes)["score"] == "double" and toxicity.score(none, grammar).count() == 0


def test_toxicity_query_holds_out_rows_without_an_id_from_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (None, "you idiot")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.doc_id: r for r in queries.op4_toxicity(spark, str(tmp_path)).collect()}
    assert found[None].held_out is False and found[None].predicted == 1 and found[1].predicted == 0


PAGES = {
    "<p>a&amp;b <b>c</b><br>d</p><p> </p><p>e": "a&b c d\ne",
    "<nav><a href=x>menu</a></nav><article><header><h1>T</h1></header><p>x</p><aside>side</aside><p>y</p><section class='reader-comments'><p>hi</p></section></article><footer>f</footer>": "T\nx\ny",
    "<div class=cookie-notice>ok?</div><div><h1>Head of it</h1><p>A text that is long enough to count as dense.</p><form><label>q</label><input></form><p>end of it all here.</p></div>": "Head of it\nA text that is long enough to count as dense.\nend of it all here.",
    "<html><head><title>t</title><style>p{}</style></head><body><script>var a='<p>no</p>';</script><article><p>only": "only",
    "<table><tr><td>a</td><td>b</td></tr></table>": "a\nb",
}


def test_html(spark):
    for html, text in PAGES.items():
        assert html_text.main_text(html) == text
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "<p>é🙂", "t"), (3, "<p>é🙂", "t")], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()) == [(1, "", 0), (2, "", 0), (3, "é🙂", 2), (3, "é🙂", 2)]
    assert html_text.extract(df.limit(0)).count() == 0


def article_lines(html):
    """The blocks of the article element of a generated page, by pattern."""
    body = re.sub(r"</?(?:b|i|em)>", "", re.search(r"(?s)<article>(.*)</article>", html)[1])
    blocks = (" ".join(unescape(re.sub(r"<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(x for x in blocks if x)


def test_html_over_all_pages():
    """Every page of the table: the article's text, with and without its element; threshold and smoothing make it."""
    pages = [r[0] for r in duckdb.sql(f"SELECT html FROM '{DATA.replace('sf0.001', 'sf0.01')}/pages.parquet'").fetchall()]
    bare = [re.sub(r"</?article>", "", h) for h in pages]
    texts = [article_lines(h) for h in pages]
    assert [html_text.main_text(h) for h in pages] == texts and [html_text.main_text(h) for h in bare] == texts
    changed = lambda **how: sum(html_text.main_text(h, **how) != t for h, t in zip(bare, texts, strict=True))
    assert changed(share=0) == len(pages) and changed(sigma=0) > 0.05 * len(pages)
    assert sum(html_text.main_text(h, share=0) != t for h, t in zip(pages, texts, strict=True)) == len(pages)  # it drops the menus beside an article


def test_html_regions():
    long = "A paragraph of the article that is long enough to count. " * 3
    rows = lambda n, text: "".join(f"<p>{text}</p>" for _ in range(n))
    text = html_text.main_text
    unequal = f"<div><div>{rows(6, long)}</div><div>{rows(3, long)}<p>Short.</p></div></div>"
    assert text(unequal).count("\n") == 9 and text(unequal).endswith("\nShort.")
    assert text(f"<ul><li><a href=a>Home</a> | <a href=b>News</a></ul>{rows(2, long)}<ul><li><a href=c>Next</a></ul>").count("\n") == 1
    assert text(f"<div>{rows(3, long)}<nav>In <a href=x>this</a> page</nav>{rows(3, long)}</div>").count("\n") == 5
    assert text(f"<p>{long}<p><a href=x>only a link</a><p>{long}").count("\n") == 2
    assert text(f"<article>{rows(3, long)}</article><div>Some words</div><article>{rows(2, long)}</article>").count("\n") == 4
    assert text(f"<h1><a href=/>Title</a></h1>{rows(2, long)}").startswith("Title\n")
    # an article stays whole
    short = "".join(f"<p>Short {i}.</p>" for i in range(14))
    assert text(f"<article>{rows(3, long)}{short}{rows(3, long)}</article>").count("Short") == 14
    assert text(f"<article>{rows(3, long)}<p><a href=x>Read the source</a></p></article>").endswith("\nRead the source")
    assert text(f"<article><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul>{rows(3, long)}</article>").startswith("One\nTwo\n")
    assert text(f"<nav><a href=x>no</a></nav><article>{rows(9, long)}</article><article><p>A second one.</p></article><p><a href=x>no</a></p>").endswith("\nA second one.")
    kept = "".join(f"<p class='{c}'>{c}</p>" for c in ("social-studies", "alert-level", "related", "ad-hoc", "top"))
    gone = "".join(f"<div class='{c}'>no</div>" for c in ("ad", "ad-slot", "x cookie-notice", "site-footer", "comment_list", "menu", "sidebar2"))
    assert text(f"<article>{rows(2, long)}{kept}{gone}{rows(2, long)}</article>").count("\n") == 8 and "no" not in text(f"<article>{rows(2, long)}{gone}</article>").split()
    assert text(f"<div class=site-header><p>{long}</p></div><div id=top><div class=entry-header><h1>Head of it</h1></div>{rows(2, long)}</div>").count("\n") == 2
    # articles in elements that are left out: comments and teasers go, an element that isn't closed takes none with it
    comments = f"<section class=comments><article class=comment><p>{long}</p></article><article><p>{long}</p></article></section>"
    assert text(f"<main><h1>Head</h1><article>{rows(2, long)}{comments}</article>{comments}</main>").count("\n") == 1
    assert text(f"<aside><article>{rows(1, 'teaser ' * 30)}</article></aside><article>{rows(2, long)}</article>").count("teaser") == 0
    assert text(f"<body><div class=ad>buy<article>{rows(2, long)}</article></body>").count("\n") == 1
    assert text(f"<div><div class=ad>buy<article>{rows(2, long)}</article></div>").count("\n") == 1
    assert text(f"<main>{rows(2, long)}<p>Short.</p></main>").endswith("\nShort.")
    deep = "<div>" * 30_000 + long + "</i>" * 30_000
    assert text(deep) == long.strip() and len(text(f"<p>{'word ' * 1_000_000}</p>")) == 4_999_999 and text(rows(20_000, "x")).count("x") == 20_000


def test_language_model(spark, odd, none, docs):
    train, held = docs.where("doc_id % 7 <> 2"), docs.where("doc_id % 7 = 2")
    model = lm.train(train, own=100, endings=20, head=500)
    counts = collections.Counter(t for r in train.collect() for t in lm.tokens_of(r.text))
    n, v, vocabulary, p = sum(counts.values()), len(counts), model.vocabulary, model.parameters
    assert (model.n_tokens, vocabulary.n_distinct, vocabulary.own, len(vocabulary.endings)) == (n, v, len(vocabulary.head_counts[:100]), 20)
    own = {t.encode(): i + 21 for t, i in vocabulary.head.items() if i < 100}
    unit = lambda t: own.get(t) or vocabulary.endings.get(t[-2:], 0)
    spaces = collections.Counter(dict.fromkeys(range(21), 1))  # an unseen token of each class
    for t, c in counts.items():
        spaces[unit(t)] += c + 1
    share = lambda t: 1.0 if t in own else (counts[t] + 1) / spaces[unit(t)]
    # all tokens and an unseen one of each class have the whole probability of each unit
    whole = collections.Counter({k: 1 / spaces[k] for k in range(21)})
    for t in counts:
        whole[unit(t)] += share(t)
    assert all(x == pytest.approx(1) for x in whole.values()) and len(whole) == 121
    base = model_sum = 0.0
    for r in lm.score(held, model).collect():
        tokens = lm.tokens_of(r.text)
        assert r.n_tokens == len(tokens) and r.n_known == sum(t in counts for t in tokens)
        assert r.base_score == pytest.approx(sum(np.log10((counts[t] + 1) / (n + v + 1)) for t in tokens))
        units, expected = [121, 121, *map(unit, tokens)], 0.0
        for i, t in enumerate(tokens):
            logits = (p.scale[0] * p.context[units[i + 1]] + p.scale[1] * p.context[units[i]]) @ p.out.T + p.bias
            expected += np.log10(share(t)) + (logits[units[i + 2]] - np.log(np.exp(logits).sum())) / np.log(10)
        assert r.score == pytest.approx(expected, rel=1e-4)
        base, model_sum = base + r.base_score, model_sum + r.score
    assert model_sum > base
    assert ids_of(lm.score(odd, model)) == ids_of(odd) and lm.score(none, model).count() == 0
    unseen = lm.train(none)
    empty = lm.score(odd.select("doc_id", "text"), unseen).collect()
    assert all(r.n_known == 0 for r in empty) and {r.score for r in empty if not r.text} == {0.0}
    assert lm.score(odd, model).columns == ["doc_id", "text", *lm.OUTPUTS] and dict(lm.score(odd, model).dtypes)["score"] == "double"


def test_language_model_held_out(spark):
    rows = queries.op2_language_model(spark, DATA.replace("sf0.001", "sf0.01")).where("held_out").collect()
    base, model = sum(r.base_score for r in rows), sum(r.score for r in rows)
    assert model >= 0.95 * base  # both negative: at least a twentieth fewer digits


def test_language_model_trains_on_every_position(spark):
    """a stands at the even positions alone, b and the end at the odd ones; all texts are one batch of one task."""
    texts = spark.createDataFrame([(" ".join("ab"[i % 2] for i in range(99)),)] * 1000, "text string").coalesce(1)
    r = lm.score(texts.limit(1), lm.train(texts)).first()
    assert r.n_tokens == 100 and r.base_score / 100 < -0.25 and r.score / 100 > -0.1


def test_digests(spark):
    rows = queries.op10_byte_bpe(spark, DATA).join(common.table(spark, DATA, "documents").select("doc_id", "text"), "doc_id").collect()
    assert all(r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in rows)
    out = {r.doc_id: r for r in queries.op3_token_output(spark, DATA).collect()}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_output.TOKENIZER))
    for r in rows:
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 2]
        assert out[r.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and out[r.doc_id].n_tokens == len(ids)


def test_places_of_hashes_with_equal_upper_bits(spark):
    """Hashes that differ only below the bits that are sorted: those found once are no repeats, wherever they lie."""
    rows = [(0, [64, 65, 64, 66, -1, -2, -64, 65, 3], 16), (1, [5, 5, 5], 4), (2, [7], 2), (3, None, 1), (4, [64, 65, 66], 4), (5, [], 1), (6, [-(2**63), 2**63 - 1, -(2**63), 0], 8)]
    found = quality_rules.repeated_places(spark.createDataFrame(rows, "id int, hashes array<long>, span long"))
    expected = {i: None if h is None else [k for k, x in enumerate(h) if h.count(x) > 1] for i, h, _ in rows}
    assert {r.id: r.places for r in found.collect()} == expected and found.columns == ["id", "places"]
    words = "a b c a b c d e f a b c".split() * 3 + [f"w{i}" for i in range(3000)] + ["a", "b", "c"]
    text = spark.createDataFrame([(1, " ".join(words))], "doc_id int, text string")
    assert quality_rules.measure(text).first().n_repeat_words == brute_quality(" ".join(words))[4]


def test_language_model_counts_in_parts(spark):
    """A task that gives its counts on after a few tokens counts as one that holds all, and no row is made for each token."""
    texts = [None, "", "A b\tb", "b c  Ä ä", "c " * 50] * 3
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    expected = collections.Counter(t for text in texts for t in [*(w.decode() for w in (text or "").encode().lower().split()), ""])
    for distinct in (1, 3, 1000):
        counted = lm.count_tokens(df, distinct=distinct)
        assert {r.token: r.c for r in counted.collect()} == expected
    assert "Generate" not in counted._jdf.queryExecution().executedPlan().toString()


def test_language_model_step():
    """A step of whole tables is the plain one, with repeated tokens and contexts: rows without a gradient stay."""
    rng = np.random.default_rng(3)
    counts = np.array([9, 5, 3, 2, 1, 1, 1, 1])
    start = lm.Parameters.start(counts, 4)
    target, one, two = (rng.integers(0, 6, 20) for _ in range(3))
    trainer = lm.Trainer(start, counts + 1, seed=7, samples=5)
    trainer.step(target, one, two)
    noise = (counts + 1) / (counts + 1).sum()
    drawn = np.searchsorted(np.cumsum(noise), np.random.default_rng(7).random(5))
    gradient = lm.Parameters(*(np.zeros(x.shape) for x in (start.out, start.bias, start.context, start.scale)))
    for t, i, j in zip(target, one, two, strict=True):
        a, b = start.context[i], start.context[j]
        q = start.scale[0] * a + start.scale[1] * b
        logit = lambda u: q @ start.out[u] + start.bias[u] - np.log(5 * noise[u])  # noqa: B023, E731
        dq = np.zeros(4)
        for u, slope in [(t, 1 / (1 + np.exp(logit(t)))), *((u, -1 / (1 + np.exp(-logit(u)))) for u in drawn)]:
            gradient.out[u] += slope * q / 20
            gradient.bias[u] += slope / 20
            dq += slope * start.out[u] / 20
        gradient.context[i] += start.scale[0] * dq
        gradient.context[j] += start.scale[1] * dq
        gradient.scale[0] += a * dq
        gradient.scale[1] += b * dq
    expected = start.flat() + 0.1 * gradient.flat() / np.sqrt(0.01 + gradient.flat() ** 2)
    assert np.allclose(trainer.p.flat(), expected, atol=1e-5)
