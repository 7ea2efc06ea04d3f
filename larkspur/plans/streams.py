"""Queries of the incremental operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import relational as R
from larkspur.operators.reports import fresh
from larkspur.operators.scoring import score_postings
from larkspur.plans.base import Tables, query
from larkspur.plans.scoring import STEPS, postings
from larkspur.plans.text import CLEAN
from larkspur.sources.payloads import Mapping, flat_items
from larkspur.streaming import postings as P


def event_rows(t: Tables) -> DataFrame:
    keys = F.array(F.concat(F.lit("u"), F.col("user_id").cast("string"), "event_type", "props"))
    return t.events.select("event_id", "ts", keys.alias("keys"))


#: Descriptions and departments as they come out of a payload.
LANDED = STEPS.replace("|| ' ' || text AS body, source AS department", "|| ' ' || text AS raw, " + CLEAN.format("source") + " AS department").replace("FROM documents)", "FROM documents), j AS (SELECT * EXCLUDE (raw), " + CLEAN.format("raw") + " AS body FROM i)").replace("WITH j AS", "WITH i AS")


@query("t1_posting_stream", LANDED + "SELECT doc_id::VARCHAR AS requisition_id, cascade.score AS score FROM f WHERE cascade.score >= 70")
def t1(t: Tables) -> DataFrame:
    """Payloads landed in two runs, read as a stream: items, lanes and threshold by micro-batch, to a table."""
    folder = f"{R.shared_folder(t.spark)}/t1-{uuid.uuid4().hex}"
    rows = postings(t)
    record = F.struct("title", "location", "description", "department", F.col("doc_id").cast("string").alias("id"))
    feeds = rows.groupBy(F.floor(F.col("doc_id") / 20).alias("feed")).agg(F.to_json(F.struct(F.collect_list(record).alias("jobs"))).alias("body"))  # twenty rows
    paths = {f: (f"$.{f}",) for f in ("title", "location", "description", "department")} | {"requisition_id": ("$.id",)}

    def scored(raw: DataFrame) -> DataFrame:
        items = flat_items(raw, Mapping("$.jobs", paths)).withColumn("priority", (F.col("requisition_id").cast("long") % 6).cast("int"))
        return score_postings(items).where("score >= 70").select("requisition_id", "score")

    for run in (0, 1):
        feeds.where(F.col("feed") % 2 == run).write.mode("append").json(f"{folder}/landed")
        stream = P.posting_stream(t.spark, f"{folder}/landed", "feed long, body string", scored)
        writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("requisition_id string, score int").parquet(f"{folder}/out")


@query(
    "t2_alert_once",
    """WITH k AS (SELECT event_id, ts, 'u' || user_id || event_type || props AS key FROM events), f AS (SELECT key, min(event_id) AS event_id FROM k GROUP BY 1)
    SELECT event_id FROM f""",
)
def t2(t: Tables) -> DataFrame:
    """Two runs, split by time (so by id): the second delivers what the first didn't."""
    rows = event_rows(t)
    cut = F.lit("2024-01-16").cast("timestamp")
    none = t.spark.createDataFrame([], "key string")
    first = P.new_rows(rows.where(F.col("ts") < cut), none, "keys", "event_id")
    second = P.new_rows(rows.where(F.col("ts") >= cut), first.select(F.explode("keys").alias("key")), "keys", "event_id")
    return first.union(second).select("event_id")


@query("t2_alert_stream", "WITH k AS (SELECT event_id, 'u' || user_id || event_type || props AS key FROM events) SELECT key, min(event_id) AS event_id FROM k GROUP BY 1")
def t2_stream(t: Tables) -> DataFrame:
    """Two runs of the stream: the second reads the buckets of its keys, delivers what is new and rewrites these buckets."""
    folder = f"{R.shared_folder(t.spark)}/t2-{uuid.uuid4().hex}"
    rows = event_rows(t)
    cut = F.lit("2024-01-16").cast("timestamp")
    for run in (rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut)):
        run.select("event_id", "keys").write.mode("append").json(f"{folder}/landed")
        stream = P.posting_stream(t.spark, f"{folder}/landed", "event_id long, keys array<string>", lambda d: d)
        P.alert_once(stream, f"{folder}/seen", f"{folder}/out", f"{folder}/checkpoint", "keys", "event_id").awaitTermination()
    sent = t.spark.read.schema("event_id long, keys array<string>").parquet(f"{folder}/out")
    return sent.select(F.col("keys")[0].alias("key"), "event_id")


#: Days are landed five at a time; one alert key a user and type, met once in each landing; every fiftieth lands ten days late.
LANDINGS = """r AS (SELECT 'u' || user_id || event_type AS key, ts, CASE WHEN event_id % 50 = 0 THEN least(day(ts) // 5 + 2, 6) ELSE day(ts) // 5 END AS landing FROM events),
    l AS (SELECT key, landing, min(epoch_us(ts)) AS us FROM r GROUP BY ALL)"""


def landings(t: Tables) -> tuple[str, str]:
    """The folder in which the landings lie as a file each, in order, and the schema of their rows."""
    folder = f"{R.shared_folder(t.spark)}/t2-{uuid.uuid4().hex}"
    part = F.floor(F.dayofmonth("ts") / 5).cast("int")
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"), "event_type")
    rows = t.events.select(key.alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 50 == 0, F.least(part + 2, F.lit(6))).otherwise(part).alias("landing"))
    rows = R.stored(rows.groupBy("key", "landing").agg(F.min("ts").alias("ts")))
    for k in range(7):  # one after the other, so that a stream meets them in order
        rows.where(F.col("landing") == k).coalesce(1).write.mode("append").parquet(folder)
    return folder, rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")


def landed(t: Tables, transform) -> DataFrame:
    """What a stream over the landings, one a batch, emits."""
    folder, schema = landings(t)
    stream = transform(t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    writer = stream.writeStream.format("parquet").option("path", f"{folder}-out").option("checkpointLocation", f"{folder}-checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}-out")


@query("t2_single_key", f"WITH {LANDINGS} SELECT key, min(landing)::INTEGER AS landing FROM l GROUP BY 1")
def t2_single(t: Tables) -> DataFrame:
    """Alerts with one key, as streaming state over seven batches."""
    return landed(t, lambda s: P.first_alerts(s, "key")).select("key", "landing")


@query(
    "t2_bounded",
    f"""WITH RECURSIVE {LANDINGS}, w AS (SELECT landing, coalesce(max(max(us)) OVER (ORDER BY landing ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 0) // 1000 * 1000 - 604800000000 AS mark FROM l GROUP BY 1),
    n AS (SELECT key, landing, us, mark, row_number() OVER (PARTITION BY key ORDER BY landing) AS i FROM l JOIN w USING (landing) WHERE us > mark),
    s AS (SELECT key, 0::BIGINT AS i, NULL::BIGINT AS landing, NULL::BIGINT AS us, NULL::BIGINT AS until, false AS sent FROM (SELECT DISTINCT key FROM n)
      UNION ALL SELECT n.key, n.i, n.landing, n.us, CASE WHEN s.until > n.mark THEN s.until ELSE n.us + 604800000000 END, NOT coalesce(s.until > n.mark, false) FROM s JOIN n ON n.key = s.key AND n.i = s.i + 1)
    SELECT key, landing::INTEGER AS landing, us FROM s WHERE sent""",
)
def t2_bounded(t: Tables) -> DataFrame:
    """Alerts again after seven days: the watermark bounds the state, and rows later than it are left out."""
    return landed(t, lambda s: P.recent_alerts(s, "key", "ts", "7 days")).select("key", "landing", F.unix_micros("ts").alias("us"))


@query(
    "t3_notices",
    """WITH RECURSIVE g AS (SELECT user_id::VARCHAR AS source, epoch(date_trunc('hour', ts))::BIGINT AS run, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'error' ELSE '' END AS failed, min(event_id) % 4 <> 0 AS delivered FROM events GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run) AS i FROM g),
    s AS (SELECT source, 0::BIGINT AS i, NULL::BIGINT AS run, NULL::VARCHAR AS failed, NULL::VARCHAR AS kind, '' AS before, NULL::BIGINT AS last FROM (SELECT DISTINCT source FROM n)
      UNION ALL SELECT n.source, n.i, n.run, n.failed, k.kind, CASE WHEN k.kind IS NOT NULL AND n.delivered THEN n.failed ELSE s.before END, CASE WHEN k.kind IS NOT NULL AND n.delivered THEN n.run ELSE s.last END
      FROM s JOIN n ON n.source = s.source AND n.i = s.i + 1,
      LATERAL (SELECT CASE WHEN n.failed = s.before AND s.last IS NOT NULL AND n.run - s.last < 86400 THEN NULL WHEN n.failed <> '' THEN 'issues' WHEN s.before <> '' THEN 'recovered' ELSE 'daily' END AS kind) k)
    SELECT source, run, kind, failed FROM s WHERE kind IS NOT NULL""",
)
def t3(t: Tables) -> DataFrame:
    """Runs by hour; the delivery of every fourth notice fails, so that the next run tries again."""
    runs = t.events.groupBy(F.col("user_id").cast("string").alias("source"), F.unix_seconds(F.date_trunc("hour", "ts")).alias("run"))
    failed = F.when(F.count_if(F.col("event_type") == "error") > 0, "error").otherwise("")
    return P.notices(runs.agg(failed.alias("failed"), (F.min("event_id") % 4 != 0).alias("delivered")))


@query("t4_carry_over", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n > 5")
def t4(t: Tables) -> DataFrame:
    """What the first run's limit of five a source leaves is new for the next one."""
    sent = R.in_chunks(t.events.withColumn("rank", F.struct(-F.col("value"), "event_id")), "user_id", "rank", "event_id", 5).where("chunk = 0")
    return t.events.join(sent.select(F.explode("values").alias("event_id")).hint("merge"), "event_id", "left_anti").select("user_id", "event_id")


@query(
    "t4_quiet_feed",
    "SELECT user_id, event_id, (n - 1) // 5 AS run FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS n FROM events WHERE event_type <> 'view') WHERE n <= 20",
)
def t4_quiet(t: Tables) -> DataFrame:
    """One landing of all events, then three runs in which nothing lands: each delivers five more of every user."""
    folder = f"{R.shared_folder(t.spark)}/t4-{uuid.uuid4().hex}"
    began = F.lit("2024-02-01").cast("timestamp")
    hour = lambda k: began + F.make_interval(hours=F.lit(k))
    schema = "user_id long, event_id long, value double, run timestamp"
    for k in range(4):
        rows = t.events.where("event_type <> 'view'").select("user_id", "event_id", "value", hour(0).alias("run"))
        rows.where(F.lit(k == 0)).write.mode("append").parquet(f"{folder}/landed")
        t.spark.range(1).select(hour(k).alias("run")).write.mode("append").parquet(f"{folder}/runs")
        stream = t.spark.readStream.schema(schema).parquet(f"{folder}/landed")
        runs = t.spark.readStream.schema("run timestamp").parquet(f"{folder}/runs")
        P.deliver_by_runs(stream, runs, "user_id", ["value", "event_id"], 5, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    out = P.delivered(t.spark, f"{folder}/out", schema)
    return out.select("user_id", "event_id", ((F.unix_seconds("run") - F.unix_seconds(began)) / 3600).cast("long").alias("run"))


@query(
    "t5_reconcile",
    "WITH m AS (SELECT user_id, max(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), g AS (SELECT user_id, max(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT user_id, v FROM m UNION ALL SELECT user_id, v FROM g WHERE user_id NOT IN (SELECT user_id FROM m)",
)
def t5(t: Tables) -> DataFrame:
    side = lambda k: t.events.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.max("value").alias("v"))
    return R.merge_state(side(0), side(1), "user_id", "old")


@query("t6_fresh_events", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY")
def t6(t: Tables) -> DataFrame:
    return fresh(t.events, "ts", F.lit("2024-01-20").cast("timestamp"), 7).select("event_id")
