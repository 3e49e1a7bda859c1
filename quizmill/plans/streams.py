"""Streaming queries run to the end of their input; each result is a table in the shared folder."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.plans.registry import query
from quizmill.sources import tables
from quizmill.sources.keyed import KeyedTable
from quizmill.sources.places import folder
from quizmill.streaming import events


def _read(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{path}*")  # a file or a folder of files


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, and one that has nothing but a time a day after the last: it moves the watermark beyond all others."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    last, path = folder(spark, "closing"), [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name != "ts"]
    rows.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).select("ts", *path).write.parquet(last)
    closing = spark.readStream.schema(rows.schema).parquet(last)
    return _read(spark, sf_dir).unionByName(closing)


def _run(stream: DataFrame, name: str, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run with availableNow; in update mode the last row of each key stays."""
    spark = stream.sparkSession
    out, marks = folder(spark, name), folder(spark, f"{name}-marks")
    schema = stream.schema

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/part={batch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rows = spark.read.option("basePath", out).parquet(f"{out}/part=*").drop("part")
    if keys:
        columns = [c for c in schema.names if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_batch").alias("_x")).select(*keys, *(F.col(f"_x.{c}").alias(c) for c in columns))
    return rows.select(*schema.names)


def _drill(stream: DataFrame) -> DataFrame:
    return stream.select("user_id", F.get_json_object("props", "$.k").alias("item_id"), (F.col("event_id") % 3).cast("int").alias("score"), F.col("ts").cast("timestamp").cast("double").alias("ts"), F.col("event_id").alias("id"))


@query("SELECT user_id, item_id, CAST(list_reduce(list_prepend(0, list(score ORDER BY ts, id)), lambda b, s: CASE s WHEN 2 THEN least(b+1,3) WHEN 1 THEN b ELSE 0 END) AS INTEGER) AS box FROM plan_events GROUP BY 1,2", "plan_events")
def stream_boxes(spark, d):
    events.use_rocks(spark)
    return _run(events.boxes(_drill(_read(spark, d))), "boxes", "update", ["user_id", "item_id"])


@query('SELECT user_id, item_id, count(*) AS seen, count(*) FILTER (WHERE score=2) AS "right" FROM plan_events GROUP BY 1,2', "plan_events")
def stream_counters(spark, d):
    return _run(events.counters(_drill(_read(spark, d))), "counters", "update", ["user_id", "item_id"])


@query("SELECT user_id AS customer, arg_max(event_type,(ts,event_id)) AS tier FROM events GROUP BY 1")
def stream_tiers(spark, d):
    e = _read(spark, d).select(F.col("user_id").alias("customer"), F.col("event_type").alias("tier"), F.col("ts").cast("timestamp").cast("double").alias("ts"), F.col("event_id").alias("id"))
    return _run(events.tiers(e), "tiers", "update", ["customer"])


@query("SELECT user_id, item_id, arg_max(CASE WHEN score>0 THEN 'known' ELSE 'again' END, (ts,id)) AS mark FROM plan_events GROUP BY 1,2", "plan_events")
def stream_marks(spark, d):
    return _run(events.marks(_drill(_read(spark, d))), "marks", "update", ["user_id", "item_id"])


@query("SELECT event_id, event_type FROM events")
def stream_once(spark, d):
    """The stream and a replay of it: each event once."""
    e = _read(spark, d).select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return _run(events.once(e.unionByName(e), "ts", ["event_id"], "60 days"), "once", "append").select("event_id", "event_type")


TYPES = "CASE event_id%5 WHEN 0 THEN 'checkout.session.completed' WHEN 1 THEN 'customer.subscription.updated' WHEN 2 THEN 'customer.subscription.deleted' WHEN 3 THEN 'invoice.payment_failed' ELSE 'customer.subscription.created' END"


@query("SELECT event_id, CASE event_id%5 WHEN 0 THEN CASE WHEN event_id%2=0 THEN 'subscribe' ELSE 'books' END WHEN 1 THEN 'change' WHEN 2 THEN 'end' WHEN 3 THEN 'failed' ELSE 'log' END AS route FROM events")
def stream_routes(spark, d):
    k = F.col("event_id")
    kind = F.get(F.array(*map(F.lit, (*events.HANDLED, "customer.subscription.created"))), (k % 5).cast("int"))
    e = _read(spark, d).select("event_id", kind.alias("type"), F.when(k % 2 == 0, "subscription").otherwise("payment").alias("mode"))
    return _run(events.routed(e), "routes", "append").select("event_id", "route")


@query("SELECT customer, tier, n FROM (SELECT user_id AS customer, arg_max(CASE event_id%5 WHEN 2 THEN 'free' ELSE 'pro' END, (ts,event_id)) FILTER (WHERE (event_id%5=0 AND event_id%2=0) OR event_id%5 IN (1,2)) AS tier, count(*) AS n FROM events GROUP BY 1) WHERE tier IS NOT NULL")
def stream_to_sinks(spark, d):
    """One stream into two sinks: tiers by customer, and a log of all events. The first run breaks after the first sink and
    starts again from its checkpoint: nothing is doubled. Beside each tier the customer's events in the log."""
    k = F.col("event_id")
    kind = F.get(F.array(*map(F.lit, (*events.HANDLED, "customer.subscription.created"))), (k % 5).cast("int"))
    e = events.routed(_read(spark, d).select("event_id", "user_id", "ts", kind.alias("type"), F.when(k % 2 == 0, "subscription").otherwise("payment").alias("mode")))
    marks, ledger, log = folder(spark, "sinks-marks"), folder(spark, "sinks-ledger"), folder(spark, "sinks-log")
    tiers = KeyedTable(spark, folder(spark, "sinks-tiers"), ["customer"], {"tier": "last"}, "customer long, tier string, ts timestamp_ntz, event_id long", ["ts", "event_id"])

    def to_tiers(rows, batch):
        set_ = rows.where(F.col("route").isin("subscribe", "change", "end"))
        tiers.write(set_.select(F.col("user_id").alias("customer"), F.when(F.col("route") == "end", "free").otherwise("pro").alias("tier"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id"), "stream", batch)

    def to_log(rows, batch):
        rows.write.mode("overwrite").parquet(f"{log}/part={batch}")

    def broken(rows, batch):
        raise OSError("the log is away")

    for last in (broken, to_log):
        try:
            e.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(events.fan_out({"tiers": to_tiers, "log": last}, ledger)).start().awaitTermination()
        except StreamingQueryException:
            if last is to_log:
                raise
    logged = spark.read.option("basePath", log).parquet(f"{log}/part=*").groupBy(F.col("user_id").alias("customer")).agg(F.count("*").alias("n"))
    return tiers.read().join(logged, "customer").select("customer", "tier", "n")


@query("SELECT 'u'||user_id AS \"to\", CASE event_id%4 WHEN 0 THEN 'signup' WHEN 1 THEN 'subscription' ELSE 'ebook_purchase' END AS kind, CASE event_id%4 WHEN 0 THEN 'Welcome' WHEN 1 THEN 'Your plan: pro a' ELSE 'Your books: b1, b2' END AS subject FROM events WHERE event_id%4<>3 AND event_id%7<>0")
def stream_mails(spark, d):
    k = F.col("event_id")
    kind = F.get(F.array(*map(F.lit, ("signup", "subscription", "ebook_purchase", "other"))), (k % 4).cast("int"))
    body = F.to_json(F.struct(kind.alias("event"), F.when(k % 7 != 0, F.concat(F.lit("u"), "user_id")).alias("email"), F.array(F.lit("b1"), F.lit("b2")).alias("ebooks"), F.lit("pro").alias("tier"), F.lit("a").alias("app")))
    return _run(events.mails(_read(spark, d).select(body.alias("body"))), "mails", "append")


@query("SELECT CASE WHEN event_id%2=0 THEN 'signup' ELSE 'change' END AS kind, 'u'||user_id AS name, CASE WHEN event_id%2=0 THEN 'New account: u'||user_id ELSE 'UPDATE on profiles' END AS text FROM events")
def stream_changes(spark, d):
    k = F.col("event_id")
    body = F.to_json(F.struct(F.when(k % 2 == 0, "INSERT").otherwise("UPDATE").alias("type"), F.lit("profiles").alias("table"), F.struct(F.concat(F.lit("u"), "user_id").alias("id")).alias("record")))
    return _run(events.changes(_read(spark, d).select(body.alias("body"))), "changes", "append")


def _planner(rows: DataFrame) -> DataFrame:
    k = F.col("event_id")
    return rows.select("user_id", F.when(k % 3 == 0, "start").when(k % 3 == 1, "end").otherwise(F.when(k % 2 == 0, "start").otherwise("cancel")).alias("what"), F.col("event_type").alias("activity"), F.col("ts").cast("timestamp").cast("double").alias("ts"), k.alias("id"))


BLOCKS = "SELECT user_id, pa AS activity, CAST(epoch(pt) AS DOUBLE) AS started, (epoch(ts)-epoch(pt))/60 AS minutes FROM (SELECT *, lag(what) OVER w AS pw, lag(event_type) OVER w AS pa, lag(ts) OVER w AS pt FROM (SELECT *, CASE event_id%3 WHEN 0 THEN 'start' WHEN 1 THEN 'end' ELSE CASE WHEN event_id%2=0 THEN 'start' ELSE 'cancel' END END AS what FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE what='end' AND pw='start'"


@query(BLOCKS)
def stream_blocks(spark, d):
    events.use_rocks(spark)
    return _run(events.blocks(_planner(_closed(spark, d))), "blocks", "append")


@query(BLOCKS)
def planner_blocks(spark, d):
    return events.blocks_batch(_planner(tables.table(spark, d, "events")))


@query("SELECT event_id, user_id, ts FROM events")
def stream_outbox(spark, d):
    """Answers through the outbox sink, then the whole queue again as after a lost confirmation: each is stored once, and only the days of a batch are looked up."""
    out = folder(spark, "outbox")
    for attempt in ("first", "again"):
        e = _read(spark, d).select("event_id", "user_id", "ts")
        e.writeStream.option("checkpointLocation", folder(spark, "outbox-marks")).trigger(availableNow=True).foreachBatch(events.append_to(out, ["event_id"], "ts", attempt)).start().awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id", "ts")


NOTICES = "SELECT CASE WHEN event_id%2=0 THEN 'New account: u'||user_id ELSE 'UPDATE on profiles' END AS text, CASE WHEN event_id%2=0 THEN 'signup' ELSE 'change' END AS kind FROM events"


def _notices(spark, d):
    k = F.col("event_id")
    body = F.to_json(F.struct(F.when(k % 2 == 0, "INSERT").otherwise("UPDATE").alias("type"), F.lit("profiles").alias("table"), F.struct(F.concat(F.lit("u"), "user_id").alias("id")).alias("record")))
    return events.changes(_read(spark, d).select(body.alias("body"))).select(F.concat_ws("\t", "text", "kind").alias("text"), "kind", F.col("text").alias("line"))


def _sent(spark, texts, payloads):
    """Both outputs put side by side again: lines for people and the kind from the JSON for the agent."""
    sent = spark.read.text(f"{payloads}/batch=*").select(F.get_json_object("value", "$.line").alias("text"), F.get_json_object("value", "$.kind").alias("kind"))
    lines = spark.read.text(f"{texts}/batch=*").select(F.split("value", "\t")[0].alias("text"), F.split("value", "\t")[1].alias("kind"))
    return lines.intersectAll(sent)


def _send(spark, d, outputs, dead):
    _notices(spark, d).writeStream.option("checkpointLocation", folder(spark, "notice-marks")).trigger(availableNow=True).foreachBatch(events.notices_to(outputs, dead, lambda: 0)).start().awaitTermination()


@query(NOTICES)
def stream_notices(spark, d):
    """Both outputs of the notice sink."""
    texts, payloads = folder(spark, "notices"), folder(spark, "payloads")
    _send(spark, d, {"people": events.lines_to(texts), "agent": events.payloads_to(payloads)}, folder(spark, "dead"))
    return _sent(spark, texts, payloads)


@query(NOTICES)
def stream_dead_letters(spark, d):
    """The agent's inbox is down: people get their lines and the stream goes on. Once the inbox is up, a later batch of the letters completes it."""
    texts, payloads, dead = folder(spark, "notices"), folder(spark, "payloads"), folder(spark, "dead")

    def down(rows, batch):
        raise OSError("no inbox")

    _send(spark, d, {"people": events.lines_to(texts), "agent": down}, dead)
    events.drain(spark, {"agent": down}, dead, events.BACK_OFF)  # still down
    events.drain(spark, {"agent": events.payloads_to(payloads)}, dead, events.BACK_OFF * 4)
    return _sent(spark, texts, payloads)


@query("SELECT event_id FROM events WHERE event_id%3<>0 AND event_id%5<>0 AND event_id%7<>0")
def stream_verified(spark, d):
    """Events with a signature each: some are signed with another key, some for another body, some long ago."""
    k, received = F.col("event_id"), F.lit(1_700_000_000)
    at = F.when(k % 7 == 0, received - 301).otherwise(received - k % 300)
    sign = F.when(k % 3 == 0, events.signed(F.col("props"), at, "another key")).when(k % 5 == 0, events.signed(F.concat("props", F.lit(" ")), at, "whsec_mill")).otherwise(events.signed(F.col("props"), at, "whsec_mill"))
    rows = _read(spark, d).select("event_id", F.col("props").alias("body"), F.concat(F.lit("t="), at, F.lit(",v1="), F.repeat(F.lit("0"), F.lit(64)), F.lit(",v1="), sign).alias("signature"), received.alias("received"))
    return _run(events.verified(rows, "whsec_mill"), "verified", "append").select("event_id")
