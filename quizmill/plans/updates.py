"""Queries on tables that batches and streams update by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill.plans import streams
from quizmill.plans.commerce import TIER, _tier_events
from quizmill.plans.registry import query
from quizmill.sources import tables
from quizmill.sources.keyed import KeyedTable
from quizmill.sources.places import folder

PARTS = 3


def _in_parts(rows, key, table, insert=True):
    """Write the rows in batches, in another order than that of time, each batch twice as after a lost confirmation, with a compaction between."""
    for part in range(PARTS):
        some = rows.where(F.pmod(F.xxhash64(key), F.lit(PARTS)) == part)
        for _ in range(2):
            table.write(some, "batches", part, insert)
        if part == 1:
            table.compact()


@query(f"SELECT p.id, coalesce(e.tier,p.tier) AS tier FROM profiles p LEFT JOIN (SELECT o_custkey AS id, arg_max({TIER}, (l_shipdate, l_orderkey*10+l_linenumber)) AS tier FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1) e ON p.id=e.id", "profiles")
def upserted_tiers(spark, d):
    """Profiles, and the tiers that events set: the last event wins whatever batch it comes in, and unknown customers get no row."""
    table = KeyedTable(spark, folder(spark, "tiers"), ["id"], {"tier": "last"}, "id long, tier string, at timestamp_ntz, event long", ["at", "event"])
    table.write(tables.profiles(spark, d).select("id", "tier"), "profiles", 0)
    _in_parts(_tier_events(spark, d), "event", table, insert=False)
    return table.read()


@query("SELECT customer, slug, arg_min(amount,(created_at,session,line,amount)) AS amount, arg_min(session,(created_at,session,line,amount)) FILTER (line%3<>0) AS session, min(created_at) AS created_at FROM purchases GROUP BY 1,2", "purchases")
def upserted_grants(spark, d):
    """Grants by customer and book: the first stays, and the first session that is known is kept; every third line comes without one."""
    rows = tables.purchases(spark, d).withColumn("by", F.col("session")).withColumn("session", F.when(F.col("line") % 3 != 0, F.col("session")))
    table = KeyedTable(spark, folder(spark, "grants"), ["customer", "slug"], {"amount": "first", "session": "first_known", "created_at": "first"}, "customer long, slug long, amount long, session long, created_at timestamp_ntz, by long, line long", ["created_at", "by", "line"])
    _in_parts(rows, "by", table)
    return table.read()


@query("SELECT c_custkey AS id, CASE WHEN c_custkey%2=0 THEN 'new' ELSE c_name END AS display_name, CASE WHEN c_custkey%3=0 THEN 'u'||c_custkey END AS customer FROM customer")
def upserted_profiles(spark, d):
    """Updates that name some columns leave the others: names by one writer, linked customers by another, and a null is no update."""
    k, c = F.col("c_custkey"), tables.table(spark, d, "customer")
    table = KeyedTable(spark, folder(spark, "profiles"), ["id"], {"display_name": "last_known", "customer": "last_known"}, "id long, display_name string, customer string")
    table.write(c.select(k.alias("id"), F.col("c_name").alias("display_name")), "sign-up", 0)
    table.write(c.select(k.alias("id"), F.when(k % 2 == 0, "new").alias("display_name")), "names", 0, insert=False)
    table.write(c.select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("u"), k)).alias("customer")), "links", 0, insert=False)
    table.write(c.select((-1 - k).alias("id"), F.lit("nobody").alias("display_name")), "names", 1, insert=False)
    return table.read()


@query("SELECT user_id AS customer, arg_max(event_type,(ts,event_id)) AS tier FROM events GROUP BY 1")
def stream_upserts(spark, d):
    """A stream into the table, the same events again by a second stream, and half of them by a batch: the last event of each customer stays."""
    rows = lambda e: e.select(F.col("user_id").alias("customer"), F.col("event_type").alias("tier"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")
    table = KeyedTable(spark, folder(spark, "customers"), ["customer"], {"tier": "last"}, "customer long, tier string, ts timestamp_ntz, event_id long", ["ts", "event_id"])
    for writer in ("stream", "stream again"):
        rows(streams._read(spark, d)).writeStream.option("checkpointLocation", folder(spark, "customers-marks")).trigger(availableNow=True).foreachBatch(table.sink(writer)).start().awaitTermination()
    table.write(rows(tables.table(spark, d, "events")).where("event_id % 2 = 0"), "batch", 0)
    return table.read()
