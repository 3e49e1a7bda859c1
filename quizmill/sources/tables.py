"""Schemas of the study tables, and these tables as views over the driver's star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment at which queries look at the data; they never read the clock.
AS_OF = "2024-01-30 23:59:59"

RESPONSES = "id long, user_id string, item_id string, category string, correct boolean, answer_idx short, time_ms int, session_id long, created_at timestamp"
SESSIONS = "id long, user_id string, length int, correct int, total int, config string, started_at timestamp, finished_at timestamp"
PROFILES = "id string, display_name string, created_at timestamp, updated_at timestamp, tier string, stripe_customer_id string, stripe_subscription_id string, tier_valid_until timestamp, tier_app string"
PURCHASES = "id string, user_id string, ebook_slug string, stripe_customer_id string, stripe_session_id string, amount_cents int, currency string, created_at timestamp"

#: The same definitions for DuckDB. Each is the body of a view.
SQL = {
    "responses": "SELECT event_id AS id, user_id, json_extract_string(props,'$.k') AS item_id, event_type AS category, value<60 AS correct, event_id%4 AS answer_idx, ts AS created_at FROM events",
    "study_sessions": "SELECT o_orderkey AS id, o_custkey AS user_id, count(*) AS total, count(*) FILTER (WHERE l_returnflag<>'R') AS correct, o_orderdate AS finished_at FROM orders JOIN lineitem ON o_orderkey=l_orderkey GROUP BY ALL",
    "bank": "SELECT p_partkey AS id, p_type AS cat, p_brand AS sub, p_name AS stem, p_partkey%4 AS answer, p_size AS n FROM part",
    "answers": "SELECT DISTINCT l_orderkey AS session_id, l_partkey AS id, min(l_linenumber)%4 AS picked FROM lineitem GROUP BY l_orderkey, l_partkey",
    "purchases": "SELECT o_custkey AS customer, l_partkey AS slug, l_orderkey AS session, l_linenumber AS line, CAST(floor(l_extendedprice*100+0.5) AS BIGINT) AS amount, o_orderdate AS created_at FROM lineitem JOIN orders ON l_orderkey=o_orderkey",
    "profiles": "SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'pro' WHEN 'MACHINERY' THEN 'all_access' ELSE 'free' END AS tier, 'app-'||c_nationkey AS tier_app, CASE WHEN c_acctbal<0 THEN TIMESTAMP '2024-01-01 00:00:00' WHEN c_acctbal<5000 THEN TIMESTAMP '2025-01-01 00:00:00' END AS valid_until FROM customer",
    "plan_events": "SELECT event_id AS id, user_id, json_extract_string(props,'$.k') AS item_id, event_type AS activity, event_id%3 AS score, least(50.0, value) AS minutes, 1+event_id%5 AS focus, ts FROM events",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per answer."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "user_id", F.get_json_object("props", "$.k").alias("item_id"), F.col("event_type").alias("category"), (F.col("value") < 60).alias("correct"), (F.col("event_id") % 4).alias("answer_idx"), F.col("ts").alias("created_at"))


def study_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") != "R").alias("correct"))
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), "total", "correct", F.col("o_orderdate").alias("finished_at"))


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("cat"), F.col("p_brand").alias("sub"), F.col("p_name").alias("stem"), (F.col("p_partkey") % 4).alias("answer"), F.col("p_size").alias("n"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was picked for each question of a session."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("id")).agg((F.min("l_linenumber") % 4).alias("picked"))


#: Purchases that one task of a join should hold at most.
LINES = 500_000


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    parts = -(-lines.count() // LINES)  # from the files' footers
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):  # more tasks, not larger ones
        lines, orders = lines.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("customer"), F.col("l_partkey").alias("slug"), F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("line"), F.floor(F.col("l_extendedprice") * 100 + 0.5).alias("amount"), F.col("o_orderdate").alias("created_at"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg, bal = F.col("c_mktsegment"), F.col("c_acctbal")
    tier = F.when(seg == "BUILDING", "pro").when(seg == "MACHINERY", "all_access").otherwise("free")
    until = F.when(bal < 0, F.expr("timestamp_ntz'2024-01-01 00:00:00'")).when(bal < 5000, F.expr("timestamp_ntz'2025-01-01 00:00:00'"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), tier.alias("tier"), F.concat(F.lit("app-"), F.col("c_nationkey")).alias("tier_app"), until.alias("valid_until"))


def plan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drill scores and study blocks."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "user_id", F.get_json_object("props", "$.k").alias("item_id"), F.col("event_type").alias("activity"), (F.col("event_id") % 3).alias("score"), F.least(F.lit(50.0), F.col("value")).alias("minutes"), (1 + F.col("event_id") % 5).alias("focus"), "ts")


def owned_by(rows: DataFrame, viewer, column: str = "user_id") -> DataFrame:
    """Row-level security: a viewer's own rows only."""
    return rows.where(F.col(column) == viewer)


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """At most one row by key."""
    return rows.where(F.col(key) == value).limit(1)
