"""Row security in SQL: views of the study tables that show the viewer's rows only, and the table functions over them.

The viewer is a session variable. Views read the files themselves, so that no unfiltered table has a name that SQL could use in their place,
and every function reads the views. While no viewer is set there are no rows. The filter is a comparison with a constant once a
statement is analysed, so it goes down to the scan. A statement keeps the viewer that was set when it was made.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from quizmill.sources.tables import AS_OF

NOW = f"timestamp_ntz'{AS_OF}'"

#: Own rows only; {name} stands for the file of a table.
VIEWS = {
    "responses": "SELECT event_id AS id, user_id, get_json_object(props, '$.k') AS item_id, event_type AS category, value < 60 AS correct, ts AS created_at FROM {events} WHERE user_id = session.viewer",
    "study_sessions": "SELECT o_orderkey AS id, o_custkey AS user_id, total, correct, o_orderdate AS finished_at FROM {orders} JOIN (SELECT l_orderkey, count(*) AS total, count_if(l_returnflag <> 'R') AS correct FROM {lineitem} GROUP BY 1) ON o_orderkey = l_orderkey WHERE o_custkey = session.viewer",
    "ebook_purchases": "SELECT o_custkey AS user_id, l_partkey AS ebook_slug, o_orderdate AS created_at, l_linenumber AS line FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE o_custkey = session.viewer",
    "profiles": "SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'pro' WHEN 'MACHINERY' THEN 'all_access' ELSE 'free' END AS tier, concat('app-', c_nationkey) AS tier_app, CASE WHEN c_acctbal < 0 THEN timestamp_ntz'2024-01-01 00:00:00' WHEN c_acctbal < 5000 THEN timestamp_ntz'2025-01-01 00:00:00' END AS valid_until FROM {customer} WHERE c_custkey = session.viewer",
}
SHARE = "round(count_if(correct) / CAST(greatest(count(*), 1) AS DOUBLE), 3)"

#: Signature and body of each function; of all users only figures that name nobody.
FUNCTIONS = {
    "my_category_stats() RETURNS TABLE (category STRING, total BIGINT, correct BIGINT, accuracy DOUBLE, last_seen TIMESTAMP_NTZ)": f"SELECT category, count(*), count_if(correct), {SHARE}, max(created_at) FROM responses GROUP BY category",
    "my_daily_trend() RETURNS TABLE (day DATE, total BIGINT, correct BIGINT, accuracy DOUBLE)": f"SELECT CAST(created_at AS DATE), count(*), count_if(correct), {SHARE} FROM responses WHERE created_at > {NOW} - INTERVAL 30 DAYS GROUP BY 1",
    "item_difficulty() RETURNS TABLE (item_id STRING, attempts BIGINT, difficulty DOUBLE)": "SELECT get_json_object(props, '$.k') AS item_id, count(*), round(1 - count_if(value < 60) / CAST(count(*) AS DOUBLE), 3) FROM {events} GROUP BY 1 HAVING count(*) >= 3",
    "my_sessions(lim INT DEFAULT 20) RETURNS TABLE (id BIGINT, correct BIGINT, total BIGINT, finished_at TIMESTAMP_NTZ)": "SELECT id, correct, total, finished_at FROM (SELECT *, row_number() OVER (ORDER BY finished_at DESC, id DESC) AS k FROM study_sessions) WHERE k <= my_sessions.lim",
    "my_weakest_items(lim INT DEFAULT 30) RETURNS TABLE (item_id STRING, category STRING, attempts BIGINT, misses BIGINT, miss_rate DOUBLE)": "SELECT item_id, category, attempts, misses, miss_rate FROM (SELECT *, row_number() OVER (ORDER BY miss_rate DESC, misses DESC, item_id, category) AS k FROM (SELECT item_id, category, count(*) AS attempts, count_if(NOT correct) AS misses, round(count_if(NOT correct) / CAST(count(*) AS DOUBLE), 3) AS miss_rate FROM responses GROUP BY 1, 2) WHERE misses > 0) WHERE k <= my_weakest_items.lim",
    "my_streak() RETURNS TABLE (streak BIGINT)": f"SELECT coalesce(max_by(days, last_day), 0) FROM (SELECT count(*) AS days, max(day) AS last_day FROM (SELECT day, date_sub(day, CAST(row_number() OVER (ORDER BY day) AS INT)) AS island FROM (SELECT DISTINCT CAST(created_at AS DATE) AS day FROM responses)) GROUP BY island) WHERE last_day >= date_sub(CAST({NOW} AS DATE), 1)",
    "my_tier() RETURNS TABLE (tier STRING, tier_app STRING, is_active BOOLEAN)": f"SELECT tier, tier_app, tier = 'free' OR valid_until IS NULL OR valid_until > {NOW} FROM profiles",
    "my_ebooks() RETURNS TABLE (ebooks ARRAY<BIGINT>)": "SELECT transform(array_sort(collect_list(struct(created_at, ebook_slug))), x -> x.ebook_slug) FROM (SELECT ebook_slug, min(created_at) AS created_at FROM ebook_purchases GROUP BY 1)",
    "my_ebook_count() RETURNS TABLE (n BIGINT)": "SELECT count(DISTINCT ebook_slug) FROM ebook_purchases",
    "ebook_count_for_customer(customer BIGINT) RETURNS TABLE (n BIGINT)": "SELECT count(DISTINCT l_partkey) FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE o_custkey = ebook_count_for_customer.customer",
}


def install(spark: SparkSession, sf_dir: str) -> None:
    """Make the session's variable, views and functions. Nobody is the viewer yet."""
    files = {n: f"parquet.`{sf_dir}/{n}.parquet`" for n in ("events", "orders", "lineitem", "customer")}
    spark.sql("DECLARE OR REPLACE VARIABLE viewer BIGINT DEFAULT NULL")
    for name, body in VIEWS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS {body.format(**files)}")
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body.format(**files)}")


def view_as(spark: SparkSession, user: int | None) -> None:
    """From now on statements see this user's rows; none sees nobody's."""
    spark.sql(f"SET VARIABLE viewer = {'NULL' if user is None else int(user)}")
