"""Queries on purchases and subscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill.operators import commerce
from quizmill.plans.registry import query
from quizmill.sources import tables
from quizmill.sources.tables import AS_OF

TIER = "CASE l_linenumber%3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'all_access' END"


def _tier_events(spark, d):
    e = tables.table(spark, d, "lineitem").join(tables.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.col("l_linenumber") % 3
    return e.select(F.col("o_custkey").alias("id"), F.col("l_shipdate").alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event"), F.when(n == 0, "free").when(n == 1, "pro").otherwise("all_access").alias("tier"))


@query(f"SELECT p.id, coalesce(e.tier,p.tier) AS tier, e.tier IS NOT NULL AS changed FROM profiles p LEFT JOIN (SELECT o_custkey AS id, arg_max({TIER}, (l_shipdate, l_orderkey*10+l_linenumber)) AS tier FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1) e ON p.id=e.id", "profiles")
def set_tiers(spark, d):
    events = _tier_events(spark, d).withColumn("at", F.struct("at", "event")).select("id", "at", "tier")
    return commerce.set_tiers(tables.profiles(spark, d).select("id", "tier"), events, "id", "at", "tier")


@query("SELECT o_orderkey AS request, o_custkey AS email, u.user_id FROM orders LEFT JOIN (SELECT s_nationkey AS email, min(s_suppkey) AS user_id FROM supplier GROUP BY 1) u ON o_custkey=u.email")
def linked_customers(spark, d):
    asked = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("email"))
    return commerce.linked(asked, tables.table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("email"), F.col("s_suppkey").alias("id")))


@query("SELECT customer, slug, arg_min(amount,(created_at,session,line,amount)) AS amount, arg_min(session,(created_at,session,line,amount)) AS session, min(created_at) AS created_at, count(*) AS events FROM purchases GROUP BY 1,2", "purchases")
def granted_ebooks(spark, d):
    return commerce.granted(tables.purchases(spark, d))


@query("SELECT customer, slug FROM purchases WHERE customer NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal>0)", "purchases")
def rejected_grants(spark, d):
    users = tables.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("customer"))
    return commerce.rejected(tables.purchases(spark, d), users).select("customer", "slug")


@query("SELECT session, slug, line, row_number() OVER (PARTITION BY session, slug ORDER BY created_at, line)>1 AS replay FROM purchases", "purchases")
def replayed_purchases(spark, d):
    return commerce.replayed(tables.purchases(spark, d)).select("session", "slug", "line", "replay")


@query(f"SELECT id, CASE WHEN id%2=0 THEN 'new' ELSE tier END AS tier, CASE WHEN id%3<>0 THEN TIMESTAMP '{AS_OF}' END AS updated_at FROM (SELECT * FROM profiles WHERE id%6<>0) UNION ALL SELECT id, tier, NULL FROM profiles WHERE id%6=0", "profiles")
def profile_updates(spark, d):
    p = tables.profiles(spark, d).select("id", "tier")
    changes = p.where("id % 3 <> 0").select("id", F.when(F.col("id") % 2 == 0, "new").alias("tier"))
    return commerce.profile_update(p, changes, F.expr(f"timestamp_ntz'{AS_OF}'"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey%2=0 THEN c_name ELSE 'user'||c_custkey END AS display_name FROM customer")
def display_names(spark, d):
    c = tables.table(spark, d, "customer")
    meta = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.struct(F.col("c_name").alias("display_name")))).otherwise("{}")
    return c.select(F.col("c_custkey").alias("id"), commerce.display_name(meta, F.concat(F.lit("user"), F.col("c_custkey"), F.lit("@mail"))).alias("display_name"))


APPS = "SELECT 'app-'||s_suppkey AS slug, CASE s_suppkey%3 WHEN 0 THEN 'live' WHEN 1 THEN 'free' ELSE 'planned' END AS status, CASE WHEN s_suppkey%4<>0 THEN floor(s_acctbal)/100 END AS book_price FROM supplier"


@query(f"WITH a AS ({APPS}) SELECT 'pro_'||replace(slug,'-','_') AS lookup_key, CAST(799 AS BIGINT) AS cents, true AS recurring FROM a WHERE status='live' UNION ALL SELECT 'all_access', 1499, true UNION ALL SELECT 'ebook_'||replace(slug,'-','_'), CAST(floor(book_price*100+0.5) AS BIGINT), false FROM a WHERE status IN ('live','free') AND book_price IS NOT NULL")
def price_plan(spark, d):
    k = F.col("s_suppkey")
    apps = tables.table(spark, d, "supplier").select(F.concat(F.lit("app-"), k).alias("slug"), F.when(k % 3 == 0, "live").when(k % 3 == 1, "free").otherwise("planned").alias("status"), F.when(k % 4 != 0, F.floor("s_acctbal") / 100.0).alias("book_price"))
    return commerce.price_plan(apps)


@query("SELECT 'k'||p_partkey AS lookup_key, CASE WHEN p_partkey%7=0 THEN 'missing' WHEN p_partkey%5=0 THEN 'metadata' WHEN p_partkey%3=0 THEN 'price' ELSE 'ok' END AS state FROM part")
def price_drift(spark, d):
    k = F.col("p_partkey")
    p = tables.table(spark, d, "part")
    key = F.concat(F.lit("k"), k)
    planned = p.select(key.alias("lookup_key"), F.lit(999).alias("cents"), F.create_map(F.lit("tier"), F.lit("pro"), F.lit("app"), F.col("p_brand")).alias("metadata"))
    there = p.where("p_partkey % 7 <> 0").select(key.alias("lookup_key"), F.when(k % 3 == 0, 500).otherwise(999).alias("cents"), F.create_map(F.lit("tier"), F.lit("pro"), F.lit("app"), F.when(k % 5 == 0, F.lit("x")).otherwise(F.col("p_brand"))).alias("metadata"))
    return commerce.price_drift(planned, there)


@query("SELECT p_partkey AS price, CASE WHEN p_partkey%10=0 THEN 'all_access' WHEN p_partkey%4=0 THEN NULL WHEN p_partkey%4=1 THEN 'all_access' WHEN p_partkey%3=0 THEN NULL ELSE 'pro' END AS tier, CASE WHEN p_partkey%10=0 OR p_partkey%4<=1 OR p_partkey%3=0 THEN NULL ELSE 'app' END AS app FROM part")
def resolved_prices(spark, d):
    k = F.col("p_partkey")
    p = tables.table(spark, d, "part")
    tier = F.when(k % 4 == 0, "other").when(k % 4 == 1, "all_access").otherwise("pro")
    prices = p.select(k.alias("price"), F.create_map(F.lit("tier"), F.lit("free"), F.lit("app"), F.lit("app")).alias("product_metadata"), F.when(k % 3 == 0, F.create_map(F.lit("tier"), tier, F.lit("app"), F.lit(""))).otherwise(F.create_map(F.lit("tier"), tier)).alias("price_metadata"))
    return commerce.resolved(prices, p.where("p_partkey % 10 = 0").select(k.alias("price"), F.lit("all_access").alias("tier"), F.lit(None).cast("string").alias("app")))


@query("SELECT id, action, CASE action WHEN 'free' THEN 'free' WHEN 'set' THEN 'pro' END AS tier, CASE WHEN action='set' THEN 'app' END AS app, CASE WHEN action<>'none' THEN 1700000000+id END AS valid_until FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey%5<=1 THEN 'free' WHEN o_orderkey%5<=3 AND o_orderkey%2=0 THEN 'set' ELSE 'none' END AS action FROM orders)")
def subscription_lifecycle(spark, d):
    k = F.col("o_orderkey")
    status = F.get(F.array(*map(F.lit, ("canceled", "unpaid", "active", "trialing", "past_due"))), (k % 5).cast("int"))
    e = tables.table(spark, d, "orders").select(k.alias("id"), status.alias("status"), F.when(k % 2 == 0, "pro").alias("tier"), F.lit("app").alias("app"), (k + 1700000000).alias("period_end"))
    return commerce.lifecycle(e).withColumn("valid_until", F.unix_timestamp("valid_until"))


@query("SELECT session, string_agg(DISTINCT CAST(slug AS VARCHAR), ',' ORDER BY CAST(slug AS VARCHAR)) AS slugs, CAST(sum(CASE WHEN line=1 THEN 999 ELSE amount END) AS BIGINT) AS cents FROM purchases GROUP BY 1", "purchases")
def checkout_totals(spark, d):
    lines = tables.purchases(spark, d).select("session", F.col("slug").cast("string").alias("slug"), F.when(F.col("line") != 1, F.col("amount")).alias("amount"))
    return commerce.checkout_totals(lines).withColumn("slugs", F.array_join("slugs", ","))


@query("SELECT customer, count(*) AS ebooks, CASE WHEN count(*)>=3 THEN 'all_access' ELSE 'pro' END AS applies_to, CAST(CASE WHEN count(*)>=3 THEN 20 ELSE 10 END AS BIGINT) AS percent_off FROM purchases GROUP BY 1", "purchases")
def discounts(spark, d):
    n = tables.purchases(spark, d).groupBy("customer").agg(F.count("*").alias("ebooks"))
    applies, off = commerce.discount(F.col("ebooks"))
    return n.select("customer", "ebooks", applies.alias("applies_to"), off.alias("percent_off"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey%7=0 THEN '' WHEN o_orderkey%7=1 THEN 'b'||o_custkey ELSE 'a,b'||o_custkey END AS missing, CASE WHEN o_orderkey%7=0 THEN '*' WHEN o_orderkey%7=1 THEN 'a,b'||o_custkey ELSE 'c'||o_custkey||',a,b'||o_custkey END AS whole FROM orders")
def missing_webhooks(spark, d):
    """Endpoints by order: every seventh takes all events, every seventh lacks one, the others have another one only."""
    k, b = F.col("o_orderkey") % 7, F.concat(F.lit("b"), "o_custkey")
    rows = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.lit("a"), b).alias("wanted"), F.when(k == 0, F.array(F.lit("*"))).when(k == 1, F.array(F.lit("a"))).otherwise(F.array(F.concat(F.lit("c"), "o_custkey"))).alias("enabled"))
    return commerce.missing_events(rows).select("id", F.array_join("missing", ",").alias("missing"), F.array_join("all", ",").alias("whole"))


@query("SELECT event_id AS id, CASE event_id%4 WHEN 0 THEN 'Subscription: u'||user_id||' -> pro' WHEN 1 THEN 'Books: pro for '||CAST(CAST(event_id/100.0 AS DECIMAL(20,2)) AS VARCHAR) WHEN 2 THEN 'New account: u'||user_id ELSE 'Event: other' END AS text FROM events")
def notices(spark, d):
    k = F.col("event_id")
    kind = F.get(F.array(*map(F.lit, ("subscription", "ebook_purchase", "signup", "other"))), (k % 4).cast("int"))
    return tables.table(spark, d, "events").select(k.alias("id"), commerce.notice(kind, F.concat(F.lit("u"), F.col("user_id")), F.lit("pro"), k).alias("text"))


@query("SELECT customer, slug, coalesce(p_name, CAST(slug AS VARCHAR)) AS title FROM purchases LEFT JOIN (SELECT * FROM part WHERE p_partkey%2=0) ON slug=p_partkey", "purchases")
def library_shelf(spark, d):
    books = tables.table(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("title"))
    return commerce.shelf(tables.purchases(spark, d).select("customer", "slug"), books)


@query("SELECT user_id, id FROM responses WHERE user_id NOT IN (SELECT user_id FROM study_sessions WHERE user_id%3<>0)", "responses study_sessions")
def backfilled_history(spark, d):
    """The server has sessions of two users in three, so the local answers of the third are sent."""
    return commerce.backfilled(tables.responses(spark, d).select("user_id", "id"), tables.study_sessions(spark, d).where("user_id % 3 <> 0"))
