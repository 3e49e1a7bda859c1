"""Queries on tiers, gates and ownership."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill.functions import text
from quizmill.operators import access
from quizmill.plans.registry import query
from quizmill.sources import tables
from quizmill.sources.tables import AS_OF



def now():
    return F.expr(f"timestamp_ntz'{AS_OF}'")


ACT = f"(tier='free' OR valid_until IS NULL OR valid_until>TIMESTAMP '{AS_OF}')"
SCOPE = "CASE WHEN tier='all_access' THEN true WHEN tier<>'pro' THEN false ELSE coalesce(tier_app=slug,false) END"
SLUG = "'app-'||(id%25)"


def _asked(spark, d):
    p = tables.profiles(spark, d).withColumn("slug", F.concat(F.lit("app-"), F.col("id") % 25))
    return p.withColumn("is_active", access.active(F.col("tier"), F.col("valid_until"), now()))


@query(f"SELECT id, {ACT} AND {SCOPE} AS server, {SCOPE} AS client, {ACT} AND tier<>'free' AND NOT {SCOPE} AS paid_elsewhere, tier='all_access' AND {ACT} AS all_access, tier='free' AS free FROM (SELECT *, {SLUG} AS slug FROM profiles)", "profiles")
def tier_flags(spark, d):
    args = [F.col(c) for c in ("tier", "tier_app", "is_active", "slug")]
    return _asked(spark, d).select("id", access.covers(*args).alias("server"), access.in_scope(args[0], args[1], args[3]).alias("client"), access.paid_elsewhere(*args).alias("paid_elsewhere"), ((F.col("tier") == "all_access") & F.col("is_active")).alias("all_access"), (F.col("tier") == "free").alias("free"))


FEATURES = [*access.GATES, "ebook"]


@query(f"SELECT id, feature, CASE WHEN feature='sync' THEN id%2=0 WHEN feature='ebook' THEN false ELSE pro END AS open FROM (SELECT id, {ACT} AND {SCOPE} AS pro, unnest(['" + "','".join(FEATURES) + f"']) AS feature FROM (SELECT *, {SLUG} AS slug FROM profiles))", "profiles")
def feature_gates(spark, d):
    rows = _asked(spark, d).withColumn("pro", access.is_pro(*(F.col(c) for c in ("tier", "tier_app", "is_active", "slug")))).select("id", "pro", F.explode(F.array(*map(F.lit, FEATURES))).alias("feature"))
    return rows.select("id", "feature", access.can(F.col("feature"), F.col("pro"), F.col("id") % 2 == 0).alias("open"))


@query("SELECT id, '{\"tier\":\"'||tier||'\",\"tier_app\":\"'||tier_app||'\",\"tier_valid_until\":'||coalesce('\"'||strftime(valid_until,'%Y-%m-%dT%H:%M:%S')||'\"','null')||',\"is_active\":'||CASE WHEN " + ACT + " THEN 'true' ELSE 'false' END||'}' AS record FROM profiles", "profiles")
def tier_records(spark, d):
    return access.tier_record(tables.profiles(spark, d), now())


@query(f"SELECT p_partkey AS id, regexp_matches(replace(lower(p_name),' ','-'), '{text.SLUG}') AS slug_ok, regexp_matches('ebook_'||p_partkey, '{text.PRICE_KEY}') AS key_ok FROM part")
def valid_names(spark, d):
    name = F.replace(F.lower("p_name"), F.lit(" "), F.lit("-"))
    return tables.table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.rlike(text.SLUG).alias("slug_ok"), F.concat(F.lit("ebook_"), F.col("p_partkey")).rlike(text.PRICE_KEY).alias("key_ok"))


@query("SELECT customer, '['||string_agg(slug, ',' ORDER BY created_at, slug)||']' AS books FROM purchases GROUP BY 1", "purchases")
def owned_books(spark, d):
    return access.owned_books(tables.purchases(spark, d))


@query("SELECT customer, count(*) AS ebooks FROM purchases GROUP BY 1", "purchases")
def ebook_counts(spark, d):
    return tables.purchases(spark, d).groupBy("customer").agg(F.count("*").alias("ebooks"))


@query("SELECT a.customer, a.slug, EXISTS (SELECT 1 FROM purchases p WHERE p.customer=a.customer AND p.slug=a.slug) AS allowed FROM (SELECT o_custkey AS customer, o_orderkey%200+1 AS slug FROM orders) a", "purchases")
def download_checks(spark, d):
    asked = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), (F.col("o_orderkey") % 200 + 1).alias("slug"))
    return access.may_download(asked, tables.purchases(spark, d), "customer", "slug")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey%3=0 THEN 'subscription' ELSE 'payment' END AS mode, CASE WHEN c_custkey%2=0 THEN c_name END AS use_customer, CASE WHEN c_custkey%2<>0 THEN c_name||'@x' END AS use_email FROM customer")
def checkout_modes(spark, d):
    k = F.col("c_custkey")
    rows = tables.table(spark, d, "customer").select(k.alias("id"), (k % 3 == 0).alias("recurring"), F.when(k % 2 == 0, F.col("c_name")).alias("customer"), F.concat("c_name", F.lit("@x")).alias("email"))
    return access.checkout(rows).select("id", "mode", "use_customer", "use_email")


@query("SELECT c_custkey AS id, c_mktsegment IN ('BUILDING','MACHINERY') AS shipped, c_mktsegment='BUILDING' AS live FROM customer")
def status_filters(spark, d):
    s = F.col("c_mktsegment")
    return tables.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), s.isin("BUILDING", "MACHINERY").alias("shipped"), (s == "BUILDING").alias("live"))
