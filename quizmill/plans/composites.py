"""Queries on operators that put others together."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill.operators import composites
from quizmill.operators.planner import ACTIVITIES
from quizmill.plans import learner, planner
from quizmill.plans.registry import query
from quizmill.sources import tables


WARM = learner.PADDED.replace("WITH s AS", "WITH everything AS ({all}), responses AS (SELECT * FROM everything WHERE user_id%5<>0), s AS").replace("{all}", tables.SQL["responses"])
COLD = "SELECT user_id, item_id, cat, row_number() OVER (PARTITION BY user_id ORDER BY md5(item_id||':0'), item_id) AS rank FROM (SELECT user_id, item_id, min(category) AS cat FROM everything WHERE user_id%5=0 GROUP BY 1,2) QUALIFY rank<=10"


@query(f"{WARM} UNION ALL {COLD}")
def recommended(spark, d):
    """A fifth of the users have no answers on record and start cold."""
    r = tables.responses(spark, d)
    offer = r.groupBy("user_id", "item_id").agg(F.min("category").alias("cat"))
    return composites.recommended(offer, r.where("user_id % 5 <> 0"), 10).select("user_id", "item_id", "cat", "rank")


MIXED = f"SELECT i.user_id, i.item_id, i.cat, CASE WHEN s.accuracy IS NOT NULL THEN (1-s.accuracy)*10 ELSE 5.0 END + coalesce(w.miss_rate*6,0.0) + CASE WHEN i.user_id IN (SELECT user_id FROM srv) THEN coalesce(f.difficulty*3,0.0) ELSE 0.0 END AS score FROM (SELECT user_id, item_id, min(category) AS cat FROM responses WHERE user_id IN (SELECT user_id FROM srv UNION SELECT user_id FROM loc) GROUP BY 1,2) i LEFT JOIN st s ON i.user_id=s.user_id AND i.cat=s.category LEFT JOIN (SELECT user_id, item_id, arg_min(miss_rate,rank) AS miss_rate FROM ({learner.WEAK.replace('responses', 'srv')}) WHERE rank<=60 GROUP BY 1,2 UNION ALL SELECT user_id, item_id, count(*) FILTER (WHERE NOT correct)/CAST(count(*) AS DOUBLE) AS miss_rate FROM loc GROUP BY 1,2 HAVING count(*) FILTER (WHERE NOT correct)>0) w ON i.user_id=w.user_id AND i.item_id=w.item_id LEFT JOIN ({learner.DIFFICULTY.replace('responses', 'srv')}) f ON i.item_id=f.item_id"
WARMED = learner.PADDED.removeprefix("WITH ").replace(learner.SCORES, "SELECT * FROM mixed")
PICKED, FILLED = WARMED.split(" SELECT user_id, item_id, cat, rank FROM best UNION ALL ")


@query(f"WITH {learner.SRV}, {learner.LOC}, st AS (SELECT user_id, category, accuracy FROM ({learner.SRV_STATS}) UNION ALL SELECT user_id, category, accuracy FROM ({learner.LOC_STATS})), mixed AS ({MIXED}), why AS (SELECT user_id, string_agg(category, ', ' ORDER BY r) AS weakest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY accuracy, category) AS r FROM st WHERE accuracy<0.7) WHERE r<=2 GROUP BY 1), {PICKED}, told AS (SELECT user_id, item_id, cat, rank FROM best UNION ALL {FILLED}), cold AS (SELECT user_id, item_id, cat, row_number() OVER (PARTITION BY user_id ORDER BY md5(item_id||':0'), item_id) AS rank FROM (SELECT user_id, item_id, min(category) AS cat FROM responses WHERE user_id NOT IN (SELECT user_id FROM st) GROUP BY 1,2) QUALIFY rank<=10) SELECT told.user_id, item_id, cat, rank, CASE WHEN told.user_id%3<>0 THEN 'server' ELSE 'local' END AS source, coalesce('weak: '||weakest, 'all good') AS reason FROM told LEFT JOIN why ON why.user_id=told.user_id UNION ALL SELECT user_id, item_id, cat, rank, 'none', 'no answers yet' FROM cold", "responses")
def recommended_by_source(spark, d):
    """Users that the server knows, users that only their device knows, and users that nobody knows, in one query."""
    offer = tables.responses(spark, d).groupBy("user_id", "item_id").agg(F.min("category").alias("cat"))
    return composites.recommended_by_source(offer, *learner._server_and_local(spark, d), 10)


SIZE = planner.ESTIMATE.replace(planner.REGISTRY, "SELECT 0 AS id, 120 AS terms, 100 AS questions")
DONE = "SELECT user_id, sum(minutes) AS m, count(*) FILTER (WHERE minutes>=40) AS blocks_done, " + ", ".join(f"coalesce(round(sum(minutes) FILTER (WHERE {planner.AS_ACT}='{a}'),6),0) AS {a}" for a in ACTIVITIES) + " FROM plan_events WHERE minutes>0 GROUP BY 1"
MOVED = f"SELECT d.*, e.hours, e.blocks, round(m,6) AS minutes, CAST(floor(m/6+0.5) AS BIGINT) AS tenths_of_hours, CAST(least(100, floor(m/(e.hours*60)*100+0.5)) AS BIGINT) AS percent, CAST(ceil(greatest(0,e.blocks-blocks_done)/(21/7.0::DOUBLE)) AS BIGINT) AS blocks_per_week, [" + ", ".join(f"{{'a':'{a}','t':e.{a}_hours*60,'d':d.{a},'k':{k}}}" for k, a in enumerate(ACTIVITIES)) + f"] AS options FROM ({DONE}) d CROSS JOIN ({SIZE}) e"
NEXT = f"SELECT user_id, o.a AS next_activity, greatest(0.0::DOUBLE, o.t-o.d) AS minutes_left FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (o.t-o.d)/o.t DESC, o.k) AS r FROM (SELECT user_id, percent, unnest(options) AS o FROM ({MOVED})) WHERE o.a<>'exams' OR percent>=55) WHERE r=1"


@query(f"SELECT m.user_id, m.minutes, m.tenths_of_hours, m.blocks_done, m.percent, m.blocks_per_week, n.next_activity, n.minutes_left, t.tips, m.hours, m.blocks FROM ({MOVED}) m JOIN ({NEXT}) n USING (user_id) JOIN ({planner.TIPS_SHOWN}) t USING (user_id)", "plan_events")
def planner_summary(spark, d):
    act = F.get(F.array(*map(F.lit, ACTIVITIES)), (F.col("id") % 4).cast("int"))
    return composites.summary(planner._blocks(spark, d).withColumn("activity", act), 120, 100, 21).withColumn("tips", F.array_join("tips", ","))


@query(f"WITH t AS (SELECT id, hours, CASE WHEN id%7<>0 THEN id%60 END AS days, id%4 AS exams, id%2=0 AS together FROM ({planner.ESTIMATE})), a AS (SELECT *, floor(days/7.0::DOUBLE*5.0::DOUBLE*10+0.5)/10 AS av FROM t) SELECT id, hours, CASE WHEN days IS NULL THEN 'unknown' WHEN days=0 THEN 'past' WHEN hours<=0 OR av/hours>=1.25 THEN 'comfortable' WHEN av/hours>=1 THEN 'workable' WHEN av/hours>=0.7 THEN 'tight' ELSE 'short' END AS verdict, av AS available, CASE WHEN days IS NOT NULL THEN greatest(0.0::DOUBLE, floor((hours-av)*10+0.5)/10) END AS shortfall, CASE WHEN exams<=1 THEN 'pro' WHEN together THEN 'all_access' ELSE 'pro' END AS pick, CASE WHEN exams>1 AND NOT together THEN 'all_access' END AS alternative, exams*799-1499 AS saved_cents, true AS has_book, greatest(0.0::DOUBLE, hours-3.0::DOUBLE) AS hours_beyond_book FROM a")
def advice(spark, d):
    """Timeline, plan and book against app, for apps with all kinds of days left."""
    k = F.col("id")
    rows = composites.sized(planner.registry(spark, d)).select("id", "hours", F.when(k % 7 != 0, k % 60).alias("days"), F.lit(5.0).alias("hours_per_week"), (k % 4).alias("exams"), (k % 2 == 0).alias("simultaneous"), F.lit(3.0).alias("book_hours"))
    return composites.advice(rows).select("id", "hours", "verdict", "available", "shortfall", "pick", "alternative", "saved_cents", "has_book", "hours_beyond_book")


@query("SELECT id, user_id, user_id=7 AS writable FROM responses", "responses")
def writable_answers(spark, d):
    """What one user may write, and what not."""
    own, other = composites.writable(tables.responses(spark, d).select("id", "user_id"), F.lit(7))
    return own.withColumn("writable", F.lit(True)).unionByName(other.withColumn("writable", F.lit(False)))


@query("SELECT name FROM (SELECT r_name AS name, 0 AS part, r_regionkey AS place FROM region UNION ALL SELECT n_name, 1, n_nationkey FROM nation) ORDER BY part, place LIMIT 12")
def names_in_order(spark, d):
    first = tables.table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("place"))
    second = tables.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("place"))
    return composites.in_order(first, second, 12).select("name")


@query("SELECT id, CASE WHEN id%3=0 THEN '{}' ELSE '{\"timed\":true}' END AS config FROM study_sessions", "study_sessions")
def stored_sessions(spark, d):
    rows = tables.study_sessions(spark, d).select("id", F.when(F.col("id") % 3 != 0, '{"timed":true}').alias("config"))
    return composites.session_rows(rows)


@query("SELECT event_id AS id, nullif(event_id%4,0) AS time_ms FROM events")
def stored_answers(spark, d):
    rows = tables.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 4).alias("time_ms"), F.col("ts").alias("created_at"))
    return composites.answer_rows(rows, F.expr(f"timestamp_ntz'{learner.AS_OF}'")).select("id", "time_ms")


@query("SELECT customer, list_contains(list(slug), 7) AS owns FROM purchases GROUP BY 1", "purchases")
def owns_book(spark, d):
    books = tables.purchases(spark, d).groupBy("customer").agg(F.collect_set("slug").alias("books"))
    return books.select("customer", composites.owns(F.col("books"), F.lit(7)).alias("owns"))


@query("SELECT o_orderkey AS id, string_agg(CASE WHEN l_partkey%2=0 THEN 'Book '||l_partkey ELSE 'p'||l_partkey END, '|' ORDER BY l_linenumber, l_partkey) AS titles FROM orders JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) ON o_orderkey=l_orderkey GROUP BY 1")
def event_titles(spark, d):
    lines = tables.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.array_distinct(F.collect_list(F.struct("l_linenumber", "l_partkey")))), lambda x: F.concat(F.lit("p"), x["l_partkey"])).alias("slugs"))
    names = tables.table(spark, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("slug"), F.concat(F.lit("Book "), F.col("p_partkey")).alias("title"))
    return composites.titled(lines, names).select("id", F.array_join("titles", "|").alias("titles"))


@query("SELECT c_custkey AS app, CASE WHEN c_custkey%3=0 THEN 'half set' ELSE 'secret key' END AS problem FROM customer WHERE c_custkey%3=0 OR c_custkey%5=0")
def release_checks(spark, d):
    k = F.col("c_custkey")
    rows = tables.table(spark, d, "customer").select(k.alias("app"), F.when(k % 3 != 0, "https://x").alias("url"), F.when(k % 5 == 0, "sk_1").otherwise("pk_1").alias("key"), F.lit("sk_").alias("prefix"))
    return composites.readiness(rows).select("app", "problem")


@query("SELECT p_partkey AS id, concat_ws(' · ', p_name, nullif(CASE WHEN p_size>25 THEN p_brand ELSE '' END,''), CASE WHEN p_partkey%2=0 THEN p_type END) AS line FROM part")
def blurbs(spark, d):
    p = tables.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), composites.blurb(F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(""), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type"))).alias("line"))


@query("SELECT c_nationkey AS app, c_mktsegment AS file FROM customer EXCEPT SELECT s_nationkey, CASE WHEN s_suppkey%2=0 THEN 'BUILDING' ELSE 'MACHINERY' END FROM supplier")
def uncached_files(spark, d):
    imports = tables.table(spark, d, "customer").select(F.col("c_nationkey").alias("app"), F.col("c_mktsegment").alias("file"))
    shell = tables.table(spark, d, "supplier").select(F.col("s_nationkey").alias("app"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("file"))
    return composites.uncached(imports, shell)
