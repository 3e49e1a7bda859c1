"""Queries on study plans."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quizmill.functions import numbers, text
from quizmill.operators import planner
from quizmill.plans.registry import query
from quizmill.sources import tables
from quizmill.sources.tables import AS_OF

HH = "floor(({})/1800.0::DOUBLE+0.5)/2"
T, Q = "CAST(greatest(0,terms) AS DOUBLE)", "CAST(greatest(0,questions) AS DOUBLE)"
PARTS = {"glossary": f"{T}*90", "drills": f"{T}*75", "practice": f"{Q}*165+{Q}*0.4::DOUBLE*90", "exams": f"2*least(150.0::DOUBLE,{Q})*84"}
TOTAL = "+".join(f"({p})" for p in PARTS.values())
REGISTRY = "SELECT p_partkey AS id, p_size*4 AS terms, p_partkey%250 AS questions FROM part"
ESTIMATE = f"SELECT *, {HH.format(TOTAL)} AS hours, CAST(greatest(1,ceil(({TOTAL})/3600)) AS BIGINT) AS blocks, " + ", ".join(f"{HH.format(p)} AS {k}_hours" for k, p in PARTS.items()) + f" FROM ({REGISTRY})"


def registry(spark, d):
    return tables.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 4).alias("terms"), (F.col("p_partkey") % 250).alias("questions"))


@query(ESTIMATE)
def estimate_hours(spark, d):
    return planner.estimated(registry(spark, d))


@query(f"SELECT id, terms, questions, hours FROM ({ESTIMATE}) ORDER BY hours DESC, id")
def catalogue_report(spark, d):
    return planner.estimated(registry(spark, d)).select("id", "terms", "questions", "hours").orderBy(F.desc("hours"), "id")


@query(f"SELECT sum(hours) AS hours, count(*) AS apps, greatest(20, 2500-count(*)) AS soon FROM ({ESTIMATE})")
def catalogue_hours(spark, d):
    return planner.estimated(registry(spark, d)).agg(F.sum("hours").alias("hours"), F.count("*").alias("apps")).withColumn("soon", F.greatest(F.lit(20), 2500 - F.col("apps")))


@query(f"SELECT doc_id, n AS words, {HH.format('n/200.0::DOUBLE*60*1.35::DOUBLE')} AS reading_hours FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text,'\\s+'), lambda w: w<>'')) AS n FROM documents)")
def reading_hours(spark, d):
    docs = tables.table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))
    return docs.withColumn("reading_hours", planner.reading_hours(F.col("words")))


BLOCKS = "SELECT user_id, sum(minutes) AS m, count(*) FILTER (WHERE minutes>=40) AS blocks_done FROM plan_events WHERE minutes>0 GROUP BY 1"


@query(f"SELECT user_id, round(m,6) AS minutes, CAST(floor(m/6+0.5) AS BIGINT) AS tenths_of_hours, blocks_done, CAST(least(100, floor(m/(28.5::DOUBLE*60)*100+0.5)) AS BIGINT) AS percent, CAST(ceil(greatest(0,29-blocks_done)/(21/7.0::DOUBLE)) AS BIGINT) AS blocks_per_week FROM ({BLOCKS})", "plan_events")
def planner_progress(spark, d):
    return planner.progress(tables.plan_events(spark, d), 28.5, 29, 21)


@query("SELECT user_id, activity, round(sum(minutes),6) AS minutes FROM plan_events WHERE minutes>0 GROUP BY 1,2", "plan_events")
def minutes_by_activity(spark, d):
    return planner.by_activity(tables.plan_events(spark, d)).select("user_id", F.explode("by_activity").alias("activity", "minutes"))


KINDS = "tv phone people worry toomuch tired".split()
PICK = "['" + "','".join(KINDS) + "']"
LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS rank FROM plan_events) WHERE rank<=6"


def _blocks(spark, d):
    kinds = F.array(*map(F.lit, KINDS))
    return tables.plan_events(spark, d).withColumn("distractions", F.array(F.get(kinds, (F.col("id") % 6).cast("int")), F.get(kinds, (F.col("id") % 4).cast("int"))))


@query(f"SELECT user_id, distraction, count(*) AS n FROM (SELECT user_id, unnest([{PICK}[id%6+1], {PICK}[id%4+1]]) AS distraction FROM ({LAST})) GROUP BY 1,2", "plan_events")
def distraction_counts(spark, d):
    return planner.distractions(_blocks(spark, d))


@query(f"SELECT user_id, avg(CAST(focus AS DOUBLE)) AS avg_focus, count(*) AS recent FROM ({LAST}) GROUP BY 1", "plan_events")
def recent_focus(spark, d):
    return planner.focus(_blocks(spark, d))


TIPS = "CASE distraction WHEN 'tv' THEN 1 WHEN 'phone' THEN 2 WHEN 'people' THEN 3 WHEN 'worry' THEN 8 WHEN 'toomuch' THEN 9 WHEN 'tired' THEN 24 END"
GEN = "[" + ",".join(map(str, planner.GENERAL)) + "]"


TIPS_SHOWN = f"WITH last6 AS ({LAST}), u AS (SELECT user_id, avg(CAST(focus AS DOUBLE)) AS f, count(*) AS recent FROM last6 GROUP BY 1), c AS (SELECT user_id, distraction, count(*) AS n FROM (SELECT user_id, unnest([{PICK}[id%6+1], {PICK}[id%4+1]]) AS distraction FROM last6) GROUP BY 1,2), t AS (SELECT user_id, list({TIPS}) AS called FROM c JOIN u USING (user_id) WHERE n >= CASE WHEN recent>=4 THEN 2 ELSE 1 END GROUP BY 1), dn AS (SELECT user_id, count(*) FILTER (WHERE minutes>0) AS done FROM plan_events GROUP BY 1) SELECT user_id, array_to_string(list_slice(list_concat(list_concat(list_sort(list_concat(coalesce(called,[]), CASE WHEN f>0 AND f<2.6 THEN [12] ELSE [] END)), list_slice({GEN}, done*2%{len(planner.GENERAL)}+1, {len(planner.GENERAL)})), list_slice({GEN}, 1, done*2%{len(planner.GENERAL)})), 1, 3), ',') AS tips FROM u LEFT JOIN t USING (user_id) JOIN dn USING (user_id)"


@query(TIPS_SHOWN, "plan_events")
def tips_to_show(spark, d):
    blocks = _blocks(spark, d)
    done = blocks.groupBy("user_id").agg(F.count_if(F.col("minutes") > 0).alias("done"))
    return planner.tips(planner.focus(blocks).join(done, "user_id"), planner.distractions(blocks)).select("user_id", F.array_join("tips", ",").alias("tips"))


NAMES = {"click": "glossary", "view": "drills", "purchase": "practice"}
TARGETS = {"glossary": 300.0, "drills": 250.0, "practice": 600.0, "exams": 420.0}
AS_ACT = "['glossary','drills','practice','exams'][id%4+1]"


@query(f"WITH a AS (SELECT user_id, round(sum(minutes) FILTER (WHERE {AS_ACT}='glossary'),6) AS glossary, round(sum(minutes) FILTER (WHERE {AS_ACT}='drills'),6) AS drills, round(sum(minutes) FILTER (WHERE {AS_ACT}='practice'),6) AS practice, round(sum(minutes) FILTER (WHERE {AS_ACT}='exams'),6) AS exams, round(sum(minutes),6) AS m FROM plan_events WHERE minutes>0 GROUP BY 1), b AS (SELECT *, CAST(least(100,floor(m/(28.5::DOUBLE*60)*100+0.5)) AS BIGINT) AS percent FROM a), o AS (SELECT user_id, percent, unnest([{{'a':'glossary','t':300.0::DOUBLE,'d':coalesce(glossary,0),'k':0}},{{'a':'drills','t':250.0::DOUBLE,'d':coalesce(drills,0),'k':1}},{{'a':'practice','t':600.0::DOUBLE,'d':coalesce(practice,0),'k':2}},{{'a':'exams','t':420.0::DOUBLE,'d':coalesce(exams,0),'k':3}}]) AS o FROM b) SELECT user_id, o.a AS activity, greatest(0.0, o.t-o.d) AS minutes_left FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (o.t-o.d)/o.t DESC, o.k) AS r FROM o WHERE o.a<>'exams' OR percent>=55) WHERE r=1", "plan_events")
def next_block(spark, d):
    act = F.get(F.array(*map(F.lit, planner.ACTIVITIES)), (F.col("id") % 4).cast("int"))
    blocks = tables.plan_events(spark, d).where("minutes > 0").withColumn("activity", act)
    each = blocks.groupBy("user_id").agg(*(F.round(F.sum(F.when(F.col("activity") == a, F.col("minutes"))), 6).alias(a) for a in planner.ACTIVITIES), F.round(F.sum("minutes"), 6).alias("m"))
    each = each.withColumn("percent", F.least(F.lit(100), numbers.half_up(F.col("m") / (28.5 * 60) * 100)).cast("long"))
    return planner.next_block(each, TARGETS).select("user_id", "activity", "minutes_left")


@query("SELECT event_id AS id, CAST(greatest(0,floor(coalesce(value-20,0)+0.5)) AS BIGINT) AS minutes, CAST(least(5,greatest(1,coalesce(nullif(event_id%8,0),3))) AS BIGINT) AS focus, CAST(least(50,floor(value+0.5)) AS BIGINT) AS saved, least(50,floor(value+0.5))<5 AS too_short, CASE WHEN value*60>=3600 THEN 'over' WHEN value*60>=3000 THEN 'break' ELSE 'work' END AS phase FROM events")
def saved_blocks(spark, d):
    e = tables.table(spark, d, "events")
    minutes, focus = planner.clamped(F.col("value") - 20, F.col("event_id") % 8)
    saved, short = planner.saved_minutes(F.col("value"))
    return e.select(F.col("event_id").alias("id"), minutes.alias("minutes"), focus.alias("focus"), saved.alias("saved"), short.alias("too_short"), planner.phase(F.col("value") * 60).alias("phase"))


@query("SELECT id, place, (place-user_id%n+n)%n AS turn FROM (SELECT o_orderkey AS id, o_custkey AS user_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)-1 AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)")
def rotation(spark, d):
    """Each user's list, which begins at another place for each and wraps around."""
    own = Window.partitionBy("o_custkey")
    size = F.count("*").over(own)
    rows = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.row_number().over(own.orderBy("o_orderkey")) - 1).cast("long").alias("place"), (F.col("o_custkey") % size).alias("start"), size.alias("size"))
    return planner.rotated(rows, F.col("start"), F.col("size")).select("id", "place", "turn")


TL = f"SELECT id, hours, CASE WHEN id%11=0 THEN NULL ELSE id%60 END AS days, CAST(id%9 AS DOUBLE) AS hpw FROM ({ESTIMATE})"


@query(f"WITH t AS ({TL}), a AS (SELECT *, days IS NOT NULL AND hpw>0 AS ok, floor(days/7.0::DOUBLE*hpw*10+0.5)/10 AS av FROM t) SELECT id, CASE WHEN NOT ok THEN 'unknown' WHEN days=0 THEN 'past' WHEN hours<=0 OR av/hours>=1.25 THEN 'comfortable' WHEN av/hours>=1 THEN 'workable' WHEN av/hours>=0.7 THEN 'tight' ELSE 'short' END AS verdict, CASE WHEN ok THEN av END AS available, CASE WHEN ok AND days>0 THEN CAST(ceil(hours/(days/7.0::DOUBLE)) AS BIGINT) END AS per_week_needed, CASE WHEN ok THEN greatest(0.0, floor((hours-av)*10+0.5)/10) END AS shortfall, CASE WHEN hpw>0 THEN CAST(greatest(1,ceil(hours/hpw/4.345::DOUBLE)) AS BIGINT) END AS months FROM a")
def timelines(spark, d):
    rows = planner.estimated(registry(spark, d)).select("id", "hours", F.when(F.col("id") % 11 != 0, F.col("id") % 60).alias("days"), (F.col("id") % 9).cast("double").alias("hours_per_week"))
    return planner.timeline(rows).select("id", "verdict", "available", "per_week_needed", "shortfall", planner.months_of_study(F.col("hours"), F.col("hours_per_week")).alias("months"))


@query("SELECT o_orderkey AS id, greatest(0, date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE))) AS days FROM orders")
def days_until(spark, d):
    return tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), planner.days_until(F.col("o_orderdate").cast("string"), "1998-01-01").alias("days"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey%5<=1 THEN 'pro' WHEN n_nationkey%2=0 THEN 'all_access' ELSE 'pro' END AS pick, CASE WHEN n_nationkey%5>1 AND n_nationkey%2<>0 THEN 'all_access' END AS alternative, n_nationkey%5*799 AS pro_cents, CAST(1499 AS BIGINT) AS all_access_cents, n_nationkey%5*799-1499 AS saved_cents FROM nation")
def plan_advice(spark, d):
    n = F.col("n_nationkey")
    rows = tables.table(spark, d, "nation").select(n.alias("id"), (n % 5).alias("exams"), (n % 2 == 0).alias("simultaneous"))
    return planner.plan_advice(rows).drop("exams", "simultaneous")


@query(f"SELECT id, hours, CASE WHEN id%3=0 THEN NULL ELSE CAST(id%20 AS DOUBLE) END AS book_hours, id%3<>0 AS has_book, greatest(0.0, hours-CASE WHEN id%3=0 THEN 0 ELSE CAST(id%20 AS DOUBLE) END) AS hours_beyond_book FROM ({ESTIMATE})")
def book_or_app(spark, d):
    rows = planner.estimated(registry(spark, d)).select("id", "hours", F.when(F.col("id") % 3 != 0, (F.col("id") % 20).cast("double")).alias("book_hours"))
    return planner.book_or_app(rows)
