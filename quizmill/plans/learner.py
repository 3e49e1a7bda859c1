"""Queries on answers, sessions and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill.operators import learner, recommend
from quizmill.plans.registry import query
from quizmill.sources import tables
from quizmill.sources.tables import AS_OF

TS = f"TIMESTAMP '{AS_OF}'"
STATS = "SELECT user_id, category, count(*) AS total, count(*) FILTER (WHERE correct) AS correct, round(count(*) FILTER (WHERE correct)/CAST(greatest(count(*),1) AS DOUBLE),3) AS accuracy, max(created_at) AS last_seen FROM responses GROUP BY user_id, category"
TREND = f"SELECT user_id, CAST(created_at AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE correct) AS correct, round(count(*) FILTER (WHERE correct)/CAST(count(*) AS DOUBLE),3) AS accuracy FROM responses WHERE created_at > {TS} - INTERVAL 30 DAYS GROUP BY 1, 2"
WEAK = "SELECT user_id, item_id, category, attempts, misses, miss_rate, row_number() OVER (PARTITION BY user_id ORDER BY miss_rate DESC, misses DESC, item_id, category) AS rank FROM (SELECT user_id, item_id, category, count(*) AS attempts, count(*) FILTER (WHERE NOT correct) AS misses, round(count(*) FILTER (WHERE NOT correct)/CAST(count(*) AS DOUBLE),3) AS miss_rate FROM responses GROUP BY 1,2,3) WHERE misses>0"
DIFFICULTY = "SELECT item_id, count(*) AS attempts, round(1-count(*) FILTER (WHERE correct)/CAST(count(*) AS DOUBLE),3) AS difficulty FROM responses GROUP BY item_id HAVING count(*)>=3"
ISLANDS = "SELECT user_id, count(*) AS days, max(day) AS last_day FROM (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM (SELECT DISTINCT user_id, CAST({t} AS DATE) AS day FROM {v})) GROUP BY user_id, island"
STREAK = "SELECT user_id, CAST(arg_max(CASE WHEN last_day >= DATE '2024-01-29' THEN days ELSE 0 END, last_day) AS BIGINT) AS streak FROM (" + ISLANDS + ") GROUP BY user_id"


@query(STATS, "responses")
def category_stats(spark, d):
    return learner.category_stats(tables.responses(spark, d))


@query(TREND, "responses")
def daily_trend(spark, d):
    return learner.daily_trend(tables.responses(spark, d), AS_OF)


@query(DIFFICULTY, "responses")
def item_difficulty(spark, d):
    return learner.item_difficulty(tables.responses(spark, d))


@query(f"SELECT * FROM ({WEAK}) WHERE rank<=30", "responses")
def weakest_items(spark, d):
    return learner.weakest_items(tables.responses(spark, d))


@query("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY finished_at DESC, id DESC) AS rank FROM study_sessions) WHERE rank<=20", "study_sessions")
def recent_sessions(spark, d):
    return learner.recent(tables.study_sessions(spark, d), 20, "finished_at")


@query(STREAK.format(t="created_at", v="responses"), "responses")
def day_streak(spark, d):
    return learner.streak(tables.responses(spark, d), AS_OF)


@query(STREAK.format(t="ts", v="plan_events WHERE minutes>0"), "plan_events")
def planner_streak(spark, d):
    return learner.streak(tables.plan_events(spark, d).where("minutes > 0"), AS_OF, "ts")


@query("SELECT DISTINCT user_id, CAST(created_at AS DATE) AS day FROM responses", "responses")
def active_days(spark, d):
    return learner.active_days(tables.responses(spark, d))


@query("SELECT user_id, category, count(*) AS total, count(*) FILTER (WHERE correct) AS correct, min(id) AS first_id, count(*) FILTER (WHERE correct)/CAST(count(*) AS DOUBLE) AS accuracy FROM responses GROUP BY 1,2", "responses")
def local_stats(spark, d):
    return learner.local_stats(tables.responses(spark, d))


@query("SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY miss_rate DESC, first_id) AS rank FROM (SELECT user_id, item_id, arg_min(category,id) AS category, count(*) AS attempts, count(*) FILTER (WHERE NOT correct) AS misses, min(id) AS first_id, count(*) FILTER (WHERE NOT correct)/CAST(count(*) AS DOUBLE) AS miss_rate FROM responses GROUP BY 1,2) WHERE misses>0", "responses")
def weakest_items_local(spark, d):
    return learner.local_weak_items(tables.responses(spark, d))


@query("SELECT user_id, count(*) AS total, count(*) FILTER (WHERE correct) AS correct, CAST(floor(count(*) FILTER (WHERE correct)*100.0::DOUBLE/count(*)+0.5) AS BIGINT) AS percent FROM responses GROUP BY 1", "responses")
def dashboard_headline(spark, d):
    return learner.headline(tables.responses(spark, d))


@query(f"SELECT *, CASE WHEN percent>=85 THEN 'high' WHEN percent>=70 THEN 'mid' ELSE 'low' END AS band FROM (SELECT *, CAST(floor(accuracy*100+0.5) AS BIGINT) AS percent FROM ({STATS}))", "responses")
def dashboard_bands(spark, d):
    return learner.banded(learner.category_stats(tables.responses(spark, d)))


@query(f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, accuracy, category) AS rank FROM (SELECT *, CAST(CASE WHEN accuracy<0.5 THEN 3 WHEN accuracy<0.7 THEN 2 WHEN accuracy<0.85 THEN 1 ELSE 0 END AS BIGINT) AS priority FROM ({STATS}))", "responses")
def study_plan(spark, d):
    return learner.study_plan(learner.category_stats(tables.responses(spark, d)))


@query(f"SELECT user_id, day, CASE WHEN count(*) OVER w>1 THEN (row_number() OVER (PARTITION BY user_id ORDER BY day)-1)/CAST(count(*) OVER w-1 AS DOUBLE) ELSE 0.0 END AS x, 1-accuracy AS y, total/CAST(max(total) OVER w AS DOUBLE) AS volume FROM ({TREND}) WINDOW w AS (PARTITION BY user_id)", "responses")
def trend_points(spark, d):
    return learner.trend_points(learner.daily_trend(tables.responses(spark, d), AS_OF))


@query("SELECT id, user_id, CAST(floor(CAST(correct AS DOUBLE)/total*100+0.5) AS BIGINT) AS percent FROM study_sessions", "study_sessions")
def session_scores(spark, d):
    return learner.session_scores(tables.study_sessions(spark, d))


@query("SELECT user_id, id, created_at, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank FROM responses) WHERE rank<=2000", "responses")
def history_ring(spark, d):
    return learner.recent(tables.responses(spark, d), 2000, "created_at").select("user_id", "id", "created_at", "rank")


@query("SELECT * FROM responses WHERE user_id=7", "responses")
def owner_rows(spark, d):
    return tables.owned_by(tables.responses(spark, d), 7)


@query("SELECT user_id, count(*) AS n FROM responses GROUP BY 1", "responses")
def exact_counts(spark, d):
    return tables.responses(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"SELECT h.user_id, h.total, h.correct, h.percent, s.streak, coalesce(t.n,0) AS trend_days, coalesce(x.n,0) AS sessions_shown, coalesce(p.n,0) AS to_work_on FROM (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE correct) AS correct, CAST(floor(count(*) FILTER (WHERE correct)*100.0::DOUBLE/count(*)+0.5) AS BIGINT) AS percent FROM responses GROUP BY 1) h JOIN ({STREAK.format(t='created_at', v='responses')}) s USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS n FROM ({TREND}) GROUP BY 1) t USING (user_id) LEFT JOIN (SELECT user_id, least(count(*),10) AS n FROM study_sessions GROUP BY 1) x USING (user_id) LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE accuracy<0.7) AS n FROM ({STATS}) GROUP BY 1) p USING (user_id)", "responses study_sessions")
def dashboard(spark, d):
    return learner.dashboard(tables.responses(spark, d), tables.study_sessions(spark, d), AS_OF)


# A server that has two users in three, and devices that keep every other answer of most users
SRV = "srv AS (SELECT * FROM responses WHERE user_id%3<>0)"
LOC = "loc AS (SELECT * FROM responses WHERE id%2=0 AND user_id%7<>0 AND user_id NOT IN (SELECT user_id FROM srv))"
SRV_STREAK, SRV_TREND, SRV_STATS = STREAK.format(t="created_at", v="srv"), TREND.replace("responses", "srv"), STATS.replace("responses", "srv")
LOC_STATS = "SELECT user_id, category, count(*) FILTER (WHERE correct)/CAST(count(*) AS DOUBLE) AS accuracy FROM loc GROUP BY 1,2"


def _server_and_local(spark, d):
    r = tables.responses(spark, d)
    return r.where("user_id % 3 <> 0"), r.where("id % 2 = 0 and user_id % 7 <> 0")


@query(f"WITH {SRV}, {LOC}, h AS (SELECT user_id, source, count(*) AS total, count(*) FILTER (WHERE correct) AS correct, CAST(floor(count(*) FILTER (WHERE correct)*100.0::DOUBLE/count(*)+0.5) AS BIGINT) AS percent FROM (SELECT *, 'server' AS source FROM srv UNION ALL SELECT *, 'local' FROM loc) GROUP BY 1,2) SELECT h.user_id, h.source, h.total, h.correct, h.percent, coalesce(s.streak,0) AS streak, coalesce(t.n,0) AS trend_days, CASE WHEN h.source='server' THEN coalesce(x.n,0) ELSE 0 END AS sessions_shown, coalesce(p.n,0) AS to_work_on FROM h LEFT JOIN ({SRV_STREAK}) s USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS n FROM ({SRV_TREND}) GROUP BY 1) t USING (user_id) LEFT JOIN (SELECT user_id, least(count(*),10) AS n FROM study_sessions GROUP BY 1) x USING (user_id) LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE accuracy<0.7) AS n FROM (SELECT user_id, accuracy FROM ({SRV_STATS}) UNION ALL SELECT user_id, accuracy FROM ({LOC_STATS})) GROUP BY 1) p USING (user_id)", "responses study_sessions")
def dashboard_by_source(spark, d):
    return learner.dashboard_by_source(*_server_and_local(spark, d), tables.study_sessions(spark, d), AS_OF)


def _items(spark, d):
    """Every item that a user has met, with its category."""
    return tables.responses(spark, d).groupBy("user_id", "item_id").agg(F.min("category").alias("cat"))


def _scores(spark, d):
    r = tables.responses(spark, d)
    return recommend.scored(_items(spark, d), learner.category_stats(r), learner.weakest_items(r, 60), learner.item_difficulty(r))


SCORES = f"SELECT i.user_id, i.item_id, i.cat, CASE WHEN s.accuracy IS NOT NULL THEN (1-s.accuracy)*10 ELSE 5.0 END + coalesce(w.miss_rate*6,0.0) + coalesce(f.difficulty*3,0.0) AS score FROM (SELECT user_id, item_id, min(category) AS cat FROM responses GROUP BY 1,2) i LEFT JOIN ({STATS}) s ON i.user_id=s.user_id AND i.cat=s.category LEFT JOIN (SELECT user_id, item_id, arg_min(miss_rate,rank) AS miss_rate FROM ({WEAK}) WHERE rank<=60 GROUP BY 1,2) w ON i.user_id=w.user_id AND i.item_id=w.item_id LEFT JOIN ({DIFFICULTY}) f ON i.item_id=f.item_id"
CAPPED = f"SELECT user_id, item_id, cat, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, cat ORDER BY score DESC, item_id) AS k FROM ({SCORES})) WHERE k<=4) WHERE rank<=10"


@query(SCORES, "responses")
def recommend_scores(spark, d):
    return _scores(spark, d)


@query(CAPPED, "responses")
def recommend_capped(spark, d):
    return recommend.capped(_scores(spark, d), 10)


PADDED = f"WITH s AS ({SCORES}), best AS ({CAPPED}), fill AS (SELECT user_id, item_id, cat, score, row_number() OVER (PARTITION BY user_id ORDER BY md5(item_id||':0'), item_id) AS rank FROM s ANTI JOIN best USING (user_id, item_id)), have AS (SELECT user_id, count(*) AS n FROM best GROUP BY 1) SELECT user_id, item_id, cat, rank FROM best UNION ALL SELECT fill.user_id, item_id, cat, rank+coalesce(n,0) FROM fill LEFT JOIN have ON fill.user_id=have.user_id WHERE rank+coalesce(n,0)<=10"


@query(PADDED, "responses")
def recommend_padded(spark, d):
    return recommend.padded(_scores(spark, d), 10).select("user_id", "item_id", "cat", "rank")


@query(f"SELECT user_id, category, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY accuracy, category) AS rank FROM ({STATS}) WHERE accuracy<0.7) WHERE rank<=2", "responses")
def recommend_reasons(spark, d):
    return recommend.reasons(learner.category_stats(tables.responses(spark, d)))


@query("SELECT id, cat, sub, row_number() OVER (ORDER BY t, cat) AS place FROM (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY id) AS t FROM bank) QUALIFY place<=10", "bank")
def free_sample(spark, d):
    return recommend.round_robin(tables.bank(spark, d), 10, "cat", "id").select("id", "cat", "sub", "place")


@query("SELECT id, cat, sub, row_number() OVER (ORDER BY t, coalesce(sub,'_')) AS place FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(sub,'_') ORDER BY id) AS t FROM bank) QUALIFY place<=10", "bank")
def free_sample_by_sub(spark, d):
    return recommend.round_robin(tables.bank(spark, d), 10, "sub", "id").select("id", "cat", "sub", "place")


@query("SELECT *, md5(id||':1') AS shuffle_key FROM bank ORDER BY shuffle_key", "bank")
def shuffled_bank(spark, d):
    return recommend.shuffled(tables.bank(spark, d), 1, "id").orderBy("shuffle_key")


@query("SELECT * FROM responses WHERE id=7", "responses")
def one_answer(spark, d):
    return tables.lookup(tables.responses(spark, d), "id", 7)
