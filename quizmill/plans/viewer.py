"""Queries by SQL functions that show a viewer's rows only."""

from __future__ import annotations

from quizmill.plans import access, learner
from quizmill.plans.registry import query
from quizmill.sources import viewer

#: Whose rows the queries show.
USER = 7


def _asked(spark, d, statement):
    viewer.install(spark, d)
    viewer.view_as(spark, USER)
    return spark.sql(statement)


@query(f"SELECT category, total, correct, accuracy, last_seen FROM ({learner.STATS}) WHERE user_id={USER}", "responses")
def sql_category_stats(spark, d):
    return _asked(spark, d, "SELECT * FROM my_category_stats()")


@query(f"SELECT day, total, correct, accuracy FROM ({learner.TREND}) WHERE user_id={USER}", "responses")
def sql_daily_trend(spark, d):
    return _asked(spark, d, "SELECT * FROM my_daily_trend()")


@query(f"SELECT item_id, category, attempts, misses, miss_rate FROM ({learner.WEAK}) WHERE user_id={USER} AND rank<=10", "responses")
def sql_weakest_items(spark, d):
    return _asked(spark, d, "SELECT * FROM my_weakest_items(10)")


@query(learner.DIFFICULTY, "responses")
def sql_item_difficulty(spark, d):
    """A figure of all users' answers, whoever views it."""
    return _asked(spark, d, "SELECT * FROM item_difficulty()")


@query(f"SELECT id, correct, total, finished_at FROM study_sessions WHERE user_id={USER} ORDER BY finished_at DESC, id DESC LIMIT 5", "study_sessions")
def sql_sessions(spark, d):
    return _asked(spark, d, "SELECT * FROM my_sessions(5)")


@query(f"SELECT coalesce((SELECT streak FROM ({learner.STREAK.format(t='created_at', v='responses')}) WHERE user_id={USER}), 0) AS streak, tier, tier_app, {access.ACT} AS is_active, (SELECT count(DISTINCT slug) FROM purchases WHERE customer={USER}) AS books, coalesce((SELECT string_agg(slug, ',' ORDER BY first_at, slug) FROM (SELECT slug, min(created_at) AS first_at FROM purchases WHERE customer={USER} GROUP BY 1)), '') AS slugs, c_custkey AS customer, (SELECT count(DISTINCT slug) FROM purchases WHERE customer=c_custkey) AS n FROM profiles, customer WHERE id={USER}", "responses profiles purchases")
def sql_account(spark, d):
    """Streak, tier and books of the viewer, beside each customer's number of books, for which the function is asked row by row."""
    return _asked(spark, d, "SELECT s.streak, t.tier, t.tier_app, t.is_active, k.n AS books, array_join(CAST(e.ebooks AS ARRAY<STRING>), ',') AS slugs, c.customer, c.n FROM my_streak() s, my_tier() t, my_ebook_count() k, my_ebooks() e, (SELECT c_custkey AS customer, n.n FROM parquet.`" + f"{d}/customer.parquet`" + " , LATERAL ebook_count_for_customer(c_custkey) n) c")
