"""Aggregates over answers and sessions: accuracy, trends, difficulty, weak items, streaks, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quizmill.functions.numbers import half_up, percent, ratio, score_percent

TRUE = F.count_if


def _moment(as_of: str) -> Column:
    return F.expr(f"timestamp_ntz'{as_of}'")


def category_stats(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("user_id", "category").agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"), F.max("created_at").alias("last_seen"))
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def daily_trend(rows: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Of the days in which something was answered, after the moment that many days before."""
    recent = rows.where(F.col("created_at") > _moment(as_of) - F.expr(f"INTERVAL {days} DAYS"))
    out = recent.groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"))
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def item_difficulty(rows: DataFrame, least: int = 3) -> DataFrame:
    out = rows.groupBy("item_id").agg(F.count("*").alias("attempts"), F.count_if("correct").alias("correct")).where(F.col("attempts") >= least)
    return out.select("item_id", "attempts", F.round(1 - F.col("correct") / F.col("attempts").cast("double"), 3).alias("difficulty"))


def weakest_items(rows: DataFrame, limit: int = 30) -> DataFrame:
    """The items of each user that were missed most often, by item and category; ``rank`` is the order."""
    out = rows.groupBy("user_id", "item_id", "category").agg(F.count("*").alias("attempts"), F.count_if(~F.col("correct")).alias("misses")).where("misses > 0")
    out = out.withColumn("miss_rate", ratio(F.col("misses"), F.col("attempts")))
    order = Window.partitionBy("user_id").orderBy(F.desc("miss_rate"), F.desc("misses"), "item_id", "category")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).withColumn("rank", F.col("rank").cast("long"))


def recent(rows: DataFrame, limit: int, time: str, key: str = "id", owner: str = "user_id") -> DataFrame:
    """The newest rows of each owner."""
    order = Window.partitionBy(owner).orderBy(F.desc(time), F.desc(key))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).withColumn("rank", F.col("rank").cast("long"))


def active_days(rows: DataFrame, time: str = "created_at") -> DataFrame:
    return rows.select("user_id", F.to_date(time).alias("day")).distinct()


def streak(rows: DataFrame, as_of: str, time: str = "created_at") -> DataFrame:
    """Days in a row that end on the day of ``as_of`` or the one before, else 0."""
    today = F.to_date(F.lit(as_of))
    order = Window.partitionBy("user_id").orderBy("day")
    islands = active_days(rows, time).withColumn("island", F.date_sub("day", F.row_number().over(order)))
    runs = islands.groupBy("user_id", "island").agg(F.count("*").alias("days"), F.max("day").alias("last_day"))
    alive = F.when(F.col("last_day") >= F.date_sub(today, 1), F.col("days")).otherwise(0)
    return runs.groupBy("user_id").agg(F.max_by(alive, "last_day").cast("long").alias("streak"))


def local_stats(rows: DataFrame) -> DataFrame:
    """Per category, unrounded, with the place at which the category first came up."""
    out = rows.groupBy("user_id", "category").agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"), F.min("id").alias("first_id"))
    return out.withColumn("accuracy", F.col("correct") / F.col("total").cast("double"))


def local_weak_items(rows: DataFrame) -> DataFrame:
    """Per item alone, with the category it was first seen in, unrounded; ties keep their first order."""
    out = rows.groupBy("user_id", "item_id").agg(F.min_by("category", "id").alias("category"), F.count("*").alias("attempts"), F.count_if(~F.col("correct")).alias("misses"), F.min("id").alias("first_id")).where("misses > 0")
    out = out.withColumn("miss_rate", F.col("misses") / F.col("attempts").cast("double"))
    order = Window.partitionBy("user_id").orderBy(F.desc("miss_rate"), "first_id")
    return out.withColumn("rank", F.row_number().over(order).cast("long"))


def headline(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"))
    return out.withColumn("percent", percent(F.col("correct"), F.col("total")))


def banded(rows: DataFrame) -> DataFrame:
    """A dashboard row per user and category: rounded percent and its band."""
    out = rows.withColumn("percent", half_up(F.col("accuracy") * 100))
    return out.withColumn("band", F.when(F.col("percent") >= 85, "high").when(F.col("percent") >= 70, "mid").otherwise("low"))


def study_plan(stats: DataFrame) -> DataFrame:
    """What to do for each category: priority 3 to 0 by accuracy, in the order to do it."""
    acc = F.col("accuracy")
    out = stats.withColumn("priority", F.when(acc < 0.5, 3).when(acc < 0.7, 2).when(acc < 0.85, 1).otherwise(0).cast("long"))
    order = Window.partitionBy("user_id").orderBy(F.desc("priority"), "accuracy", "category")
    return out.withColumn("rank", F.row_number().over(order).cast("long"))


def trend_points(trend: DataFrame) -> DataFrame:
    """A trend in a unit square: x by day, y = 1 - accuracy, volume by the user's largest day."""
    own = Window.partitionBy("user_id")
    place = F.row_number().over(own.orderBy("day")) - 1
    n = F.count("*").over(own)
    return trend.select("user_id", "day", F.when(n > 1, place / (n - 1).cast("double")).otherwise(F.lit(0.0)).alias("x"), (1 - F.col("accuracy")).alias("y"), (F.col("total") / F.max("total").over(own).cast("double")).alias("volume"))


def session_scores(sessions: DataFrame) -> DataFrame:
    return sessions.select("id", "user_id", score_percent(F.col("correct"), F.col("total")).alias("percent"))


SERVER, LOCAL = 1, 0


def tagged(server: DataFrame, local: DataFrame) -> DataFrame:
    """Answers that the server has and answers that devices keep, told apart by ``from``. Both: user_id, item_id, category, correct, created_at, id."""
    columns = ("user_id", "item_id", "category", "correct", "created_at", "id")
    return server.select(*columns, F.lit(SERVER).alias("from")).unionByName(local.select(*columns, F.lit(LOCAL).alias("from")))


def chosen(rows: DataFrame) -> DataFrame:
    """Of each user what the server has, and what devices keep only where it has nothing. rows: summed up already, user_id and ``from``."""
    best = F.max("from").over(Window.partitionBy("user_id"))
    return rows.withColumn("_best", best).where(F.col("from") == F.col("_best")).drop("_best")


def accuracy_from(correct: Column, total: Column) -> Column:
    """The server rounds its shares, devices do not."""
    return F.when(F.col("from") == SERVER, ratio(correct, total)).otherwise(correct / total.cast("double"))


def source_name() -> Column:
    return F.when(F.col("from") == SERVER, "server").otherwise("local")


def shares(rows: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """By user and ``from``: total, correct, percent, streak, trend_days and to_work_on, in one pass over the answers, which are summed up
    by category and by day at once. A user's days are as many as the calendar has."""
    recent_ = F.col("created_at") > _moment(as_of) - F.expr(f"INTERVAL {days} DAYS")
    each = rows.select("user_id", "from", "category", F.to_date("created_at").alias("day"), "correct", recent_.alias("recent"))
    by = each.groupingSets([["user_id", "from", "category"], ["user_id", "from", "day"]], "user_id", "from", "category", "day").agg(
        F.grouping("day").alias("of_category"), F.count("*").alias("total"), F.count_if("correct").alias("correct"), F.count_if("recent").alias("recent")
    )
    category = F.col("of_category") == 1
    weak = category & (accuracy_from(F.col("correct"), F.col("total")) < 0.7)
    out = by.groupBy("user_id", "from").agg(
        F.sum(F.when(category, F.col("total"))).alias("total"),
        F.sum(F.when(category, F.col("correct"))).alias("correct"),
        F.count_if(~category & (F.col("recent") > 0)).alias("trend_days"),
        F.count_if(weak).alias("to_work_on"),
        F.array_sort(F.collect_list(F.when(~category, F.col("day")))).alias("days"),
    )
    island = F.transform("days", lambda d, k: F.date_sub(d, k))
    last = F.element_at(F.when(F.size("days") > 0, F.col("days")), -1)
    run = F.size(F.filter(island, lambda x: x == F.date_sub(last, F.size("days") - 1))).cast("long")
    alive = F.when(last >= F.date_sub(F.to_date(F.lit(as_of)), 1), run).otherwise(F.lit(0).cast("long"))
    return out.select("user_id", "from", "total", "correct", percent(F.col("correct"), F.col("total")).alias("percent"), alive.alias("streak"), "trend_days", "to_work_on")


def _shown(sessions: DataFrame, most: int = 10) -> DataFrame:
    return sessions.groupBy("user_id").agg(F.least(F.count("*"), F.lit(most).cast("long")).alias("sessions_shown"))


def dashboard(rows: DataFrame, sessions: DataFrame, as_of: str) -> DataFrame:
    """One row per user: headline, streak, days on the trend, sessions shown and categories to work on."""
    out = shares(rows.withColumn("from", F.lit(SERVER)), as_of).join(_shown(sessions), "user_id", "left")
    return out.select("user_id", "total", "correct", "percent", "streak", "trend_days", F.coalesce("sessions_shown", F.lit(0)).alias("sessions_shown"), "to_work_on")


def dashboard_by_source(server: DataFrame, local: DataFrame, sessions: DataFrame, as_of: str) -> DataFrame:
    """The dashboard of every user that either has: from the server's answers, else from the device's, which know no trend, sessions or streak; ``source`` says which."""
    own = F.col("from") == SERVER
    zero = F.lit(0).cast("long")
    out = chosen(shares(tagged(server, local), as_of)).join(_shown(sessions), "user_id", "left")
    return out.select("user_id", source_name().alias("source"), "total", "correct", "percent", F.when(own, F.col("streak")).otherwise(zero).alias("streak"), F.when(own, F.col("trend_days")).otherwise(zero).alias("trend_days"), F.when(own, F.coalesce("sessions_shown", zero)).otherwise(zero).alias("sessions_shown"), "to_work_on")
