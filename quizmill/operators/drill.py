"""Drill state from events: boxes, marks, counters, and progress by section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quizmill.functions.numbers import half_up

TOP_BOX = 3


def next_box(box: Column, score: Column) -> Column:
    return F.when(score == 2, F.least(box + 1, F.lit(TOP_BOX))).when(score == 1, box).otherwise(F.lit(0))


def boxes(events: DataFrame, *keys: str) -> DataFrame:
    """The box of each (user, item) after its scores in order of time: 2 moves up, 1 stays, others go to 0.

    A box never exceeds three, so only what follows the last fall matters: counts decide and no
    list of a key's events is held. events: the keys, ts, id, score."""
    own = Window.partitionBy(*keys).orderBy("ts", "id")
    after = F.sum(F.when(F.col("score").isin(1, 2), 0).otherwise(1)).over(own)
    fall = events.withColumn("_falls", after)
    each = fall.groupBy(*keys, "_falls").agg(F.count_if(F.col("score") == 2).alias("_ups"), F.max("ts").alias("_at"))
    last = each.groupBy(*keys).agg(F.max_by(F.struct("_ups", "_at"), "_falls").alias("_x"))
    return last.select(*keys, F.least(F.lit(TOP_BOX), F.col("_x._ups")).cast("long").alias("box"), F.col("_x._at").alias("at"))


def counters(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("seen"), F.count_if(F.col("score") == 2).alias("right"))


def marks(events: DataFrame, *keys: str) -> DataFrame:
    """The last mark of each card."""
    return events.groupBy(*keys).agg(F.max_by(F.when(F.col("score") > 0, "known").otherwise("again"), F.struct("ts", "id")).alias("mark"))


def section_progress(terms: DataFrame, drill: DataFrame, marks_: DataFrame, counters_: DataFrame, user: str = "user_id") -> DataFrame:
    """Per user and section: known %, said % (box 2 or more), mean accuracy of scenarios, mastery %. terms: item_id, section."""
    size = terms.groupBy("section").agg(F.count("*").alias("terms"))
    known = marks_.where("mark = 'known'").join(terms, "item_id").groupBy(user, "section").agg(F.count("*").alias("known"))
    said = drill.where("box >= 2").join(terms, "item_id").groupBy(user, "section").agg(F.count("*").alias("said"))
    acc = counters_.join(terms, "item_id").groupBy(user, "section").agg(F.avg(F.col("right") / F.col("seen").cast("double")).alias("accuracy"))
    out = acc.join(known, [user, "section"], "left").join(said, [user, "section"], "left").join(size, "section").fillna(0, ["known", "said"])
    share = lambda a, b: half_up(a * 100.0 / b)
    return out.select(user, "section", share(F.col("known"), F.col("terms")).alias("known_pct"), share(F.col("said"), F.col("terms")).alias("said_pct"), F.round("accuracy", 9).alias("accuracy"), share(F.col("known") + F.col("said"), 2 * F.col("terms")).alias("mastery"))


def ruler(drill: DataFrame, marks_: DataFrame, n: int, user: str = "user_id") -> DataFrame:
    """Share of all terms that are known or in box 2 or more."""
    good = marks_.where("mark = 'known'").select(user, "item_id").union(drill.where("box >= 2").select(user, "item_id")).distinct()
    return good.groupBy(user).agg((F.count("*") / float(n)).alias("mastered"))


def review_queue(items: DataFrame, user: str = "user_id") -> DataFrame:
    """Lowest box first, then the longest ago, then the given place. items: box, at, place (nulls: never met)."""
    order = Window.partitionBy(user).orderBy(F.coalesce("box", F.lit(0)), F.col("at").asc_nulls_first(), "place")
    return items.withColumn("rank", F.row_number().over(order).cast("long"))
