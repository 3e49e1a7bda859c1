"""Study plans: hours, progress, the next block, tips, timelines, plan advice."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quizmill.functions.numbers import half_hours, half_up, whole_days

# Seconds and shares of the hours model: fixed values
FIRST_READ, REPETITION, REPETITIONS = 90, 15, 5
QUESTION, REDO_SHARE, REDO = 165, 0.40, 90
SIMS, SIM_ITEMS, SIM_PACE = 2, 150, 84
WORDS_PER_MINUTE, REREAD = 200, 1.35
WORK_MINUTES, BREAK_MINUTES = 50, 10
PRO, ALL_ACCESS, BOOK = 7.99, 14.99, 9.99
WEEKS_PER_MONTH = 4.345
ACTIVITIES = ("glossary", "drills", "practice", "exams")
# Tips by number: those that a distraction calls up, the one that low focus does, and the general ones
TIP_OF = {"tv": 1, "phone": 2, "people": 3, "worry": 8, "toomuch": 9, "tired": 24}
FOCUS_TIP, FOCUS_BELOW = 12, 2.6
GENERAL = [k for k in range(1, 31) if k not in (*TIP_OF.values(), FOCUS_TIP)]


def hours_of(terms: int, questions: int) -> tuple[float, int, dict[str, float]]:
    """The same for one app: hours in all, one-hour blocks, hours of each activity."""
    t, q = max(0, terms), max(0, questions)
    seconds = {"glossary": t * FIRST_READ, "drills": t * REPETITION * REPETITIONS, "practice": q * QUESTION + q * REDO_SHARE * REDO, "exams": SIMS * min(SIM_ITEMS, q) * SIM_PACE}
    half = lambda x: math.floor(x / 1800 + 0.5) / 2
    total = sum(seconds.values())
    return half(total), max(1, math.ceil(total / 3600)), {k: half(x) for k, x in seconds.items()}


def estimated(rows: DataFrame, terms: str = "terms", questions: str = "questions") -> DataFrame:
    """Hours of each activity and in all, and one-hour blocks."""
    t, q = (F.greatest(F.lit(0), F.col(c)).cast("double") for c in (terms, questions))
    parts = {
        "glossary": t * FIRST_READ,
        "drills": t * REPETITION * REPETITIONS,
        "practice": q * QUESTION + q * REDO_SHARE * REDO,
        "exams": SIMS * F.least(F.lit(float(SIM_ITEMS)), q) * SIM_PACE,
    }
    total = parts["glossary"] + parts["drills"] + parts["practice"] + parts["exams"]
    return rows.select("*", half_hours(total).alias("hours"), F.greatest(F.lit(1), F.ceil(total / 3600)).cast("long").alias("blocks"), *(half_hours(v).alias(f"{k}_hours") for k, v in parts.items()))


def reading_hours(words: Column) -> Column:
    return half_hours(words / WORDS_PER_MINUTE * 60 * REREAD)


def clamped(minutes: Column, focus: Column, distractions: Column | None = None) -> tuple[Column, ...]:
    """A block as it is saved: minutes rounded and not negative, focus 1 to 5 and 3 by default, six distractions."""
    out = (F.greatest(F.lit(0), half_up(F.coalesce(minutes, F.lit(0.0)))).cast("long"), F.least(F.lit(5), F.greatest(F.lit(1), half_up(F.coalesce(F.when(focus != 0, focus), F.lit(3)).cast("double")))).cast("long"))
    return out if distractions is None else (*out, F.slice(F.coalesce(distractions, F.array()), 1, 6))


def saved_minutes(minutes: Column) -> tuple[Column, Column]:
    """Minutes as the planner's dialog saves them, and whether the block is too short to count."""
    m = F.least(F.lit(WORK_MINUTES), half_up(minutes)).cast("long")
    return m, m < 5


def phase(seconds: Column) -> Column:
    return F.when(seconds >= (WORK_MINUTES + BREAK_MINUTES) * 60, "over").when(seconds >= WORK_MINUTES * 60, "break").otherwise("work")


def progress(blocks: DataFrame, hours: float, total_blocks: int, days_left: int | None) -> DataFrame:
    """Per user: minutes, hours, full blocks, percent of the estimate, and blocks a week until the target."""
    total = F.round(F.sum("minutes"), 6)  # what is rounded next must not hang on the order in which doubles were added
    done = blocks.where("minutes > 0").groupBy("user_id").agg(total.alias("minutes"), F.count_if(F.col("minutes") >= WORK_MINUTES * 0.8).alias("blocks_done"))
    part = F.col("minutes") / (hours * 60) * 100 if hours > 0 else F.lit(100.0)
    left = F.greatest(F.lit(0), F.lit(total_blocks) - F.col("blocks_done"))
    week = F.ceil(left / (days_left / 7.0)).cast("long") if days_left else F.lit(None).cast("long")
    return done.select("user_id", "minutes", half_up(F.col("minutes") / 6).alias("tenths_of_hours"), "blocks_done", F.least(F.lit(100), half_up(part)).cast("long").alias("percent"), week.alias("blocks_per_week"))


def by_activity(blocks: DataFrame) -> DataFrame:
    """Minutes of each activity as one map a user."""
    each = blocks.where("minutes > 0").groupBy("user_id", "activity").agg(F.round(F.sum("minutes"), 6).alias("minutes"))
    return each.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("activity", "minutes")))).alias("by_activity"))


def recent_blocks(blocks: DataFrame, n: int = 6) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("id"))
    return blocks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def distractions(blocks: DataFrame) -> DataFrame:
    """How often each distraction came up in a user's last six blocks. blocks: user_id, id, ts, distractions."""
    return recent_blocks(blocks).select("user_id", F.explode("distractions").alias("distraction")).groupBy("user_id", "distraction").agg(F.count("*").alias("n"))


def focus(blocks: DataFrame) -> DataFrame:
    return recent_blocks(blocks).groupBy("user_id").agg(F.avg(F.coalesce(F.col("focus"), F.lit(0)).cast("double")).alias("avg_focus"), F.count("*").alias("recent"))


def next_block(done: DataFrame, targets: dict[str, float], percent: str = "percent") -> DataFrame:
    """The activity furthest behind its target minutes, the first of equals; exams only from 55 percent on.

    done: a row per user with minutes of each activity and the percent of the whole."""
    minutes = {a: F.coalesce(F.col(a), F.lit(0.0)) for a in ACTIVITIES}
    options = []
    for place, a in enumerate(ACTIVITIES):
        if targets.get(a, 0) > 0:
            lack = (targets[a] - minutes[a]) / targets[a]
            options.append(F.struct((F.lit(None).cast("double") if a == "exams" else lack).alias("lack") if a != "exams" else F.when(F.col(percent) >= 55, lack).alias("lack"), F.lit(-place).alias("place"), F.lit(a).alias("activity"), F.greatest(F.lit(0.0), targets[a] - minutes[a]).alias("left")))
    best = F.array_max(F.filter(F.array(*options), lambda o: o["lack"].isNotNull())) if options else F.lit(None)
    return done.withColumn("_best", best).select(*done.columns, F.coalesce(F.col("_best.activity"), F.lit("glossary")).alias("activity"), F.coalesce(F.col("_best.left"), F.lit(0.0)).alias("minutes_left"))


def tips(users: DataFrame, counts: DataFrame, limit: int = 3) -> DataFrame:
    """Numbers of the tips to show each user, in order. users: user_id, avg_focus, recent, done; counts: user_id, distraction, n."""
    known = F.create_map(*(x for k, v in TIP_OF.items() for x in (F.lit(k), F.lit(v))))
    hits = counts.join(users.select("user_id", "recent"), "user_id").where(F.col("n") >= F.when(F.col("recent") >= 4, 2).otherwise(1))
    called = hits.select("user_id", F.try_element_at(known, F.col("distraction")).alias("tip")).where("tip is not null").groupBy("user_id").agg(F.array_sort(F.collect_set("tip")).alias("called"))
    out = users.join(called, "user_id", "left")
    focus_tip = F.when((F.col("avg_focus") > 0) & (F.col("avg_focus") < FOCUS_BELOW), F.array(F.lit(FOCUS_TIP))).otherwise(F.array().cast("array<int>"))
    triggered = F.array_sort(F.concat(F.coalesce("called", F.array().cast("array<int>")), focus_tip))
    start = (F.col("done") * 2 % len(GENERAL)).cast("int")
    general = F.array(*map(F.lit, GENERAL))
    rotated = F.concat(F.slice(general, start + 1, len(GENERAL)), F.slice(general, F.lit(1), start))
    return out.select("user_id", F.slice(F.concat(triggered, rotated), 1, limit).alias("tips"))


def rotated(rows: DataFrame, start: Column, size: Column | int, place: str = "place") -> DataFrame:
    """``turn``: the place of each row when the list begins at ``start`` and wraps around."""
    return rows.withColumn("turn", F.pmod(F.col(place) - start, F.lit(size)).cast("long"))


def timeline(rows: DataFrame) -> DataFrame:
    """Whether the hours fit before the exam. rows: hours, days, hours_per_week."""
    ok = F.col("days").isNotNull() & (F.col("hours_per_week") > 0)
    days, hours = F.col("days"), F.col("hours")
    weeks = days / 7.0
    available = half_up(weeks * F.col("hours_per_week"), 1)
    share = F.when(hours > 0, available / F.nullif(hours, F.lit(0.0))).otherwise(F.lit(float("inf")))
    verdict = F.when(~ok | ok.isNull(), "unknown").when(days == 0, "past").when(share >= 1.25, "comfortable").when(share >= 1, "workable").when(share >= 0.7, "tight").otherwise("short")
    out = rows.withColumn("verdict", verdict).withColumn("available", F.when(ok, available)).withColumn("per_week_needed", F.when(ok & (days > 0), F.ceil(hours / F.nullif(weeks, F.lit(0.0)))).cast("long"))
    out = out.withColumn("shortfall", F.when(ok, F.greatest(F.lit(0.0), half_up(hours - F.col("available"), 1))))
    return out.withColumn("cuts", F.when(F.col("verdict").isin("tight", "short"), 4).otherwise(0).cast("long"))


def days_until(date: Column, as_of: str) -> Column:
    return whole_days(F.try_to_timestamp(date).cast("date"), F.to_date(F.lit(as_of)))


def planner_days_left(target: Column, as_of: str) -> Column:
    """Days from the moment to the target, begun days in full, never below 0."""
    gap = target.cast("timestamp").cast("double") - F.lit(as_of).cast("timestamp").cast("double")
    return F.when(gap.isNotNull(), F.greatest(F.lit(0), F.ceil(gap / 86400))).cast("long")


def months_of_study(hours: Column, per_week: Column) -> Column:
    return F.when(per_week > 0, F.greatest(F.lit(1), F.ceil(hours / F.nullif(per_week, F.lit(0.0)) / WEEKS_PER_MONTH)).cast("long"))


def plan_advice(rows: DataFrame) -> DataFrame:
    """What to buy for ``exams`` exams: rows: exams, simultaneous."""
    pick = F.when(F.col("exams") <= 1, "pro").when(F.col("simultaneous"), "all_access").otherwise("pro")
    out = rows.withColumn("pick", pick).withColumn("alternative", F.when((F.col("exams") > 1) & ~F.col("simultaneous"), "all_access"))
    return out.withColumn("pro_cents", F.col("exams") * round(PRO * 100)).withColumn("all_access_cents", F.lit(round(ALL_ACCESS * 100)).cast("long")).withColumn("saved_cents", F.col("pro_cents") - F.col("all_access_cents"))


def book_or_app(rows: DataFrame) -> DataFrame:
    """The study hours of the app against the reading hours of its book. rows: hours, book_hours."""
    return rows.withColumn("has_book", F.col("book_hours").isNotNull()).withColumn("hours_beyond_book", F.greatest(F.lit(0.0), F.col("hours") - F.coalesce("book_hours", F.lit(0.0))))
