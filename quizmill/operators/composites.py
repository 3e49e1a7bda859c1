"""Operators that put others together, and small ones around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quizmill.operators import learner, planner, recommend


def recommended(items: DataFrame, responses: DataFrame, n: int, seed: int = 0, jitter: float = 0.0) -> DataFrame:
    """What each user should study next: the capped and padded best; a user without answers gets n items in shuffled order.

    items: user_id, item_id, cat for every user and item on offer."""
    noise = None if not jitter else F.conv(F.substring(recommend.shuffle_key(seed, "user_id", "item_id"), 1, 5), 16, 10).cast("double") / float(1 << 20) * jitter
    known = items.join(responses.select("user_id").distinct(), "user_id", "left_semi")
    warm = recommend.padded(recommend.scored(known, learner.category_stats(responses), learner.weakest_items(responses, 60), learner.item_difficulty(responses), noise), n, seed)
    cold = items.join(responses.select("user_id").distinct(), "user_id", "left_anti")
    order = Window.partitionBy("user_id").orderBy(recommend.shuffle_key(seed, "item_id"), "item_id")
    cold = cold.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)
    return warm.unionByName(cold.select("user_id", "item_id", "cat", F.lit(None).cast("double").alias("score"), "rank"))


def recommended_by_source(items: DataFrame, server: DataFrame, local: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """What each user should study next, from the server's figures, else from the device's, else in shuffled order; ``source`` and ``reason`` say why.

    The answers of both are summed up once by user, item and category, and all figures come from these sums. Devices know neither rounded
    shares nor how hard an item is to others. items: user_id, item_id, cat for every user and item on offer."""
    sums = learner.tagged(server, local).groupBy("user_id", "from", "item_id", "category").agg(F.count("*").alias("attempts"), F.count_if("correct").alias("correct"), F.min("id").alias("first_id"))
    stats = learner.chosen(sums.groupBy("user_id", "from", "category").agg(F.sum("attempts").alias("total"), F.sum("correct").alias("right")))
    stats = stats.withColumn("accuracy", learner.accuracy_from(F.col("right"), F.col("total")))
    misses = F.col("attempts") - F.col("correct")
    rate = F.round(misses / F.col("attempts").cast("double"), 3)
    order = Window.partitionBy("user_id").orderBy(F.desc("miss_rate"), F.desc("misses"), "item_id", "category")
    weak = sums.where((F.col("from") == learner.SERVER) & (misses > 0)).withColumns({"miss_rate": rate, "misses": misses}).withColumn("rank", F.row_number().over(order)).where("rank <= 60").select("user_id", "item_id", "miss_rate", "rank")
    own = sums.where(F.col("from") == learner.LOCAL).groupBy("user_id", "item_id").agg(F.sum("attempts").alias("attempts"), F.sum("correct").alias("correct")).where(misses > 0)
    own = own.select("user_id", "item_id", (misses / F.col("attempts").cast("double")).alias("miss_rate"), F.lit(1).alias("rank"))
    hard = sums.where(F.col("from") == learner.SERVER).groupBy("item_id").agg(F.sum("attempts").alias("attempts"), F.sum("correct").alias("correct")).where("attempts >= 3")
    hard = hard.select("item_id", F.round(1 - F.col("correct") / F.col("attempts").cast("double"), 3).alias("difficulty"))
    who = stats.groupBy("user_id").agg(F.max("from").alias("from"))
    known = items.join(who, "user_id", "left")
    warm = lambda of, weak_, hard_: recommend.scored(known.where(F.col("from") == of).drop("from"), stats.where(F.col("from") == of), weak_, hard_)
    best = recommend.padded(warm(learner.SERVER, weak, hard).unionByName(warm(learner.LOCAL, own, hard.where(F.lit(False)))), n, seed)
    shuffled = Window.partitionBy("user_id").orderBy(recommend.shuffle_key(seed, "item_id"), "item_id")
    cold = known.where(F.col("from").isNull()).withColumn("rank", F.row_number().over(shuffled).cast("long")).where(F.col("rank") <= n)
    told = recommend.reasons(stats).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "category"))), lambda x: x["category"]), ", ").alias("weakest"))
    reason = F.when(F.col("weakest").isNotNull(), F.concat(F.lit("weak: "), "weakest")).otherwise("all good")
    best = best.join(who, "user_id").join(told, "user_id", "left").select("user_id", "item_id", "cat", "rank", learner.source_name().alias("source"), reason.alias("reason"))
    return best.unionByName(cold.select("user_id", "item_id", "cat", "rank", F.lit("none").alias("source"), F.lit("no answers yet").alias("reason")))


def summary(blocks: DataFrame, terms: int, questions: int, days_left: int | None, limit: int = 3) -> DataFrame:
    """One record per user: estimate, progress, next block and tips. blocks: user_id, id, ts, activity, minutes, focus, distractions."""
    hours, total, parts = planner.hours_of(terms, questions)
    moved = planner.progress(blocks, hours, total, days_left)
    each = blocks.where("minutes > 0").groupBy("user_id").agg(*(F.round(F.sum(F.when(F.col("activity") == a, F.col("minutes"))), 6).alias(a) for a in planner.ACTIVITIES))
    targets = {a: parts[a] * 60 for a in planner.ACTIVITIES}
    next_ = planner.next_block(each.join(moved.select("user_id", "percent"), "user_id"), targets).select("user_id", F.col("activity").alias("next_activity"), "minutes_left")
    done = blocks.groupBy("user_id").agg(F.count_if(F.col("minutes") > 0).alias("done"))
    tips = planner.tips(planner.focus(blocks).join(done, "user_id"), planner.distractions(blocks), limit)
    return moved.join(next_, "user_id").join(tips, "user_id").withColumn("hours", F.lit(hours)).withColumn("blocks", F.lit(total).cast("long"))


def advice(rows: DataFrame) -> DataFrame:
    """Timeline, plan and book against app in one row. rows: hours, days, hours_per_week, exams, simultaneous, book_hours."""
    return planner.book_or_app(planner.plan_advice(planner.timeline(rows)))


def sized(apps: DataFrame) -> DataFrame:
    """An app's size as the coach tells it: hours, blocks and the hours of each activity in one record."""
    out = planner.estimated(apps)
    return out.withColumn("size", F.struct("hours", "blocks", F.struct(*(F.col(f"{a}_hours").alias(a) for a in planner.ACTIVITIES)).alias("parts")))


def session_rows(sessions: DataFrame) -> DataFrame:
    """Sessions as they are stored: an absent configuration is an empty one."""
    return sessions.withColumn("config", F.coalesce("config", F.lit("{}")))


def answer_rows(answers: DataFrame, as_of: Column) -> DataFrame:
    """Answers as they are stored: stamped, a time of 0 unknown."""
    return answers.withColumn("time_ms", F.nullif("time_ms", F.lit(0))).withColumn("created_at", F.coalesce("created_at", as_of))


def writable(rows: DataFrame, viewer: Column, owner: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """(rows that the viewer may write, the others)."""
    own = F.coalesce(F.col(owner) == viewer, F.lit(False))
    return rows.where(own), rows.where(~own)


def owns(books: Column, slug: Column) -> Column:
    """Whether an array of owned slugs, which may be null, has the slug."""
    return F.coalesce(F.array_contains(books, slug), F.lit(False))


def titled(events: DataFrame, titles: DataFrame) -> DataFrame:
    """Events' slugs as titles, in order; an unknown slug stays. events: id, slugs; titles: slug, title."""
    each = events.select("id", F.posexplode("slugs").alias("at", "slug")).join(titles, "slug", "left")
    return each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("title", F.col("slug")).alias("t")))), lambda x: x["t"]).alias("titles"))


def blurb(*parts: Column) -> Column:
    """Optional parts on one line."""
    return F.concat_ws(" · ", *(F.nullif(p, F.lit("")) for p in parts))


def in_order(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """The rows of the first, then of the second, up to a small limit; ``place`` in both gives the order."""
    both = first.withColumn("_part", F.lit(0)).unionByName(second.withColumn("_part", F.lit(1)))
    return both.orderBy("_part", "place").limit(limit)


def readiness(settings: DataFrame) -> DataFrame:
    """Settings that block a release: half of a pair set, or a secret key where a public one belongs.

    settings: app, url, key, prefix (what a secret key begins with)."""
    unset = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    secret = F.coalesce(F.col("key").startswith(F.col("prefix")), F.lit(False))
    problem = F.when(unset("url") != unset("key"), "half set").when(secret, "secret key")
    return settings.withColumn("problem", problem).where("problem is not null")


def uncached(imports: DataFrame, shell: DataFrame) -> DataFrame:
    """Imported files that a shell's list lacks. imports, shell: app, file."""
    return imports.distinct().join(shell.distinct(), ["app", "file"], "left_anti")

