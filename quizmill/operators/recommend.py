"""Which questions to study next, and samples that are even over categories."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scored(items: DataFrame, stats: DataFrame, weak: DataFrame, difficulty: DataFrame, jitter: Column | None = None) -> DataFrame:
    """Score of each (user, item): weak category, missed item, hard item. items: user_id, item_id, cat."""
    first = Window.partitionBy("user_id", "item_id").orderBy("rank")
    weak = weak.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("user_id", "item_id", "miss_rate")
    stats = stats.select("user_id", F.col("category").alias("cat"), "accuracy")
    out = items.join(stats, ["user_id", "cat"], "left").join(weak, ["user_id", "item_id"], "left").join(difficulty.select("item_id", "difficulty"), "item_id", "left")
    value = F.when(F.col("accuracy").isNotNull(), (1 - F.col("accuracy")) * 10).otherwise(F.lit(5.0)) + F.coalesce(F.col("miss_rate") * 6, F.lit(0.0)) + F.coalesce(F.col("difficulty") * 3, F.lit(0.0))
    return out.select("user_id", "item_id", "cat", (value if jitter is None else value + jitter).alias("score"))


def capped(rows: DataFrame, n: int, share: float = 0.4) -> DataFrame:
    """The best n of each user, no category with more than its share of n."""
    most = math.ceil(n * share)
    own = Window.partitionBy("user_id", "cat").orderBy(F.desc("score"), "item_id")
    all_ = Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")
    out = rows.withColumn("_in_cat", F.row_number().over(own)).where(F.col("_in_cat") <= most)
    return out.withColumn("rank", F.row_number().over(all_)).where(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("long")).drop("_in_cat")


def padded(rows: DataFrame, n: int, seed: int = 0, share: float = 0.4) -> DataFrame:
    """``capped``, filled up to n with other items of the user in an order that the seed fixes."""
    best = capped(rows, n, share)
    rest = rows.join(best.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    order = Window.partitionBy("user_id").orderBy(shuffle_key(seed, "item_id"), "item_id")
    fill = rest.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)
    have = best.groupBy("user_id").agg(F.count("*").alias("_have"))
    fill = fill.join(have, "user_id", "left").where(F.col("rank") + F.coalesce("_have", F.lit(0)) <= n)
    return best.unionByName(fill.select("user_id", "item_id", "cat", "score", (F.col("rank") + F.coalesce("_have", F.lit(0))).alias("rank")))


def round_robin(rows: DataFrame, n: int, group: str, order: str) -> DataFrame:
    """The first of each group, then the second of each, up to n rows; ``place`` is the order. n is a small sample size."""
    turn = F.row_number().over(Window.partitionBy("_g").orderBy(order))
    some = rows.withColumn("_g", F.coalesce(F.col(group), F.lit("_"))).withColumn("_turn", turn).where(F.col("_turn") <= n)
    best = some.orderBy("_turn", "_g").limit(n)
    return best.withColumn("place", F.row_number().over(Window.orderBy("_turn", "_g")).cast("long")).drop("_g", "_turn")  # n rows


def shuffled(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    """``shuffle_key``: sorting by it is a permutation that the seed fixes."""
    return rows.withColumn("shuffle_key", shuffle_key(seed, *keys))


def shuffle_key(seed: int, *keys: str) -> Column:
    """The MD5 of the keys and the seed as text: any engine can repeat the order."""
    return F.md5(F.concat_ws(":", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))))


def reasons(stats: DataFrame, below: float = 0.7, most: int = 2) -> DataFrame:
    """The weakest categories of each user, as the recommendation's reason."""
    order = Window.partitionBy("user_id").orderBy("accuracy", "category")
    return stats.where(F.col("accuracy") < below).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select("user_id", "category", "rank")
