"""Question banks: public form, grading, merging, refreshing the free sample, numbering, duplicates."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quizmill.functions import text
from quizmill.sources import places

PUBLIC = ("id", "n", "cat", "stem", "choices")


def public_form(bank: DataFrame) -> DataFrame:
    """The bank without the columns that give answers away."""
    return bank.select(*(c for c in PUBLIC if c in bank.columns))


def needs_grading(answer: Column) -> Column:
    return answer.isNull()


def gradable(bank: DataFrame) -> DataFrame:
    """Questions with choices, an answer and a rationale."""
    return bank.where(F.col("choices").isNotNull() & F.col("answer").isNotNull() & (F.coalesce("why", F.lit("")) != ""))


def graded(answers: DataFrame, bank: DataFrame, by: str, most: int = 500) -> DataFrame:
    """Verdict of each answer to a known question; of each request the first ``most`` ids count."""
    order = Window.partitionBy(by).orderBy("id")
    asked = answers.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")
    return asked.join(bank.select("id", "answer"), "id").withColumn("correct", F.col("picked").eqNullSafe(F.col("answer")))


def fetched(bank: DataFrame, asked: DataFrame, most: int = 500) -> DataFrame:
    """The public form of the first ``most`` asked ids. asked: ids, an array, in one or more rows."""
    ids = asked.select(F.explode(F.slice("ids", 1, most)).alias("id")).distinct()
    return public_form(bank.join(ids, "id", "left_semi"))


def merged(existing: DataFrame, incoming: DataFrame, key: str = "id", existing_wins: bool = True) -> DataFrame:
    """Full outer merge column by column; a null never replaces a value."""
    columns = [c for c in existing.columns if c != key]
    a = existing.select(F.col(key).alias("_a"), *(F.col(c).alias(f"_a_{c}") for c in columns))
    b = incoming.select(F.col(key).alias("_b"), *((F.col(c) if c in incoming.columns else F.lit(None)).alias(f"_b_{c}") for c in columns))
    first, second = ("_a_", "_b_") if existing_wins else ("_b_", "_a_")
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(key), *(F.coalesce(first + c, second + c).alias(c) for c in columns))


def patched(local: DataFrame, results: DataFrame) -> DataFrame:
    """Rows without a local key take what grading sent back; why and label only where it sent some."""
    r = results.select("id", *(F.col(c).alias(f"_r_{c}") for c in ("answer", "why", "label")))
    return local.join(r, "id", "left").select("id", F.coalesce("answer", "_r_answer").alias("answer"), F.coalesce("_r_why", "why").alias("why"), F.coalesce("_r_label", "label").alias("label"))


def refreshed(sample: DataFrame, bank: DataFrame) -> DataFrame:
    """The sample with each row replaced by the bank's, in its own order; ``state``: same, changed or missing."""
    columns = [c for c in bank.columns if c != "id"]
    b = bank.select(F.col("id").alias("_id"), F.struct(*columns).alias("_new"))
    old = F.struct(*columns)
    out = sample.join(b, F.col("id") == F.col("_id"), "left").withColumn("state", F.when(F.col("_id").isNull(), "missing").when(old.eqNullSafe(F.col("_new")), "same").otherwise("changed"))
    return out.select("place", "id", "state", *(F.when(F.col("_id").isNull(), F.col(c)).otherwise(F.col(f"_new.{c}")).alias(c) for c in columns))


def placed(rows: DataFrame, column: str, *order: str) -> DataFrame:
    """``column``: each row's place from 1 in the order of columns that have no ties together, by a scan over range partitions.

    The sorted rows are stored with their partition and their place in it; the sizes of the partitions, one row each, give every partition
    what comes before it. So no task holds more than its range, and a repeated task finds the same places."""
    mask = F.lit((1 << 33) - 1)
    here = rows.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id().bitwiseAND(mask) + 1).alias("_k"))
    here = places.stored(here, "placed")
    sizes = sorted((r._part, r.n) for r in here.groupBy("_part").agg(F.max("_k").alias("n")).collect())  # a row for each partition
    before = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    start = F.element_at(F.create_map(*(F.lit(x) for entry in before.items() for x in entry)), F.col("_part")) if before else F.lit(0)
    return here.withColumn(column, (F.col("_k") + start).cast("long")).drop("_part", "_k")


def numbered(new: DataFrame, existing: DataFrame, prefix: str, *order: str) -> DataFrame:
    """Ids for new rows, from the largest number in use on, in the order of columns without ties."""
    top = existing.agg(F.coalesce(F.max(F.regexp_replace(F.col("id").cast("string"), r"\D", "").cast("long")), F.lit(0))).first()[0]
    return placed(new, "_n", *order).withColumn("new_id", text.numbered(prefix, F.col("_n") + top)).drop("_n")


def duplicates(new: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """New rows whose key is in use, or came earlier among the new ones; ``reason`` says which."""
    used = existing.select(F.col(key).alias("_used")).distinct()
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    out = new.withColumn("_nth", nth).join(used, F.col(key) == F.col("_used"), "left")
    return out.where(F.col("_used").isNotNull() | (F.col("_nth") > 1)).withColumn("reason", F.when(F.col("_used").isNotNull(), "exists").otherwise("repeated")).drop("_used", "_nth")


def answered(scenarios: DataFrame, keys: DataFrame) -> DataFrame:
    """Scenarios with their answer by number; ``problem`` where there is none."""
    k = keys.select(F.col("n").alias("_n"), "answer")
    return scenarios.join(k, F.col("n") == F.col("_n"), "left").withColumn("problem", F.when(F.col("_n").isNull(), "no answer")).drop("_n")


def free_flags(bank: DataFrame, free_ids: DataFrame) -> DataFrame:
    f = free_ids.select(F.col("id").alias("_f")).distinct()
    return bank.join(f, F.col("id") == F.col("_f"), "left").withColumn("free", F.col("_f").isNotNull()).drop("_f")


def in_sections(rows: DataFrame, section: str, order: str) -> DataFrame:
    """Sections in order of first appearance, each row's place in its section and the section's size."""
    own = Window.partitionBy(section)
    return rows.withColumn("section_at", F.min(order).over(own)).withColumn("i", F.row_number().over(own.orderBy(order)).cast("long")).withColumn("of", F.count("*").over(own))


def section_filter(section: str, wanted: Column) -> Column:
    return (wanted == "all") | (F.col(section) == wanted)


def split_bank(bank: DataFrame, free_ids: DataFrame, slug: Column) -> DataFrame:
    """Each app's bank as a document: slug, total, freeIds, questions as JSON. One app's bank is small, the banks of all apps are not."""
    columns = bank.columns
    flagged = free_flags(bank.withColumn("_slug", slug), free_ids).groupBy(F.col("_slug").alias("slug"))
    return flagged.agg(F.count("*").alias("total"), F.to_json(F.array_sort(F.collect_list(F.when(F.col("free"), F.col("id"))))).alias("freeIds"), F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))).alias("questions"))


def count_drift(registry: DataFrame, counted: DataFrame) -> DataFrame:
    """Registry rows whose counts differ from the content's."""
    c = counted.select(F.col("slug").alias("_s"), F.col("terms").alias("found_terms"), F.col("questions").alias("found_questions"))
    out = registry.join(c, F.col("slug") == F.col("_s"), "left").drop("_s")
    return out.where(~F.col("terms").eqNullSafe(F.col("found_terms")) | ~F.col("questions").eqNullSafe(F.col("found_questions")))
