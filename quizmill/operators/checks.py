"""Checks of question banks: keys that the rationale contradicts, stale letters, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quizmill.functions import text

#: The share of a choice's words that makes a rationale name it: a fixed value.
ENOUGH = 0.6
# A choice named with its letter, and what may stand before the name: fixed values
ARTICLE = r"(?i)^(and|or|but|the|a|an|is|not)\s+"
NAMED = r"([A-Za-z][A-Za-z'’\- ]{3,44}?)\s*\(([A-D])\)"


def _scores(choices, words):
    return F.transform(choices, lambda c: text.overlap(text.check_words(c), words))


def miskeys(bank: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """Questions whose rationale opens with another choice than the keyed one; ``dismissed`` where a person has looked.

    bank: slug, id, choices, answer, why; reviewed: slug, id."""
    rows = bank.where(F.col("choices").isNotNull() & F.col("answer").isNotNull() & (F.coalesce("why", F.lit("")) != ""))
    rows = rows.withColumn("_lead", text.lead_clause(F.col("why"))).withColumn("_lw", text.check_words(F.col("_lead"))).withColumn("_ww", text.check_words(F.col("why")))
    rows = rows.withColumn("_scores", _scores(F.col("choices"), F.col("_lw"))).withColumn("best", F.array_max("_scores"))
    rows = rows.withColumn("best_idx", F.array_position("_scores", F.col("best")) - 1).withColumn("_rival", F.get("choices", F.col("best_idx").cast("int")))
    keyed = F.get("choices", F.col("answer").cast("int"))
    rows = rows.withColumn("in_lead", F.coalesce(F.get("_scores", F.col("answer").cast("int")), F.lit(0.0))).withColumn("anywhere", text.overlap(text.check_words(F.coalesce(keyed, F.lit(""))), F.col("_ww")))
    bad = rows.where((F.col("best_idx") != F.col("answer")) & (F.col("best") >= 0.6) & (F.col("best") - F.col("in_lead") >= 0.5) & (F.col("anywhere") < 0.2) & (F.size(text.check_words(F.col("_rival"))) >= 2) & ~text.negated(F.col("_rival")))
    out = bad.select("slug", "id", F.col("answer").cast("long").alias("answer"), F.col("best_idx").cast("long").alias("says"))
    if reviewed is None:
        return out.withColumn("dismissed", F.lit(False))
    seen = reviewed.select(F.col("slug").alias("_s"), F.col("id").alias("_i"))
    return out.join(seen, (F.col("slug") == F.col("_s")) & (F.col("id") == F.col("_i")), "left").withColumn("dismissed", F.col("_s").isNotNull()).drop("_s", "_i")


def stale_letters(bank: DataFrame) -> DataFrame:
    """Places where a rationale names a choice with another choice's letter."""
    names = F.arrays_zip(F.regexp_extract_all("why", F.lit(NAMED), 1).alias("name"), F.regexp_extract_all("why", F.lit(NAMED), 2).alias("sign"))
    rows = bank.where(F.col("choices").isNotNull() & F.col("answer").isNotNull() & (F.coalesce("why", F.lit("")) != "")).select("slug", "id", "choices", F.posexplode(names).alias("at", "m"))
    rows = rows.select("slug", "id", "choices", "at", F.trim(F.regexp_replace("m.name", ARTICLE, "")).alias("name"), (F.ascii("m.sign") - 65).alias("idx"))
    rows = rows.where((F.col("idx") < F.size("choices")) & (F.size(F.split("name", r"\s+")) <= 6)).withColumn("_nw", text.check_words(F.col("name")))
    # the share of the name's words that each choice has
    scores = F.transform("choices", lambda c, i: F.when(i == F.col("idx"), F.lit(-1.0)).otherwise(text.overlap(F.col("_nw"), text.check_words(c))))
    rows = rows.withColumn("_else", scores).withColumn("here", text.overlap(F.col("_nw"), text.check_words(F.get("choices", F.col("idx")))))
    bad = rows.where((F.col("here") < 0.5) & (F.array_max("_else") >= 0.5))
    return bad.select("slug", "id", "name", text.letter(F.col("idx")).alias("letter"), text.letter(F.array_position("_else", F.array_max("_else")) - 1).alias("belongs"))


def totals(bank: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """One row: questions checked, miskeys, dismissed ones, stale letters."""
    checked = bank.agg(F.count_if(F.col("choices").isNotNull() & F.col("answer").isNotNull() & (F.coalesce("why", F.lit("")) != "")).alias("checked"))
    m = miskeys(bank, reviewed).agg(F.count_if(~F.col("dismissed")).alias("miskeys"), F.count_if("dismissed").alias("dismissed"))
    return checked.crossJoin(m).crossJoin(stale_letters(bank).agg(F.count("*").alias("stale")))  # one row each


def overlapping(texts: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """(item, text, share) of all pairs in which the text has that share or more of the item's words. texts: text, words; items: item, words; words are distinct.

    Such a text has at least one of any n - k + 1 words of an item, where k of its n are enough. So only an item's rarest words
    meet texts, by their number of texts, and common words join nothing; pairs that meet are then compared whole."""
    i = items.select("item", "words", F.size("words").alias("n")).where("n > 0")
    enough = F.ceil(F.lit(least) * F.col("n") - 1e-9)
    word_of = i.select("item", (F.col("n") - enough + 1).alias("most"), F.explode("words").alias("word"))
    text_has = texts.select("text", F.explode("words").alias("word"))
    counted = text_has.join(word_of.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("texts"))
    order = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("texts", F.lit(0)), "word"))
    rare = word_of.join(counted, "word", "left").withColumn("k", order).where(F.col("k") <= F.col("most")).select("item", "word")
    met = text_has.join(rare, "word").select("item", "text").distinct()
    both = met.join(i, "item").join(texts.select("text", F.col("words").alias("has")), "text")
    return both.select("item", "text", text.overlap(F.col("words"), F.col("has")).alias("share")).where(F.col("share") >= least)


def meeting(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(item, text, share) of all pairs that share a word. texts: text (distinct), words; items: item (distinct), words; words are distinct.

    Words that no item has are dropped where they are read; the pairs of a text are counted in the task that holds its words where the items' words are broadcast."""
    of = items.select("item", F.size("words").alias("n"), F.explode("words").alias("word"))
    met = texts.select("text", F.explode("words").alias("word")).join(of, "word").groupBy("item", "text")
    return met.agg((F.count("*") / F.first("n").cast("double")).alias("share"))
