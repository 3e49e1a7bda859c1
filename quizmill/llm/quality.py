"""Quality rules whose thresholds come from the data: DataFrame functions only.

Each document gets measures. A mergeable quantile sketch of each measure is kept for every language
and source; sketches of small groups are merged up to the language, then to the whole. A document
is rejected when a measure lies beyond its group's fence, which is the median plus a multiple of
the spread above it, so the fence moves with what is usual in that group.

A null text counts as empty. Null languages and sources form groups of their own. Repeated rows are
each judged, alike. Columns of the input stay; columns named as the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.llm import shared

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Rows below which a group takes the fences of its language, and a language those of the whole.
SMALL = 200
#: (measure, least spread, how many spreads above the median the fence is)
FENCES = (("symbol_rate", 0.04, 5.0), ("capital_rate", 0.03, 5.0), ("mark_rate", 0.17, 5.0), ("dup_line_rate", 0.10, 5.0), ("stutter_rate", 0.05, 5.0), ("word_length", 0.5, 6.0))
#: Groups up to which all fences, of about 100 bytes each, are sent to every task.
SENT = 50_000
#: What a single token may add to a short text's measures before it counts: signs, and code points of one long word.
ROOM = (3.0, 40.0)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BLANKS = " \t\n\x0b\x0c\r"


def _let(value: Column, then) -> Column:
    """``then(x)`` with x evaluated once for each row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, x: total + x)


def _covered(positions: Column) -> Column:
    """How many words the windows at these ascending positions cover."""
    return _let(positions, lambda p: _sum(F.transform(p, lambda x, k: F.when(k + 1 < F.size(p), F.least(F.lit(WINDOW), F.get(p, k + 1) - x)).otherwise(WINDOW).cast("long"))))


def _repeated(hashes: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    flagged = _let(pairs, lambda s: F.transform(F.filter(s, lambda x, k: same(s, k - 1, x) | same(s, k + 1, x)), lambda x: x["i"]))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_covered(F.sort_array(flagged)))


def _windows(h: Column) -> Column:
    """The hash of each window of WINDOW words, from the words' own."""
    return F.when(F.size(h) < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))))


def _of_words(words: Column) -> Column:
    """The number of words, of words in repeated windows, and of words equal to the one before."""
    stutter = lambda h: F.size(F.filter(h, lambda x, i: F.coalesce(F.get(h, i - 1) == x, F.lit(False)))).cast("long")
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).cast("long").alias("n"), _let(_windows(h), _repeated).alias("r"), stutter(h).alias("s")))


def _left(text: Column, pattern: str) -> Column:
    """How many characters stay when all of the pattern go."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """Add the counts of COUNTS and the measures of FENCES."""
    own = [*COUNTS, *(m for m, _, _ in FENCES)]
    kept = [shared.column(c) for c in docs.columns if c not in own]
    parts, capitals, marks, rows = (shared.free_name(docs.columns, c) for c in ("_words", "_capitals", "_marks", "_lines"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    core = F.btrim(text, F.lit(_BLANKS))
    words = F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    base = docs.select(
        *kept,
        _of_words(words).alias(parts),
        _left(text, r"[\x20\x09-\x0D]+").alias("word_chars"),
        _left(text, r"[^#*$%&|<>]+").alias("n_symbols"),
        _left(text, r"[^\p{Lu}]+").alias(capitals),
        _left(text, r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+").alias(marks),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias(rows),
    )
    share = lambda a, b: (a / F.greatest(b, F.lit(1))).cast("double")
    n, line = F.col(parts)["n"], F.col(rows)
    return base.select(
        *kept,
        n.alias("n_words"), "word_chars", "n_symbols", line["d"].alias("n_dup_lines"), F.col(parts)["r"].alias("n_repeat_words"),
        share(F.col("n_symbols"), n).alias("symbol_rate"), share(F.col(capitals), F.col("word_chars")).alias("capital_rate"), share(F.col(marks), n).alias("mark_rate"),
        share(line["d"], line["n"]).alias("dup_line_rate"), share(F.col(parts)["s"], n).alias("stutter_rate"), share(F.col("word_chars"), n).alias("word_length"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def fences(rows: DataFrame) -> DataFrame:
    """For each language and source: the upper fence of each measure, from merged sketches.

    Sketches are partial aggregates, so a source with a third of all rows moves no more than others.
    """
    names = [m for m, _, _ in FENCES]
    ok = rows.where(F.col("n_words") >= MIN_WORDS)
    group = ok.groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(m).alias(m) for m in names))
    group = group.select("lang", "source", "n", *(F.col(m).alias(f"_{m}") for m in names))
    language = group.groupBy("lang").agg(F.sum("n").alias("n_lang"), *(F.kll_merge_agg_double(f"_{m}").alias(f"lang_{m}") for m in names))
    whole = language.agg(*(F.kll_merge_agg_double(f"lang_{m}").alias(f"all_{m}") for m in names))
    joined = group.alias("g").join(language.alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang"))).crossJoin(F.broadcast(whole))  # one row

    def fence(m: str, spread: float, times: float) -> Column:
        sketch = F.when(F.col("n") >= SMALL, F.col(f"_{m}")).when(F.col("n_lang") >= SMALL, F.col(f"lang_{m}")).otherwise(F.col(f"all_{m}"))
        at = lambda q: F.kll_sketch_get_quantile_double(sketch, F.lit(q))
        return (at(0.5) + times * F.greatest(at(0.75) - at(0.5), F.lit(spread))).alias(f"fence_{m}")

    return joined.select(F.col("g.lang").alias("_lang"), F.col("g.source").alias("_source"), *(fence(*f) for f in FENCES))


def judged(docs: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Measures, ``base_failed``, the fences and ``kept`` for every row; ``keep``: input columns to carry.

    The measures are written once to the shared folder; sketches and the final filter read them there.
    """
    for c in ("lang", "source"):
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast("string"))
    table = stored_measures(docs, keep)
    limits = shared.stored(fences(table), "fences")
    sent = limits.count() <= SENT  # else both sides are dealt by language and source, and Spark splits large groups
    beyond = F.lit(False)
    for m, _, _ in FENCES:
        slack = F.lit(ROOM[m == "word_length"]) / F.greatest(F.col("n_words"), F.lit(1))
        beyond = beyond | F.coalesce(F.col(m) > F.col(f"fence_{m}") + slack, F.lit(False))
    of = [shared.free_name(table.columns, c) for c in ("_lang", "_source")]
    limits = limits.withColumnsRenamed(dict(zip(("_lang", "_source"), of, strict=True)))
    same = F.col("lang").eqNullSafe(F.col(of[0])) & F.col("source").eqNullSafe(F.col(of[1]))
    verdict = table.join(F.broadcast(limits) if sent else limits, same, "left").drop(*of)
    return verdict.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~beyond)


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns as they are, whatever the names. An empty table gives an empty one."""
    return shared.aside(docs, ("text", "lang", "source"), lambda rows: judged(rows).where("kept"))


def stored_measures(docs: DataFrame, keep: tuple[str, ...] | None) -> DataFrame:
    carry = list(docs.columns if keep is None else dict.fromkeys((*keep, "lang", "source")))
    own = {*COUNTS, *(m for m, _, _ in FENCES), *(f"fence_{m}" for m, _, _ in FENCES), "base_failed", "kept"}
    table = measured(docs.select(*(shared.column(c) for c in docs.columns if c not in own)))
    return shared.stored(table.select(*(shared.column(c) for c in carry if c not in own), *COUNTS, *(m for m, _, _ in FENCES)), "quality")
