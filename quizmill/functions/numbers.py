"""Rounding and division as the study apps define them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity: -2.5 gives -2."""
    scale = float(10**digits)
    out = F.floor(x * scale + 0.5)
    return (out / scale).cast("double") if digits else out.cast("long")


def ratio(part: Column, whole: Column) -> Column:
    """A share to three places; over nothing it is over one."""
    return F.round(part / F.greatest(whole, F.lit(1)).cast("double"), 3)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, 0 over nothing."""
    return F.when(whole > 0, half_up(part * 100.0 / whole)).otherwise(F.lit(0).cast("long"))


def score_percent(correct: Column, total: Column) -> Column:
    """A session's score: correct and total as a rounded percent."""
    return F.when(total > 0, half_up(correct.cast("double") / total * 100.0)).otherwise(F.lit(0).cast("long"))


def half_hours(seconds: Column) -> Column:
    """Hours to the nearest half."""
    return (F.floor(seconds / 1800.0 + 0.5) / 2).cast("double")


def whole_days(until: Column, as_of: Column) -> Column:
    """Days between two dates, never below 0, null without a date."""
    return F.when(until.isNotNull(), F.greatest(F.lit(0), F.datediff(until, as_of))).cast("long")


def clock(seconds: Column) -> Column:
    """m:ss."""
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("long"), (seconds % 60).cast("long"))


def money(cents: Column) -> Column:
    """Cents as $x.xx."""
    return F.format_string("$%d.%02d", F.floor(cents / 100).cast("long"), (cents % 100).cast("long"))
