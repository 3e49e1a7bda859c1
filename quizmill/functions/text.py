"""String functions of search, question checks and notices, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a search ignores: fixed values
SEARCH_STOP = (
    "i im i'm am a an the for to my me is are in on of and or do need want study studying studies exam exams test tests testing "
    "prep prepare preparing licence license licensing certification certified cert certs take taking sit sitting about what which "
    "help looking look get got have be been next"
).split()
# Words that a question check ignores: fixed values
CHECK_STOP = (
    "the a an and or of to in for with on at by is are be that this it as from not all any first should patient nurse then when which "
    "what who most more than use used using after before only would will its their"
).split()
# Grammars of slugs and price keys, and what counts as a word of a check: fixed values
SLUG = r"^[a-z0-9][a-z0-9-]{0,63}$"
PRICE_KEY = r"^(pro_[a-z0-9_]{1,40}|all_access|ebook_[a-z0-9_]{1,40})$"
CHECK_WORD = r"([a-z0-9][a-z0-9+'.-]{2,})"


def norm(text: Column) -> Column:
    """Lower case; letters, digits and plus stay, single blanks between."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9+ ]+", " "), r"\s+", " "))


def tokens(text: Column) -> Column:
    """The words of the normal form that a search counts."""
    return tokens_of(norm(text))


def tokens_of(normal: Column) -> Column:
    """``tokens`` of what is in its normal form."""
    return F.filter(F.split(normal, " "), lambda w: ~w.isin("", *SEARCH_STOP))


def check_words(text: Column) -> Column:
    """Distinct words of three signs or more that carry meaning in a choice or rationale."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(CHECK_WORD), 1), lambda w: ~w.isin(*CHECK_STOP)))


def overlap(a: Column, b: Column) -> Column:
    """The share of the words ``a`` (an array) that ``b`` has too; 0 without words."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a).cast("double")).otherwise(F.lit(0.0))


def lead_clause(rationale: Column) -> Column:
    """What comes before the first lettered option and the first end of a sentence."""
    return F.get(F.split(F.get(F.split(rationale, r"\([A-D]\)"), F.lit(0)), r"(?<=\.)\s"), F.lit(0))


def negated(choice: Column) -> Column:
    """Whether a choice opens with a negation; the words are fixed values."""
    return F.trim(choice).rlike(r"(?i)^(no|none|not|never)\b")


def stem_match(word: Column, keyword: Column) -> Column:
    """Both of five signs or more, one the beginning of the other."""
    return (F.length(word) >= 5) & (F.length(keyword) >= 5) & (word.startswith(keyword) | keyword.startswith(word))


def numbered(prefix: str, n: Column) -> Column:
    """An id: the prefix and three digits at least."""
    return F.format_string(f"{prefix}%03d", n)


def price_key(kind: str, slug: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.translate(slug, "-", "_"))


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for sign, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def letter(index: Column) -> Column:
    """0 to 3 as A to D."""
    return F.substring(F.lit("ABCD"), index.cast("int") + 1, F.lit(1))


def letter_index(sign: Column) -> Column:
    """A to D as 0 to 3, -1 for others."""
    return F.instr(F.lit("ABCD"), sign) - 1 if isinstance(sign, str) else (F.locate("A", sign) * 1 + F.locate("B", sign) * 2 + F.locate("C", sign) * 3 + F.locate("D", sign) * 4 - 1)


def fold_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\s*\n\s*", " ")


def repeats_counts(text: Column) -> Column:
    """Whether prose states a number of terms, scenarios, vignettes or questions."""
    return text.rlike(r"(?i)\b\d+\s+(terms|scenarios|vignettes|questions)\b")


def watermark(name: Column, ref: Column, date: Column, brand: str) -> Column:
    return F.concat_ws(" · ", F.concat(F.lit("Licensed to "), name), F.substring(ref, 1, 8), date.cast("string"), F.lit(brand))


def word_count(*texts: Column) -> Column:
    return F.size(F.filter(F.split(F.concat_ws(" ", *texts), r"\s+"), lambda w: w != "")).cast("long")


def flattened(prefix: str, fields: dict[str, Column]) -> Column:
    """A map of ``prefix[key]`` to the value as text, nulls left out."""
    whole = F.map_from_arrays(F.array(*(F.lit(f"{prefix}[{k}]") for k in fields)), F.array(*(v.cast("string") for v in fields.values())))
    return F.map_filter(whole, lambda _, v: v.isNotNull())
