"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a built-in expression over the whole text of its row, so the
rules are one narrow projection without user functions, shuffles or state.

Nulls and odd inputs: a null or empty text has no words, fails ``base`` and is
not kept; ratios over nothing are 0; equal rows get equal results; an empty
table gives no rows.  Input columns stay; the operator's own replace columns of
the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD

SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on are this from at an or a "
    "der die das und in zu den mit von ist im für auf nicht ein eine als sich dem des auch "
    "le la les de des et en un une du que est pour dans qui sur pas au avec il "
    "el la los las de que y en un una por con para es se del al lo no su"
).split()


BULLET, ELLIPSIS = r"^[\x20\t]*[-*•‣–]", r"(?:\.\.\.|…)[\x20\t\r]*\z"


@dataclass(frozen=True)
class Rule:
    """Keep a text if low <= measure <= high; a None bound is open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The production table.
RULES = (
    Rule("word_length", "mean_word_length", 1.5, 20.0),
    Rule("symbols", "symbols_per_word", None, 0.5),
    Rule("stop_words", "stop_word_ratio", 0.01, None),
    Rule("duplicate_lines", "duplicate_line_ratio", None, 0.5),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.5),
)


def bound(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column, window: int = 3) -> Column:
    """How many words lie in a window of words that occurs twice or more.

    Windows are compared as 64-bit hashes.  They are sorted with their places,
    a window equal to a neighbour is a repeated one, and the words of the
    repeated windows are counted by the gaps between their places: linear
    but for the sort, whatever the text repeats.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))

    def places(marked: Column) -> Column:
        same = lambda x, i: (x["h"] == F.get(marked, i - 1)["h"]) | (x["h"] == F.get(marked, i + 1)["h"])
        return F.sort_array(F.transform(F.filter(marked, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        gaps = F.aggregate(F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(window)), F.lit(window))), F.lit(0), lambda a, g: a + g)
        return F.when(F.size(at) > 0, gaps).otherwise(0)

    def slow(found: Column) -> Column:
        marked = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bound(bound(marked, places), covered)

    counted = bound(hashes, lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(slow(found)))
    return F.when(n > window, counted).otherwise(0).cast("long")


def counts(text: Column) -> dict[str, Column]:
    """The base counts of a text."""
    whole = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(whole, F.lit(f"({WORD})"), F.lit(1))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(WORD))
    return {
        "n_words": bound(words, lambda w: F.size(w)).cast("long"),
        "word_chars": F.length(F.regexp_replace(whole, SPACE, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": bound(words, lambda w: repeat_words(w)),
    }


def measures(text: Column) -> dict[str, Column]:
    """Ratios that rules may bound, from the columns of counts() and the text."""
    whole = F.coalesce(text, F.lit(""))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n_words = F.col("n_words")
    stop = F.size(F.filter(F.regexp_extract_all(F.lower(whole), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: w.isin(STOP_WORDS)))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(WORD))
    share = lambda pattern: bound(lines, lambda every: ratio(F.size(F.filter(every, lambda x: x.rlike(pattern))), F.size(every)))
    return {
        "mean_word_length": ratio(F.col("word_chars"), n_words),
        "symbols_per_word": ratio(F.col("n_symbols"), n_words),
        "stop_word_ratio": ratio(stop, n_words),
        "duplicate_line_ratio": bound(lines, lambda every: ratio(F.col("n_dup_lines"), F.size(every))),
        "bullet_line_ratio": share(BULLET),
        "ellipsis_line_ratio": share(ELLIPSIS),
    }


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The conjunction of the rules as one expression over the measures' columns."""
    kept = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            kept = kept & (F.col(rule.measure) >= F.lit(float(rule.low)))
        if rule.high is not None:
            kept = kept & (F.col(rule.measure) <= F.lit(float(rule.high)))
    return kept


def quality(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, text: str = "text", min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """docs with base counts, the measures, base_failed and kept."""
    counted = docs.withColumns(counts(F.col(text)))
    n = F.col("n_words")
    counted = counted.withColumn("base_failed", (n < min_words) | (F.col("n_repeat_words") * 100 > n * max_repeat))
    return counted.withColumns(measures(F.col(text))).withColumn("kept", ~F.col("base_failed") & compiled(rules))
