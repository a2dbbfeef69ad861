"""Quality rules, lines first: failing lines go, then documents that lose too much of their text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import WHITE, WORD, n_words, words

SYMBOLS = "#*$%&|<>"
#: A line fails if more than this part of its characters, white space aside, is neither letter, mark nor digit.
MAX_PUNCTUATION = 0.2
#: A line of fewer words than this without an end of sentence is taken for a navigation label.
LABEL_WORDS = 4
MAX_SEPARATORS = 2
#: A document is rejected if it loses more than this part of its words.
MAX_LOSS = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

# fixed values: phrases of boilerplate lines
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "sign up for",
    "subscribe to our",
    "click here",
    "enable javascript",
    "skip to content",
    "back to top",
    "share this",
    "powered by",
)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def line_fails(line: Column) -> Column:
    """True if a line breaks a rule of punctuation, navigation or boilerplate. Lines without a word pass."""
    marks = F.regexp_count(line, F.lit(r"[^\p{L}\p{M}\p{N}\s]"))
    separators = F.length(line) - F.length(_without(line, "|»›•"))
    label = (n_words(line) < LABEL_WORDS) & ~F.rlike(line, F.lit(r"[.!?:;…。\"')\]]\s*$"))
    phrases = let(F.lower(line), lambda low: reduce(or_, [F.contains(low, F.lit(p)) for p in BOILERPLATE]))
    return let(
        F.length(_without(line, WHITE)),
        lambda solid: (solid > 0) & ((separators > MAX_SEPARATORS) | label | phrases | (marks > F.lit(MAX_PUNCTUATION) * solid)),
    )


def _repeated(windows: Column) -> Column:
    """Start positions of the 3-word windows that occur twice or more; ``windows`` is sorted by (words, position)."""
    same = lambda x, j: (F.get(windows, j - 1)["words"] == x["words"]) | (F.get(windows, j + 1)["words"] == x["words"])
    return F.transform(F.filter(windows, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["at"])


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text, lost_words, kept.

    Lines are split at newlines. A line's failure does not depend on others. ``clean_text`` is the
    text without its failing lines, ``lost_words`` counts their words; null texts have no words and a null
    ``clean_text``. A document is kept if it passes the base rules and loses at most half of its
    words. Columns of ``docs`` with the added names are replaced. Everything stays within a row: nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.withColumns({
        "_words": words(F.col("text")),
        "_lines": F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), line_fails(x).alias("fails"))),
    })
    third = F.when(F.size("_words") >= 3, F.sequence(F.lit(0), F.size("_words") - 3)).otherwise(F.array().cast("array<int>"))
    of = lambda i: [F.get("_words", i + k) for k in range(3)]
    window = lambda i: F.struct(F.concat_ws(" ", *of(i)).alias("words"), i.alias("at"))
    empty = F.array().cast("array<struct<words:string,at:int>>")
    hashed = split.withColumn("_hashes", F.transform(third, lambda i: F.xxhash64(*of(i))))
    # windows that all have different hashes are all different; only other documents sort them
    some_equal = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    measured = hashed.withColumns({
        "_windows": F.when(some_equal, F.sort_array(F.transform(third, window))).otherwise(empty),
        "_full": F.filter(F.transform("_lines", lambda x: x["line"]), lambda x: F.rlike(x, F.lit(WORD))),
        "_kept": F.filter("_lines", lambda x: ~x["fails"]),
        "_lost": F.filter("_lines", lambda x: x["fails"]),
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(_without(text, WHITE)).cast("long"),
        "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
    })
    counted = measured.withColumns({
        "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
        "_at": _repeated(F.col("_windows")),
    })
    covered = F.array_distinct(F.flatten(F.transform("_at", lambda i: F.array(i, i + 1, i + 2))))
    judged = counted.withColumns({
        "n_repeat_words": F.size(covered).cast("long"),
        "lost_words": n_words(F.array_join(F.transform("_lost", lambda x: x["line"]), "\n")),
        "clean_text": F.when(F.col("text").isNotNull(), F.array_join(F.transform("_kept", lambda x: x["line"]), "\n")),
    })
    judged = judged.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    )
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= F.col("n_words") * F.lit(MAX_LOSS)))
    return judged.drop("_words", "_lines", "_hashes", "_windows", "_full", "_kept", "_lost", "_at")
