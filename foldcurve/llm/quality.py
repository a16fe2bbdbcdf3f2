"""Quality rules: a threshold table compiled into one Spark projection, with no user function.

All measures are built-in expressions over the whole text. `measured` adds them,
`compiled` turns rows of a threshold table into one boolean column. Nothing is
shuffled: every document is judged alone, in the task that reads it.

Null text counts as no words and no lines; an empty text has one empty line and no
word. Both fail the base. Repeated rows and ids are judged alike and all stay.
Other columns of the input are not read and do not come out. Very long texts are measured
whole, by one task each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldcurve.llm.common import words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\u000b\f\r"

#: Frequent function words of the languages at hand.
STOP_WORDS = (
    "the of and to in is that for it with as was on be by are this from or an at not have but "
    "le la les de des du et un une en est que qui pour dans par sur pas au avec "
    "der die das und ist nicht ein eine zu den von mit auf dem im sich als auch es für "
    "el los las y que en un una por con para se no su al lo como más o"
).split()
STOP_FORMS = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; None leaves a side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Clean prose in English, French, German or Spanish passes these. Prose in other languages, all in capitals, or in a
#: script without spaces fails the last rule or the third: give `compiled` a table without them for such texts.
RULES = (
    Rule("n_words", low=50),
    Rule("repeat_ratio", high=0.5),
    Rule("mean_word_length", low=2, high=12),
    Rule("symbol_ratio", high=0.06),
    Rule("dup_line_ratio", high=0.5),
    Rule("stop_word_ratio", low=0.06),
)

def measured(docs: DataFrame) -> DataFrame:
    """doc_id and one column for each measure."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Each step names what the next ones use more than once, so that it is computed once.
    rows = docs.select(
        "doc_id",
        words(F.col("text")).alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0).alias("_lines"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    rows = rows.withColumn("_hashes", window_hashes("_words"))
    rows = rows.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: w.isin(*STOP_FORMS))).cast("long").alias("n_stop_words"),
        # Windows with different hashes differ: most texts repeat none and skip the sort of their windows.
        F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), sorted_windows("_words"))
        .otherwise(F.array().cast("array<struct<g:string,i:int>>"))
        .alias("_windows"),
    )
    rows = rows.withColumn("_starts", repeated_starts("_windows")).drop("_windows")
    rows = rows.withColumn("n_repeat_words", covered("_starts").cast("long")).drop("_starts")
    n = F.greatest(F.col("n_words"), F.lit(1))
    return rows.select(
        "*",
        (F.col("word_chars") / n).alias("mean_word_length"),
        (F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("symbol_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / n).alias("repeat_ratio"),
        (F.col("n_stop_words") / n).alias("stop_word_ratio"),
    )


def window_hashes(column: str) -> Column:
    """A hash for each window of three words."""
    word = F.col(column)
    return F.transform(
        F.slice(column, 1, F.greatest(F.size(column) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, word[i + 1], word[i + 2]),
    )


def sorted_windows(column: str) -> Column:
    """(text, start) of each window of three words, equal texts side by side."""
    word = F.col(column)
    windows = F.transform(
        F.slice(column, 1, F.greatest(F.size(column) - 2, F.lit(0))),
        lambda w, i: F.struct(F.concat_ws(" ", w, word[i + 1], word[i + 2]).alias("g"), i.alias("i")),
    )
    return F.sort_array(windows)


def repeated_starts(column: str) -> Column:
    """Starts of the windows whose text is found twice or more, in order."""
    at = F.col(column)
    twice = F.filter(
        column,
        lambda x, i: ((i > 0) & (at[F.greatest(i - 1, F.lit(0))]["g"] == x["g"]))
        | ((i < F.size(column) - 1) & (at[F.least(i + 1, F.size(column) - 1)]["g"] == x["g"])),
    )
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def covered(column: str) -> Column:
    """Words in windows of three with these starts."""
    return F.aggregate(
        column,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda done, s: F.struct((done["n"] + F.least(F.lit(3), s - done["last"])).alias("n"), s.alias("last")),
        lambda done: done["n"],
    )


def compiled(rules=RULES) -> Column:
    """The table as one condition; a null measure fails."""
    out = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            out = out & (F.col(rule.measure) >= rule.low)
        if rule.high is not None:
            out = out & (F.col(rule.measure) <= rule.high)
    return F.coalesce(out, F.lit(False))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """A row per document with its measures, base_failed, and kept: base and table both passed."""
    rows = measured(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & compiled(rules))
