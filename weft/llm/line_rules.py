"""Quality rules [native]: line-first cleaning.

Each line with a word is held against rules: punctuation (it must have a sentence's end somewhere, and
not end in a row of marks), symbols (few among its characters), navigation (no row of bars or arrows),
shouting and boilerplate. Lines that fail are removed; a document that keeps less than `least` of its
characters in lines is rejected. Beside that stand base counts of the whole text, and a base verdict.

All work is done in each row by array functions: no shuffle, no Python. Windows of five words are
compared by a 64-bit hash of their words' 64-bit hashes.

Defined results: null texts are as empty: no words, so they fail, and their cleaned text is empty. Rows that repeat give
repeated results, null ids stay null, an empty table gives an empty result; a document with exactly `least` of its
characters left is kept. Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks that count as symbols, and phrases of page furniture, in lower case.
SYMBOLS = "[#*$%&|<>]"
BOILERPLATE = "cookie policy|use of cookies|enable javascript|all rights reserved|terms of use|terms of service|privacy policy|click here|sign up|log in to|subscribe to our|lorem ipsum|read more|skip to content"
SENTENCE_END = "[.?\\u2026](\\s|[\"'\\u201d\\u00bb)\\]]|$)|[^!]!(\\s|[\"'\\u201d\\u00bb)\\]]|$)"


def line_passes(line: Column) -> Column:
    """Whether a line, which has a word, stays."""
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    return (
        line.rlike(SENTENCE_END)
        & (symbols * 20 <= F.length(line))
        & ~line.rlike("[|>\\u00bb\\u2022]\\s[^|>\\u00bb\\u2022]*[|>\\u00bb\\u2022]\\s")
        & (F.regexp_count(line, F.lit("!!")) * 40 <= F.length(line))
        & ~F.lower(line).rlike(BOILERPLATE)
    )


def line_first_cleaning(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """The cleaned text of each document, its verdict, counts, and the share of characters in lines that stay."""
    text = F.coalesce("text", F.lit(""))
    split = documents.select(
        F.col("doc_id").cast("long"),
        F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        cleaned_text(text).alias("cleaned_text"),
    )
    counted = split.select(
        "doc_id", "word_chars", "n_symbols", "cleaned_text",
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("all_chars"),
        F.aggregate(F.filter("lines", line_passes), F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("line_chars"),
    )
    at = lambda i, k: F.get("hashes", i + k)
    windows = F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 5), lambda i: F.struct(F.xxhash64(*(at(i, k) for k in range(5))).alias("h"), i.alias("at")))).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))
    ordered = counted.withColumn("windows", F.sort_array(windows)).drop("hashes")
    near = lambda i: F.coalesce(F.get("windows", i)["h"], F.lit(None))
    twice = F.filter("windows", lambda x, i: F.coalesce((i > 0) & (near(F.greatest(i - 1, F.lit(0))) == x["h"]), F.lit(False)) | F.coalesce(near(i + 1) == x["h"], F.lit(False)))
    found = ordered.withColumn("twice", F.sort_array(F.transform(twice, lambda x: x["at"]))).drop("windows")
    begin = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).alias("reach"))
    covered = F.aggregate("twice", begin, lambda a, p: F.struct((a["covered"] + p + 5 - F.greatest(a["reach"], p)).alias("covered"), (p + 5).alias("reach")), lambda a: a["covered"])
    out = found.withColumn("n_repeat_words", covered)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    share = F.when(F.col("all_chars") > 0, F.col("line_chars") / F.col("all_chars")).otherwise(F.lit(0.0))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (share >= least)).alias("kept"), F.round(share, 6).alias("line_share"), "cleaned_text")


def rule_digest(cleaned: DataFrame) -> DataFrame:
    """The columns of op5 from what line_first_cleaning() returns."""
    return cleaned.drop("cleaned_text")


def cleaned_text(text: Column) -> Column:
    """A text's lines that stay, and its lines without words, joined again."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike("[^\\x20\\x09-\\x0D]") | line_passes(x)), "\n")
