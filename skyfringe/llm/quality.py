"""Quality rules, line first.

Every line of a text is held against three rules: punctuation, navigation and boilerplate. Lines that fail one
are removed; a document is rejected when too large a share of its line text went. Everything is a column
expression over one row, so the operator has no shuffle, and a hot source or a group of copies costs no more
than its rows.

Defined results: null or empty text has no lines, keeps the empty text and is rejected by ``min_words``; white-space
lines belong to no rule and are dropped from the clean text; repeated rows are judged one by one; an empty table
gives an empty table; further columns pass through ``clean_lines`` untouched unless they carry a result's name, in
which case the result replaces them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, text_rows, word_array

# Characters counted as symbols, ends of a sentence, and phrases of page furniture.
SYMBOLS = "#*$%&|<>"
SENTENCE_END = r"[.!?:;,…。！？\"'”’»)\]]" + SPACES + "*$"
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript",
    "javascript is disabled", "click here", "read more", "sign in", "sign up", "log in", "subscribe to", "subscribe now",
    "follow us", "share this", "skip to content", "skip to main content", "lorem ipsum", "powered by", "accept cookies",
    "accept all cookies", "back to top",
)


def _count(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def line_fails(line: Column, *, furniture: bool = True, max_symbols_per_word: float = 0.5, short_words: int = 4, furniture_words: int = 30) -> Column:
    """True when a line with a word fails a rule.

    punctuation: more than ``max_symbols_per_word`` symbols a word, or, with no letter at all, no sentence;
    navigation: at most ``short_words`` words and no sentence end, or a menu whose bars number a third of its words;
    boilerplate: a known phrase in a line of at most ``furniture_words`` words; ``furniture=False``
    leaves that rule out, for texts known to have no such phrase.
    """
    n = F.regexp_count(line, F.lit(f"[^{SPACES[1:]}+"))
    punctuation = (_count(line, SYMBOLS) > max_symbols_per_word * n) | ~line.rlike(r"\p{L}")
    navigation = ((n <= short_words) & ~line.rlike(SENTENCE_END)) | (_count(line, "|»›•") * 3 > n)
    fails = punctuation | navigation
    return fails | ((n <= furniture_words) & line.rlike("(?i)" + "|".join(BOILERPLATE))) if furniture else fails


def clean_lines(docs: DataFrame, *, text: str = "text", max_lost: float = 0.5, min_words: int = 1) -> DataFrame:
    """``docs`` with clean_text, n_lines, n_lines_removed, lost_share and kept."""
    has_word = f"[^{SPACES[1:]}"
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(has_word))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    has_phrase = reduce(or_, (F.col("__low").contains(x) for x in BOILERPLATE))
    passing = lambda furniture: F.filter("__lines", lambda x: ~line_fails(x, furniture=furniture))
    split = docs.withColumn("__low", low).withColumn("__lines", lines).withColumn("__good", F.when(has_phrase, passing(True)).otherwise(passing(False)))
    size = lambda name: F.length(F.array_join(name, ""))
    return (
        split.withColumn("clean_text", F.array_join("__good", "\n"))
        .withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("n_lines_removed", (F.size("__lines") - F.size("__good")).cast("long"))
        .withColumn("lost_share", F.when(size("__lines") > 0, 1 - size("__good") / size("__lines")).otherwise(F.lit(0.0)))
        .withColumn("kept", (F.col("lost_share") <= max_lost) & (F.size(word_array(F.col("clean_text"))) >= min_words))
        .drop("__low", "__lines", "__good")
    )


def text_figures(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text and the counts that rules on whole texts need: n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words (words in a 3-word window that occurs twice or more), after the columns named in ``keep``."""
    words, pairs, grams = (F.col(f"__{x}") for x in ("words", "pairs", "grams"))
    from_second = lambda x: F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))
    with_next = F.zip_with(F.slice(words, 1, F.size(words) - 1), from_second(words), lambda a, b: F.xxhash64(a, b))
    # (hash of two words, hash of the next two): the 3-word window at p is known by both, 128 bits that share a word.
    windows = F.zip_with(F.slice(pairs, 1, F.size(pairs) - 1), from_second(pairs), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    placed = F.transform(windows, lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), i.alias("p")))
    # Equal windows stand side by side after the sort; each pair of neighbours that are equal gives both places.
    pairs_of_equals = F.filter(
        F.zip_with(F.slice(grams, 1, F.size(grams) - 1), from_second(grams), lambda x, y: F.when((x["a"] == y["a"]) & (x["b"] == y["b"]), F.array(x["p"], y["p"]))),
        lambda x: x.isNotNull(),
    )
    at = F.array_distinct(F.flatten(pairs_of_equals))
    p, n = F.col("__at"), F.size("__at")
    covered = F.when(
        n > 0,
        F.lit(3) + F.aggregate(F.zip_with(F.slice(p, 2, n - 1), F.slice(p, 1, n - 1), lambda b, a: F.least(F.lit(3), b - a)), F.lit(0), lambda x, y: x + y),
    ).otherwise(F.lit(0))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACES[1:]}"))
    return (
        text_rows(docs, *keep)
        .withColumn("__words", word_array(F.col("text")))
        .withColumn("__pairs", F.when(F.size(words) > 3, with_next))
        .withColumn("__grams", F.sort_array(placed))
        .withColumn("__at", F.sort_array(at))
        .withColumn("__lines", lines)
        .select(
            *keep,
            "doc_id",
            "text",
            F.size("__words").cast("long").alias("n_words"),
            F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
            _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
            covered.cast("long").alias("n_repeat_words"),
        )
    )


def quality_rules(docs: DataFrame, *keep: str, max_lost: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Figures of the whole text, the base rules on them, and the verdict of line-first cleaning."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    judged = clean_lines(text_figures(docs, *keep), max_lost=max_lost)
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("kept"))
