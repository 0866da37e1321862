"""Quality rules as a short-circuit cascade (DataFrame functions only).

Each rule reads one or two features of a text. ``plan_rules`` runs every rule alone
over a bounded sample, takes its running time and the share it rejects, and orders
the rules by rejection per cost. ``cascade`` then evaluates them in that order and
computes a feature only for rows that no earlier rule rejected. The order changes
the cost, never the verdict: a row is kept if no rule rejects it.

Nulls and empty texts have no words, so the word-count rule rejects them. Repeated
rows each get their verdict; an empty table gives an empty result; extra columns are
carried along untouched, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import WHITE, stored, words

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Up to so many different repeated windows a list lookup marks them; beyond, a sort does. Same result.
FEW_WINDOWS = 48
#: Rows of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 2000


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _with(df: DataFrame, name: str, value: Column, when: Column | None) -> DataFrame:
    if name in df.columns:
        return df
    return df.withColumn(name, value if when is None else F.when(when, value))


def _feature(df: DataFrame, name: str, value: Column, when: Column | None) -> DataFrame:
    """A feature that filters can't pass: moved below it, they would repeat its whole computation for every use of it."""
    here = F.spark_partition_id() >= 0  # always true, and Spark moves no filter across it
    return _with(df, name, F.when(here if when is None else here & when, value.cast("long")), None)


def _add_words(df: DataFrame, when: Column | None) -> DataFrame:
    df = _with(df, "w", words(F.col("t")), when)
    return _feature(df, "n_words", F.size("w"), when)


def _add_word_chars(df: DataFrame, when: Column | None) -> DataFrame:
    df = _add_words(df, when)
    return _feature(df, "word_chars", F.length(F.translate(F.col("t"), WHITE, "")), when)


def _add_symbols(df: DataFrame, when: Column | None) -> DataFrame:
    df = _add_words(df, when)
    return _feature(df, "n_symbols", _count_of(F.col("t"), SYMBOLS), when)


def _add_capitals(df: DataFrame, when: Column | None) -> DataFrame:
    df = _add_word_chars(df, when)
    return _feature(df, "n_capitals", _count_of(F.col("t"), CAPITALS), when)


def _add_lines(df: DataFrame, when: Column | None) -> DataFrame:
    lines = F.filter(F.split("t", "\n"), lambda x: F.translate(x, WHITE, "") != "")
    df = _with(df, "lines", lines, when)
    df = _feature(df, "n_lines", F.size("lines"), when)
    return _feature(df, "n_dup_lines", F.size("lines") - F.size(F.array_distinct("lines")), when)


def _add_repeats(df: DataFrame, when: Column | None) -> DataFrame:
    """Words covered by a three-word window that occurs twice or more.

    Windows are 64-bit hashes. Sorting them finds those that occur again; with few of
    them each window looks itself up, with many a sort of (hash, place) marks the
    places, so the work is n log n however repetitive the text is.
    """
    df = _add_words(df, when)
    w, last = F.col("w"), F.size("w") - 3
    places = F.sequence(F.lit(0), last)
    none = F.array().cast("array<bigint>")
    gram = F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    df = _with(df, "g", F.when(last >= 1, gram).otherwise(none), when)
    df = _with(df, "s", F.sort_array("g"), when)
    s = F.col("s")
    df = _with(df, "again", F.array_distinct(F.filter(s, lambda x, k: (k > 0) & (x == F.get(s, k - 1)))), when)
    g, again = F.col("g"), F.col("again")
    many = F.size(again) > FEW_WINDOWS
    pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    df = _with(df, "z", F.when(many, pairs), when)
    z = F.col("z")
    twin = F.filter(z, lambda x, k: (F.get(z, k - 1)["g"] == x["g"]) | (F.get(z, k + 1)["g"] == x["g"]))
    marked = F.when(F.size(again) == 0, F.array().cast("array<int>")).when(
        many, F.transform(twin, lambda x: x["i"])).otherwise(
        F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda i: F.array_contains(again, F.get(g, i))))
    df = _with(df, "at", marked, when)
    at = F.col("at")
    covered = F.size(F.array_distinct(F.concat(at, F.transform(at, lambda p: p + 1), F.transform(at, lambda p: p + 2))))
    return _feature(df, "n_repeat_words", covered, when)


@dataclass(frozen=True)
class Rule:
    """``features`` adds what ``rejects`` reads, under a guard; ``rejects`` is true for a bad row."""

    name: str
    features: Callable[[DataFrame, Column | None], DataFrame]
    rejects: Callable[[], Column]


def default_rules(min_words: int = 50, max_repeat_pct: int = 50, max_symbol_pct: int = 10, word_length: tuple[int, int] = (2, 13),
                  max_dup_line_pct: int = 50, max_capital_pct: int = 50) -> list[Rule]:
    c = F.col
    return [
        Rule("few_words", _add_words, lambda: c("n_words") < min_words),
        Rule("repeated_windows", _add_repeats, lambda: 100 * c("n_repeat_words") > max_repeat_pct * c("n_words")),
        Rule("symbols", _add_symbols, lambda: 100 * c("n_symbols") > max_symbol_pct * c("n_words")),
        Rule("word_length", _add_word_chars, lambda: (c("word_chars") < word_length[0] * c("n_words")) | (c("word_chars") > word_length[1] * c("n_words"))),
        Rule("repeated_lines", _add_lines, lambda: 100 * c("n_dup_lines") > max_dup_line_pct * c("n_lines")),
        Rule("capitals", _add_capitals, lambda: 100 * c("n_capitals") > max_capital_pct * c("word_chars")),
    ]


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))


def plan_rules(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) in cascade order: highest share per second first.

    Every rule runs alone over one sample of at most ``sample_rows`` rows.
    """
    rules = rules or default_rules()
    total = docs.count()
    fraction = min(1.0, 2.0 * sample_rows / total) if total else 1.0
    sample = docs.select(F.col(text_col).alias("t")).sample(False, fraction, 7).limit(sample_rows)
    sample = stored(_texts(sample, "t").select("t"), "rule-sample")
    rated = []
    for rule in rules:
        began = time.perf_counter()
        n, bad = rule.features(sample, None).agg(F.count(F.lit(1)), F.count_if(rule.rejects())).first()
        rated.append((rule, time.perf_counter() - began, bad / n if n else 0.0))
    return sorted(rated, key=lambda r: -r[2] / max(r[1], 1e-6))


def cascade(docs: DataFrame, ordered: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` as column ``row``, with ``t`` (text) and ``kept``; later rules see only rows still alive."""
    df = _texts(docs, text_col).withColumn("kept", F.lit(True))
    for rule in ordered:
        df = rule.features(df, F.col("kept"))
        df = df.withColumn("kept", F.col("kept") & ~F.coalesce(rule.rejects(), F.lit(False)))
    return df.select("row", "t", "kept")


def quality_filter(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with the columns of ``docs``."""
    ordered = [r for r, _, _ in plan_rules(docs, rules, text_col, sample_rows)]
    return cascade(docs, ordered, text_col).filter("kept").select("row.*")


def quality_report(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every row with all features and ``kept``: as ``row``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_lines.

    All features are wanted here, so they are computed for all rows; the verdict is the cascade's.
    """
    rules = rules or default_rules()
    ordered = [r for r, _, _ in plan_rules(docs, rules, text_col, sample_rows)]
    df = _texts(docs, text_col)
    for rule in rules:
        df = rule.features(df, None)
    verdict = F.lit(True)
    for rule in reversed(ordered):
        verdict = F.when(rule.rejects(), F.lit(False)).otherwise(verdict)
    return df.withColumn("kept", verdict)
