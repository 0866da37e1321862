"""Spelling variant grouping: reduced-alphabet generation.

Letters are hashed to ``SYMBOLS`` symbols. Two words at one edit have reduced words at one edit
or none, so the full one-edit neighbourhood of every reduced word, joined with the reduced
vocabulary, meets every pair of near words; the candidates are then verified on the words
themselves. Neighbourhoods are made once per distinct reduced word and pair up in one order
only (a word with a later or longer one), since nearness is symmetric: the deletions of a word
are the insertions of the shorter one.

All of it is joins and aggregations of built-in functions: tokens are counted map-side, a
frequent reduced word is a skewed join key that Spark splits, and nothing comes to the driver.

A null text has no words, a null id counts as an empty one in the planted misspellings; empty
tables give empty results, ties go to the smaller word in code-point order, repeated rows count
each time, and extra columns aren't read. A very long text is one array of its words in one task.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored

MIN_LENGTH, MIN_COUNT = 6, 5
#: A form occurs at least so many times as often as its variant.
RATIO = 5
#: Letters of words, and to how many symbols they are hashed.
LETTERS = string.ascii_lowercase + "".join(map(chr, range(0xC0, 0x100)))
SYMBOLS = 6
#: One token in so many (by its hash) loses a letter in the query.
MISSPELT = 199


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", misspelt: int | None = None) -> DataFrame:
    """(word) for every maximal run of letters of every text, A-Z lower-cased; with ``misspelt``, a run whose
    crc32 of ``id:run`` it divides loses the letter at that hash modulo its length."""
    lower = F.translate(text_col, string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(lower, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    if not misspelt:
        return runs.select(F.col("run").alias("word"))
    h, at = F.crc32(F.concat("id", F.lit(":"), "run")), (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.left("run", at), F.substr("run", at + 2))
    return runs.withColumn("h", h).select(F.when(F.col("h") % misspelt == 0, short).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    long = words.filter(F.length("word") >= min_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def symbols(count: int = SYMBOLS) -> str:
    return string.ascii_lowercase[:count]


def reduced(word: Column, count: int = SYMBOLS) -> Column:
    return F.translate(word, LETTERS, "".join(symbols(count)[ord(c) % count] for c in LETTERS))


def neighbourhood(code: Column, count: int = SYMBOLS) -> Column:
    """The reduced words at one replacement, insertion or none that come after ``code`` by (length, text), itself included.

    The rest of the full neighbourhood, its deletions and smaller replacements, has ``code`` in its own part.
    """
    letters = F.array(*map(F.lit, symbols(count)))
    at = F.sequence(F.lit(1), F.length(code))
    head, tail = lambda i: F.left(code, i - 1), lambda i: F.substr(code, i + 1)
    replaced = F.flatten(F.transform(at, lambda i: F.transform(F.filter(letters, lambda a: a >= F.substr(code, i, F.lit(1))),
                                                               lambda a: F.concat(head(i), a, tail(i)))))
    gaps = F.sequence(F.lit(0), F.length(code))
    inserted = F.flatten(F.transform(gaps, lambda i: F.transform(letters, lambda a: F.concat(F.left(code, i), a, tail(i)))))
    return F.array_distinct(F.concat(replaced, inserted))


def near_pairs(vocab: DataFrame, count: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n) for every ordered pair of words of ``vocab`` (word, n) at exactly one edit."""
    coded = stored(vocab.select("word", "n", reduced(F.col("word"), count).alias("code")), "variant-codes")
    codes = stored(coded.select("code").distinct(), "variant-reduced")
    made = codes.select(F.col("code").alias("a"), F.explode(neighbourhood(F.col("code"), count)).alias("b"))
    met = stored(made.join(codes.withColumnRenamed("code", "b"), "b"), "variant-neighbours")
    left = coded.select(F.col("word").alias("x"), F.col("n").alias("x_n"), F.col("code").alias("a"))
    right = coded.select(F.col("word").alias("y"), F.col("n").alias("y_n"), F.col("code").alias("b"))
    pairs = met.join(left, "a").join(right, "b").filter((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    pairs = stored(pairs.filter(F.levenshtein("x", "y", 1) == 1).select("x", "x_n", "y", "y_n"), "variant-pairs")
    return pairs.toDF("word", "n", "near", "near_n").union(pairs.select("y", "y_n", "x", "x_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain of forms, by pointer doubling.

    A form is several times as frequent as its word, so a chain is shorter than the 64 bits of a count.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now


def group_variants(vocab: DataFrame, ratio: int = RATIO, count: int = SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``vocab`` (word, n).

    form: its near word of largest n, if that is ``ratio`` times its own n or more; root: the last of the chain of forms.
    """
    vocab = stored(vocab.select("word", "n"), "variant-vocabulary")
    best = near_pairs(vocab, count).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    found = vocab.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                                    F.col("best.near").alias("near"), (-F.col("best.col1")).alias("near_n"))
    takes = F.col("near_n") >= ratio * F.col("n")
    found = stored(found.select("word", "n", "n_near", F.when(takes, F.col("near")).alias("form"), F.when(takes, F.col("near_n")).alias("form_n")), "variant-forms")
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
