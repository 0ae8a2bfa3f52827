"""Quality rules by divergence from language references, in DataFrame functions only.

For each language the corpus gives two references: shares of the classes of
characters, and shares of its commonest short words among all words.  A document
is compared with its language's references by the Jensen-Shannon distance (the
root of the divergence in bits, from 0 to 1).  Documents with few characters or
words, whose shares say little, and languages with few words are not judged.
Beside this there are plain counts of words, symbols, repeated lines and words
in repeated windows of three.

A document is handled in its own row, by passes that are linear in its length
and one sort of its word windows, so no row is shuffled; the references are
sums over all documents, added up before they are shuffled, of one row a
language.

Defined cases: null texts count as empty, so they have no words and fail; equal
texts of a language have equal verdicts and repeated rows are all returned; rows
without a language, or of one with few words, are judged by the plain counts
only; of equally common words the first in the order of code points is taken;
a table without rows gives none; very long texts are read whole; other columns
are kept, and those named like an output column are replaced.
"""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from tempora.llm.shared import written

BLANKS, BLANK = " \t\n\x0b\f\r", r"[\x20\x09-\x0D]+"
#: What is taken out of a text in turn; the rest is the last class.
CLASSES = [("lower", r"\p{Ll}+"), ("blank", BLANK), ("symbol", r"[#*$%&|<>]+"), ("upper", r"\p{Lu}+"), ("digit", r"\p{Nd}+"), ("mark", r"[.,;:!?'\"()-]+")]
#: Common words: so many of a language, of at most so many letters.
COMMON, LETTERS = 32, 5
NO_WORD = rf"[^\p{{L}}]+|\p{{L}}{{{LETTERS + 1},}}"
#: Words from which on a language has a reference and a document's words are judged; characters from which on its characters are.
LEAST_OF_LANGUAGE, LEAST_WORDS, LEAST_CHARACTERS = 1000, 100, 200
#: Hashes of windows up to which each window is looked up in their list.
FEW = 16
#: Distances from which on a document is rejected.
CHARACTERS_APART, WORDS_APART = 0.3, 0.34
OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "character_distance", "word_distance", "kept")
MEASURES = ("_lang", "_characters", "_short")


def _characters(df: DataFrame, text: str, to: str) -> DataFrame:
    """``df`` with an array of the number of characters of each class; the classes are taken out one after the other."""
    left, names = text, []
    for k, (_, pattern) in enumerate(CLASSES):
        rest = f"{to}_{k}"
        df = df.withColumn(rest, F.regexp_replace(left, pattern, ""))
        names.append((left, rest))
        left = rest
    counts = [F.length(a) - F.length(b) for a, b in names] + [F.length(left)]
    return df.withColumn(to, F.array(*[c.cast("long") for c in counts])).drop(*[b for _, b in names])


def _short_words(text: str) -> Column:
    """The short words in lower case, with empty strings where others stood."""
    return F.split(F.regexp_replace(F.lower(text), NO_WORD, " "), " ")


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK))


def _repeated(df: DataFrame, words: str, to: str) -> DataFrame:
    """``df`` with the number of words that lie in a window of three which is there twice.

    Windows are hashed, and only those whose hash is there twice are sorted as
    strings, which settles what is equal.
    """
    n = F.size(words)
    df = df.withColumn("starts", F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("hashes", F.transform("starts", lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(3)])))
    df = df.withColumn("sorted", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array("hashes")))
    df = df.withColumn("again", F.array_distinct(F.filter("sorted", lambda x, k: x == F.get(F.col("sorted"), k - 1))))
    few = F.filter("starts", lambda i: F.array_contains("again", F.get(F.col("hashes"), i)))
    asked = F.when(F.size("again") <= FEW, few).when(F.size("again") > FEW, F.col("starts"))

    def window(i: Column) -> Column:
        return F.struct(F.concat_ws(" ", *[F.get(F.col(words), i + k) for k in range(3)]).alias("words"), i.alias("at"))

    def twice(x: Column, k: Column) -> Column:
        return (F.get(F.col("windows"), k - 1)["words"] == x["words"]) | (F.get(F.col("windows"), k + 1)["words"] == x["words"])

    df = df.withColumn("asked", asked).withColumn("windows", F.sort_array(F.transform("asked", window)))
    places = F.sort_array(F.transform(F.filter("windows", twice), lambda x: x["at"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    # a window adds the words that the one before does not hold
    covered = F.aggregate(places, start, lambda so, at: F.struct(at.alias("last"), (so["n"] + F.least(F.lit(3), at - so["last"])).alias("n")))
    return df.withColumn(to, F.coalesce(covered["n"], F.lit(0).cast("long"))).drop("starts", "hashes", "sorted", "again", "asked", "windows")


def measured(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``docs`` with the plain counts, and MEASURES, from which references and verdicts are made: language, characters of each class, short words."""
    kept = [c for c in docs.columns if c.lower() not in (*OUTPUTS, *MEASURES)]
    # inner names no column of docs can clash with
    inner = [f"c{i}" for i in range(len(kept))]
    rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner)], F.col(f"`{lang}`").alias("_lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = _characters(rows, "text", "_characters").withColumn("words_of", _words(F.col("text"))).withColumn("n_words", F.size("words_of").cast("long"))
    rows = _repeated(rows, "words_of", "n_repeat_words")
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda s: F.btrim(s, F.lit(BLANKS)) != ""))
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    rows = rows.withColumn("word_chars", F.length("text").cast("long") - F.col("_characters")[1]).withColumn("n_symbols", F.col("_characters")[2])
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return rows.select(*[F.col(i).alias(c) for c, i in zip(kept, inner)], *OUTPUTS[:6], "_lang", "_characters", _short_words("text").alias("_short"))


def references(rows: DataFrame) -> DataFrame:
    """``(lang, characters, words, shares)`` of each language with enough words, of ``measured`` documents.

    Shares follow CLASSES and the rest, and ``words`` and the rest.
    """
    rows = rows.filter("_lang is not null").select(F.col("_lang").alias("lang"), "n_words", "_characters", "_short")
    classes = range(len(CLASSES) + 1)
    sums = rows.groupBy("lang").agg(F.sum("n_words").alias("n"), *[F.sum(F.col("_characters")[k]).alias(f"c{k}") for k in classes])
    total = reduce(Column.__add__, [F.col(f"c{k}") for k in classes])
    of_language = sums.filter(F.col("n") >= LEAST_OF_LANGUAGE).select("lang", "n", F.array(*[F.col(f"c{k}") / total for k in classes]).alias("characters"))

    counts = rows.select("lang", F.explode("_short").alias("word")).filter("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("times"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("times"), "word"))
    commonest = counts.withColumn("place", place).filter(F.col("place") <= COMMON)
    listed = commonest.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "word", "times"))).alias("listed"))
    joined = of_language.join(listed, "lang")
    told = F.aggregate("listed", F.lit(0).cast("long"), lambda n, x: n + x["times"])
    of_each = F.transform("listed", lambda x: x["times"] / F.greatest(F.col("n"), F.col("told")))
    rest = F.array(F.greatest(F.col("n") - F.col("told"), F.lit(0)) / F.greatest(F.col("n"), F.col("told")))
    return joined.withColumn("told", told).select("lang", "characters", F.col("listed.word").alias("words"), F.concat(of_each, rest).alias("shares"))


def distance(counts: Column, shares: Column) -> Column:
    """The Jensen-Shannon distance between ``counts`` and the ``shares`` of a reference; null without counts."""

    def gain(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def divergence(total: Column) -> Column:
        terms = F.zip_with(counts, shares, lambda c, q: (gain(c / total, (c / total + q) / 2) + gain(q, (c / total + q) / 2)) / 2)
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    # a list of one makes the total a variable, which is worked out once
    return F.when(total > 0, F.transform(F.array(total), lambda t: F.sqrt(F.greatest(divergence(t), F.lit(0.0))))[0])


def verdicts(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``measured`` documents with their distances to the ``known`` references and whether they are kept, without MEASURES."""
    others = [c for c in rows.columns if c not in (*OUTPUTS, *MEASURES)]
    inner = [f"c{i}" for i in range(len(others))]
    rows = rows.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(others, inner)], *OUTPUTS[:6], *MEASURES)
    rows = rows.join(known.withColumnRenamed("lang", "of_lang"), F.col("_lang") == F.col("of_lang"), "left")
    times = F.transform("words", lambda w: (F.size("_short") - F.size(F.array_remove("_short", w))).cast("long"))
    rows = rows.withColumn("times", F.when(F.col("words").isNotNull(), times))
    told = F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn("times", F.concat("times", F.array(F.greatest(F.col("n_words") - told, F.lit(0).cast("long")))))
    n_characters = F.aggregate("_characters", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn("character_distance", F.when(n_characters >= LEAST_CHARACTERS, distance(F.col("_characters"), F.col("characters"))))
    rows = rows.withColumn("word_distance", F.when(F.col("n_words") >= LEAST_WORDS, distance(F.col("times"), F.col("shares"))))
    apart = F.coalesce(F.col("character_distance") >= CHARACTERS_APART, F.lit(False)) | F.coalesce(F.col("word_distance") >= WORDS_APART, F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & ~apart).select(*[F.col(i).alias(c) for c, i in zip(others, inner)], *OUTPUTS)


def judged(docs: DataFrame, known: DataFrame | None = None, lang: str = "lang", text: str = "text") -> DataFrame:
    """``docs`` with plain counts, distances and whether they are kept; ``known`` are references, else those of ``docs``.

    Texts are read twice, for the references and for the verdicts; a caller that
    needs no texts afterwards can write what ``measured`` gives without them.
    """
    rows = measured(docs, lang, text)
    return verdicts(rows, written(references(rows) if known is None else known, "references"))
