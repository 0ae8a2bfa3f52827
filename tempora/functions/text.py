"""Words of a transcript as expressions: tokens, flags, syllables, keys."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

# Filler words.
FILLERS = ["um", "umm", "uh", "uhh", "er", "erm", "ah", "hmm", "mm", "mhm", "uhm", "eh"]
CLOSING = "\"')]}"


def words_in(text: Column) -> Column:
    """A text's words as ``words_of`` tells them apart: an array of (``w``, ``clean``, ``bare``)."""
    parts = F.split(F.trim(F.regexp_replace(F.regexp_replace(text, "[–—]|--", " "), r"[ \t\r\n\f]+", " ")), " ")
    tokens = F.transform(parts, lambda w: F.struct(w.alias("w"), F.regexp_replace(F.lower(w), "[^a-z']", "").alias("clean"), F.rtrim(w, F.lit(CLOSING)).alias("bare")))
    return F.filter(tokens, lambda t: F.length(t["clean"]) > 0)


def words_of(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` exploded to words: ``i`` (from 0), ``w``, ``clean``, ``sent_end``, ``clause_end``.

    Dashes separate; a word without a letter or apostrophe is left out and the
    rest is numbered anew; a sentence ends at ``. ? !`` and a clause also at
    ``, ; :``, closing quotes and brackets aside.
    """
    rows = df.select("*", F.posexplode(words_in(F.col(text))).alias("i", "_t"))
    return rows.select(*df.columns, "i", F.col("_t.w").alias("w"), F.col("_t.clean").alias("clean"), F.col("_t.bare").rlike(r"[.?!]$").alias("sent_end"), F.col("_t.bare").rlike(r"[,;:.?!]$").alias("clause_end"))


def repeats(text: Column) -> Column:
    """How often a word of a text follows itself; words are runs of the letters a to z."""
    return F.regexp_count(F.lower(text), F.lit(r"(?<![a-z])([a-z]++)(?=[^a-z]++\1(?![a-z]))")).cast("long")


def tokens_with_marks(text: Column) -> Column:
    """All tokens, empty ones too, each with its trailing punctuation split off."""
    return F.transform(F.split(text, r"\s+"), lambda t: F.struct(F.regexp_replace(t, r"[,;:.?!]+$", "").alias("w"), F.regexp_extract(t, r"([,;:.?!]+)$", 1).alias("punct")))


def syllables(word: Column) -> Column:
    """Groups of vowels, less a silent final e (not of -le or -ee) where more than one; 0 without a letter."""
    plain = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.size(F.regexp_extract_all(plain, F.lit("([aeiouy]+)"), F.lit(1)))
    silent = plain.rlike("e$") & ~plain.rlike("(le|ee)$") & (groups > 1)
    return F.when(F.length(plain) == 0, 0).otherwise(F.greatest(F.lit(1), groups - silent.cast("int")))


def normal(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"[^\p{L}']", "")


def slug(name: Column) -> Column:
    """A name as a file name of up to 40 signs; null where nothing is left."""
    made = F.substring(F.btrim(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_-]+", "-"), F.lit("-")), 1, 40)
    return F.when(F.length(made) > 0, made)


def seed_of(*parts: Column) -> Column:
    return F.crc32(F.concat_ws("|", *parts).cast("binary")) % 10000


def first_words(words: Column, start: Column, end: Column, width: int = 6) -> Column:
    """Words start..end (from 0) without punctuation, cut after ``width`` with an ellipsis."""
    chosen = F.slice(words, start + 1, F.least(end - start + 1, F.lit(width)))
    shown = F.array_join(F.transform(chosen, lambda w: F.regexp_replace(w, "[,;:.?!\"]", "")), " ")
    return F.when(end - start + 1 > width, F.concat(shown, F.lit("…"))).otherwise(shown)


def lookalikes(words: DataFrame, distance: int = 2, ratio: tuple[float, float] = (0.6, 1.6)) -> DataFrame:
    """For each distinct ``words(w, size)`` its most alike other word.

    Same first letter, lengths at most ``distance`` apart, size ratio in range;
    the smallest Levenshtein distance, then the alphabet decides.  Two words
    within a distance become the same by losing at most as many letters each,
    behind the first, so they meet on what is left and no others do but by chance.
    """
    rest = F.array(F.substring("w", 2, 1 << 20))
    lose = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(x))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    left = rest
    for _ in range(distance):
        rest = F.array_distinct(F.flatten(F.transform(rest, lose)))
        left = F.array_union(left, rest)
    a = words.filter("w <> ''").select("w", "size", F.substring("w", 1, 1).alias("first"), F.explode(left).alias("left"))
    b = a.select(F.col("w").alias("other"), F.col("size").alias("other_size"), "first", "left")
    near = a.join(b, ["first", "left"]).filter("w <> other").filter((F.col("other_size") / F.col("size")).between(*ratio)).select("w", "other").distinct()
    measured = near.withColumn("distance", F.levenshtein("w", "other")).filter((F.col("distance") <= distance) & (F.abs(F.length("w") - F.length("other")) <= distance))
    return measured.groupBy("w").agg(F.min(F.struct("distance", "other")).alias("best")).select("w", "best.other", "best.distance")
