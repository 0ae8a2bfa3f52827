"""References for texts that a speaker shares with others: sentences matched across speakers and stitched in the text's order.

``sentences(text_id, s, first_s, last_s, before_s, after_s, words array<string>)``
from ``sentences_of``; a text is one speaker's reading.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tempora.operators import series

#: What the voice that leads, and the one that spoke last, have in advance.
LEAD, LAST = 0.05, 0.01


def sentences_of(words: DataFrame) -> DataFrame:
    """Sentences of ``words(text_id, i, clean, start_s, end_s, sent_end)`` from 0, with the times half way into the pauses around them."""
    w = Window.partitionBy("text_id").orderBy("i")
    cut = series.sessions(words, ["text_id"], ["i"], F.lag("sent_end").over(w))
    cut = cut.withColumns({"_before": (F.lag("end_s").over(w) + F.col("start_s")) / 2, "_after": (F.col("end_s") + F.lead("start_s").over(w)) / 2})
    return cut.groupBy("text_id", (F.col("session") - 1).alias("s")).agg(
        F.min("i").alias("i0"), F.max("i").alias("i1"), F.min_by("start_s", "i").alias("first_s"), F.max_by("end_s", "i").alias("last_s"),
        F.coalesce(F.min_by("_before", "i"), F.lit(0.0)).alias("before_s"), F.max_by("_after", "i").alias("after_s"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "clean"))), lambda x: x["clean"]).alias("words"),
    )


@F.pandas_udf(DoubleType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, list(x), list(y)).ratio() for x, y in zip(a, b)], dtype=float)


def sentence_pairs(sentences: DataFrame, speakers: Sequence[str], avoid: Sequence[str] = ()) -> DataFrame:
    """``(text_id, s, other, s2, ratio)`` of sentences that share a word with one of another usable speaker; others are alike by 0."""
    own = sentences.select("text_id", "s", F.col("words").alias("mine"), F.explode(F.array_distinct("words")).alias("w"))
    pool = sentences.filter(F.col("text_id").isin(*speakers) & ~F.col("text_id").isin(*avoid)) if avoid else sentences.filter(F.col("text_id").isin(*speakers))
    theirs = pool.select(F.col("text_id").alias("other"), F.col("s").alias("s2"), F.col("words").alias("theirs"), F.explode(F.array_distinct("words")).alias("w"))
    met = own.join(theirs, "w").filter("text_id <> other").groupBy("text_id", "s", "other", "s2").agg(F.first("mine").alias("mine"), F.first("theirs").alias("theirs"))
    return met.select("text_id", "s", "other", "s2", alike("mine", "theirs").alias("ratio"))


def leads(pairs: DataFrame, speakers: Sequence[str]) -> DataFrame:
    """``(text_id, lead)``: the speaker whose best sentences are most like the text's in all; of equal ones the first of ``speakers``."""
    best = pairs.groupBy("text_id", "other", "s").agg(F.max("ratio").alias("ratio")).groupBy("text_id", "other").agg(F.sum("ratio").alias("total"))
    place = F.array_position(F.array(*[F.lit(b) for b in speakers]), F.col("other"))
    return best.groupBy("text_id").agg(F.max_by("other", F.struct(F.round("total", 9), -place)).alias("lead"))


CHOSEN = StructType([
    StructField("text_id", StringType()), StructField("s", LongType()), StructField("other", StringType()), StructField("s2", LongType()), StructField("value", DoubleType()),
])


def chosen_sentences(pairs: DataFrame, speakers: Sequence[str], primary: str | None = None, only: DataFrame | None = None, least: float = 0.8) -> DataFrame:
    """For each sentence of a text the other sentence to stitch in: the likest, with an advance for the leading voice and the one before.

    Who speaks before is decided by the sentence before, so a text's sentences
    are gone through in order.  ``primary`` allows one speaker only, ``only(text_id,
    s)`` these sentences only.
    """
    place = F.array_position(F.array(*[F.lit(b) for b in speakers]), F.col("other"))
    some = pairs if primary is None else pairs.filter(F.col("other") == primary)
    some = some if only is None else some.join(only.select("text_id", "s"), ["text_id", "s"], "left_semi")
    asked = some.join(leads(some, speakers), "text_id").withColumn("place", place).select("text_id", "s", "other", "s2", "ratio", "lead", "place")

    def choose(rows: Iterator[dict]) -> Iterator[dict]:
        before, best = None, None

        def closed(best: dict | None) -> dict | None:
            return best if best is not None and best["value"] >= least else None

        for r in rows:
            if best is not None and best["s"] != r["s"]:
                if done := closed(best):
                    before = done["other"]
                    yield done
                best = None
            value = r["ratio"] + (LEAD if r["other"] == r["lead"] else LAST if r["other"] == before else 0.0)
            if best is None or value > best["value"]:
                best = {"text_id": r["text_id"], "s": r["s"], "other": r["other"], "s2": r["s2"], "value": value}
        if done := closed(best):
            yield done

    return series.folded(asked, ["text_id"], ["s", "place", "s2"], choose, CHOSEN)


def stitched(chosen: DataFrame, sentences: DataFrame, words: DataFrame, durations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pieces(text_id, s, other, from_s, to_s, at_s)`` and the re-timed ``words(text_id, i, clean, start_s, end_s)`` of stitched references.

    ``durations(text_id, duration_s)`` ends a speaker's last sentence.
    """
    of_other = sentences.select(F.col("text_id").alias("other"), F.col("s").alias("s2"), "before_s", "after_s", "i0", "i1").join(durations.select(F.col("text_id").alias("other"), "duration_s"), "other")
    cut = chosen.join(of_other, ["other", "s2"]).withColumns({"from_s": F.col("before_s"), "to_s": F.coalesce("after_s", "duration_s")})
    w = Window.partitionBy("text_id").orderBy("s")
    at = F.coalesce(F.sum(F.col("to_s") - F.col("from_s")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    pieces = cut.withColumn("at_s", at)
    spoken = pieces.select("text_id", "s", "other", "from_s", "at_s", F.explode(F.sequence("i0", "i1")).alias("j"))
    told = spoken.join(words.select(F.col("text_id").alias("other"), F.col("i").alias("j"), "clean", "start_s", "end_s"), ["other", "j"])
    moved = F.col("at_s") - F.col("from_s")
    number = F.row_number().over(Window.partitionBy("text_id").orderBy("s", "j")) - 1
    made = told.select("text_id", number.alias("i"), "clean", F.round(F.col("start_s") + moved, 4).alias("start_s"), F.round(F.col("end_s") + moved, 4).alias("end_s"))
    return pieces.select("text_id", "s", "other", "from_s", "to_s", "at_s"), made


def coverage(chosen: DataFrame, sentences: DataFrame) -> DataFrame:
    """``(text_id, sources, n_sentences, covered_to)``: who speaks, how much is covered, and the last word up to which nothing is missing (-1: none)."""
    have = sentences.join(chosen.select("text_id", "s", "other"), ["text_id", "s"], "left")
    gap = have.groupBy("text_id").agg(F.min(F.when(F.col("other").isNull(), F.col("s"))).alias("gap"))
    whole = have.join(gap, "text_id")
    return whole.groupBy("text_id").agg(
        F.array_sort(F.collect_set("other")).alias("sources"), F.count("other").alias("n_sentences"),
        F.coalesce(F.max(F.when(F.col("gap").isNull() | (F.col("s") < F.col("gap")), F.col("i1"))), F.lit(-1)).alias("covered_to"),
    )


def panel(pairs: DataFrame, speakers: Sequence[str], least: float = 0.8) -> DataFrame:
    """``(text_id, member)``: speakers other than a sole leading one who read every sentence that the primary reference covers."""
    primary = chosen_sentences(pairs, speakers, least=least)
    wanted = primary.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("other")).alias("sources"))
    likest = pairs.join(primary.select("text_id", "s"), ["text_id", "s"], "left_semi").groupBy("text_id", "other", "s").agg(F.max("ratio").alias("ratio"))
    read = likest.filter(F.col("ratio") + LEAD >= least).groupBy("text_id", F.col("other").alias("member")).agg(F.count(F.lit(1)).alias("has"))
    sole = (F.size("sources") == 1) & (F.element_at("sources", 1) == F.col("member"))
    return read.join(wanted, "text_id").filter((F.col("has") == F.col("n")) & ~sole).select("text_id", "member")


def common_prefix(words: DataFrame, speakers: Sequence[str]) -> DataFrame:
    """``(text_id, other, n)``: how many first words a text shares with each of the (few) ``speakers`` whose first word is the same."""
    w = Window.partitionBy("text_id")
    a = words.select("text_id", "i", "clean", (F.max("i").over(w) + 1).alias("n"))
    firsts = a.filter("i = 0").select("text_id", "clean", "n")
    both = firsts.join(firsts.filter(F.col("text_id").isin(*speakers)).select(F.col("text_id").alias("other"), "clean", F.col("n").alias("m")), "clean").filter("text_id <> other").select("text_id", "other", F.least("n", "m").alias("most"))
    one = both.join(a.select("text_id", "i", F.col("clean").alias("x")), "text_id").join(a.select(F.col("text_id").alias("other"), "i", F.col("clean").alias("y")), ["other", "i"])
    return one.groupBy("text_id", "other").agg(F.least(F.max("most"), F.coalesce(F.min(F.when(F.col("x") != F.col("y"), F.col("i"))), F.max("most"))).alias("n"))


def closest_text(prefixes: DataFrame, speakers: Sequence[str], avoid: Sequence[str] = ()) -> DataFrame:
    """``(text_id, other, n)``: the usable speaker with the longest common beginning; of equal ones the first."""
    usable = prefixes.filter(F.col("other").isin(*[s for s in speakers if s not in avoid]))
    place = F.array_position(F.array(*[F.lit(b) for b in speakers]), F.col("other"))
    return usable.groupBy("text_id").agg(F.max_by(F.struct("other", "n"), F.struct("n", -place)).alias("best")).select("text_id", "best.other", "best.n")
