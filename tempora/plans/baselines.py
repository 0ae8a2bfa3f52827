"""Baseline recordings: putting them together from a corpus, and auditing what was read.

``words(take_id, i, w, clean, punct, start_s, end_s)`` is the reference,
``heard(take_id, j, w, start_s, end_s)`` what was recognised, ``aligned(take_id,
ref_i, hyp_j)`` the alignment of both.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from tempora.functions.text import FILLERS
from tempora.operators import intervals, series
from tempora.sources.labels import until_total

#: Silence left at both ends of a piece, in seconds.
MARGIN = 0.3
ISSUES = ("kind", "time_s", "reference", "heard")
# Issues that a read text must not have.
HARD = ("filler", "repeat", "pause inside phrase", "extra words")


# ---------------------------------------------------------------- from a corpus


def pieces_of(rows: DataFrame, seconds: float, gap_s: float = 0.0) -> DataFrame:
    """A speaker's first recordings in order until they last ``seconds``, with where each begins: ``rows(speaker_id, number, text, duration_s)``."""
    taken = until_total(rows, ["speaker_id"], ["number"], "duration_s", seconds)
    w = Window.partitionBy("speaker_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return taken.withColumn("at_s", F.coalesce(F.sum(F.col("duration_s") + gap_s).over(w), F.lit(0.0)))


def texts_of(pieces: DataFrame) -> DataFrame:
    """One text a speaker, white space as single blanks, and how long it is."""
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    ordered = F.array_sort(F.collect_list(F.struct("number", clean.alias("text"))))  # a speaker's pieces
    return pieces.groupBy("speaker_id").agg(F.concat_ws(" ", F.transform(ordered, lambda p: p["text"])).alias("text"), F.sum("duration_s").alias("duration_s"))


def trimmed(frames: DataFrame, step_s: float = 0.01, range_db: float = 40.0) -> DataFrame:
    """``(path, from_s, to_s)``: the part of a recording within ``range_db`` of its loudest frame, with the margin: ``frames(path, frame_i, level)``."""
    top = frames.groupBy("path").agg(F.max("level").alias("top"), (F.max("frame_i") + 1).alias("n"))
    loud = frames.join(top, "path").filter(F.col("level") > F.col("top") - range_db).groupBy("path", "n").agg(F.min("frame_i").alias("a"), F.max("frame_i").alias("b"))
    return loud.select("path", F.greatest(F.lit(0.0), F.col("a") * step_s - MARGIN).alias("from_s"), F.least(F.col("n") * step_s, (F.col("b") + 2) * step_s + MARGIN).alias("to_s"))


def recordings_of_name(paths: DataFrame, path: str = "path") -> DataFrame:
    """``paths`` with recording, speaker and chunk out of names like ``12_S0042_chunk_7.wav``; null where a name is of another form."""
    part = lambda k: F.nullif(F.regexp_extract(path, r"^(\d+)_(\w+?)_chunk_(\d+)\.wav$", k), F.lit(""))
    return paths.withColumns({"recording": part(1), "speaker_id": part(2), "number": part(3).cast("int")})


def missing_chunks(pieces: DataFrame) -> DataFrame:
    """Speakers whose chunks are not numbered through from 0."""
    return pieces.groupBy("speaker_id").agg(F.count(F.lit(1)).alias("n"), F.max("number").alias("last")).filter("n <> last + 1")


# ---------------------------------------------------------------- audit


def _issue(kind: Column, time: Column, reference: Column, heard: Column) -> list[Column]:
    return [kind.alias("kind"), F.round(time, 2).alias("time_s"), reference.alias("reference"), heard.alias("heard")]


def misreadings(words: DataFrame, heard: DataFrame, aligned: DataFrame) -> DataFrame:
    """Runs of words that were skipped, added or read as others: ``(take_id, kind, time_s, reference, heard)``.

    A run's time is its first heard word's, else its first reference word's.
    """
    pairs = aligned.join(words.select("take_id", F.col("i").alias("ref_i"), F.col("clean").alias("ref_w"), F.col("start_s").alias("ref_s")), ["take_id", "ref_i"], "left")
    pairs = pairs.join(heard.select("take_id", F.col("j").alias("hyp_j"), F.col("w").alias("hyp_w"), F.col("start_s").alias("hyp_s")), ["take_id", "hyp_j"], "left")
    order = Window.partitionBy("take_id").orderBy("step")
    told = pairs.withColumn("equal", F.coalesce(F.col("ref_w") == F.col("hyp_w"), F.lit(False)))
    cut = series.sessions(told, ["take_id"], ["step"], F.col("equal") != F.lag("equal").over(order)).filter("not equal")
    joined = lambda c: F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("step", F.col(c).alias("x"))))), lambda p: p["x"]))
    runs = cut.groupBy("take_id", "session").agg(
        joined("ref_w").alias("reference"), joined("hyp_w").alias("heard"), F.count("ref_w").alias("n_ref"), F.count("hyp_w").alias("n_hyp"),
        F.coalesce(F.min(F.when(F.col("hyp_w").isNotNull(), ~F.col("hyp_w").isin(FILLERS))), F.lit(True)).alias("said"), F.max(~F.col("hyp_w").isin(FILLERS)).alias("word"),
        F.coalesce(F.min_by("hyp_s", F.when(F.col("hyp_s").isNotNull(), F.col("step"))), F.min_by("ref_s", F.when(F.col("ref_s").isNotNull(), F.col("step")))).alias("t"),
    )
    fillers = (F.col("n_hyp") > 0) & ~F.coalesce("word", F.lit(False))
    kind = (
        F.when(fillers, "filler").when(F.col("n_ref") == 0, "extra words").when((F.col("n_hyp") == 0) & (F.col("n_ref") > 6), "ASR dropout (recheck)")
        .when(F.col("n_hyp") == 0, "skipped word(s)").otherwise("misread / ASR mismatch")
    )
    return runs.select("take_id", *_issue(kind, F.col("t"), F.col("reference"), F.col("heard")))


def biased_fillers(prompted: DataFrame, known: DataFrame, apart_s: float = 0.5) -> DataFrame:
    """Fillers of the prompted pass that no known filler issue is near: ``prompted(take_id, w, start_s)``."""
    own = prompted.filter(F.col("w").isin(FILLERS)).withColumn("t", F.col("start_s"))
    at = known.filter("kind = 'filler'").select("take_id", F.col("time_s").alias("t"), F.lit(0).alias("k"))
    far = intervals.nearest(own, at, ["take_id"], "t", ["k"]).filter(F.col("gap").isNull() | (F.col("gap") >= apart_s))
    return far.select("take_id", *_issue(F.lit("filler"), F.col("start_s"), F.lit(""), F.col("w")))


def doubled(heard: DataFrame, words: DataFrame) -> DataFrame:
    """Heard words that follow themselves, but for fillers and words that do so in the reference as well."""
    twice = lambda df, order, c: df.withColumn("_next", F.lead(c).over(Window.partitionBy("take_id").orderBy(order))).filter(F.col(c) == F.col("_next"))
    allowed = twice(words, "i", "clean").select("take_id", F.col("clean").alias("w")).distinct()
    found = twice(heard, "j", "w").filter(~F.col("w").isin(FILLERS)).join(allowed, ["take_id", "w"], "left_anti")
    return found.select("take_id", *_issue(F.lit("repeat"), F.col("start_s"), F.lit(""), F.concat_ws(" ", "w", "w")))


def long_gaps(words: DataFrame, minor_s: float = 0.45, long_s: float = 0.6) -> DataFrame:
    """Gaps after a word without a stop."""
    gap = F.lead("start_s").over(Window.partitionBy("take_id").orderBy("i")) - F.col("end_s")
    told = words.withColumn("gap", gap).filter((F.length("punct") == 0) & (F.col("gap") > minor_s))
    kind = F.when(F.col("gap") > long_s, "pause inside phrase").otherwise("long pause (minor)")
    return told.select("take_id", *_issue(kind, F.col("end_s"), F.col("w"), F.format_string("%.2f s gap", F.col("gap"))))


def verdicts(takes: DataFrame, issues: DataFrame) -> DataFrame:
    """``(take_id, fillers, mismatch, disfluencies, status)`` of ``takes(take_id, n_words, clipped, snr_db, spontaneous)``.

    Disfluencies of spontaneous speech are its nature, those of a read text
    faults; clipping always is one.
    """
    lost = F.when(F.col("kind").isin("skipped word(s)", "misread / ASR mismatch"), F.greatest(F.lit(1), F.size(F.filter(F.split("reference", " "), lambda x: x != ""))))
    counts = issues.groupBy("take_id").agg(
        F.count_if(F.col("kind") == "filler").alias("fillers"), F.count_if(F.col("kind").isin(*HARD)).alias("hard"), F.count_if(F.col("kind") == "long pause (minor)").alias("minor"), F.sum(F.coalesce(lost, F.lit(0))).alias("lost")
    )
    told = takes.join(counts, "take_id", "left").fillna(0, ["fillers", "hard", "minor", "lost"]).withColumn("mismatch", F.col("lost") / F.greatest("n_words", F.lit(1)))
    status = (
        F.when(F.col("clipped") > 0.001, "FAIL").when(F.col("hard") > 0, F.when(F.col("spontaneous"), "NATURAL").otherwise("FAIL"))
        .when((F.col("mismatch") > 0.03) | (F.col("minor") > 0) | (F.col("snr_db") < 20), "REVIEW").otherwise("PASS")
    )
    return told.select("take_id", "fillers", F.round("mismatch", 3).alias("mismatch"), F.when(F.col("spontaneous"), F.col("hard")).otherwise(0).alias("disfluencies"), status.alias("status"))


def words_put_back(regions: DataFrame, words: DataFrame, heard: DataFrame) -> DataFrame:
    """Removed words that are still heard between their neighbours: ``regions(clip_id, rid, take_id, k)``, ``heard(clip_id, rid, j, w)`` round each join."""
    w = Window.partitionBy("take_id").orderBy("i")
    around = words.select("take_id", F.col("i").alias("k"), F.lag("clean").over(w).alias("before"), F.col("clean").alias("gone"), F.lead("clean").over(w).alias("after")).filter("before is not null and after is not null")
    h = Window.partitionBy("clip_id", "rid").orderBy("j")
    three = heard.select("clip_id", "rid", F.col("w").alias("before"), F.lead("w", 1).over(h).alias("gone"), F.lead("w", 2).over(h).alias("after"))
    return regions.join(around, ["take_id", "k"]).join(three, ["clip_id", "rid", "before", "gone", "after"]).select("clip_id", "rid", "take_id", "k", "gone").distinct()
