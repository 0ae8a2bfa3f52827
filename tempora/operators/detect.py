"""Detectors of delivery flaws without a reference recording, from words, frames and what is usual among speakers.

Tables, as far as a detector needs them:

* ``words(clip_id, i, clean, start_s, end_s, heard, sim, heard_w, btype)``: the transcript with its times in the recording,
  ``btype`` the kind of boundary after a word (the last word ends a sentence);
* ``frames(clip_id, frame_i, f0_st, inten, hf, voiced)`` of 10 ms, unvoiced pitch null;
* ``clips(clip_id, duration_s)``;
* ``heard(clip_id, w, start_s, end_s)`` recognised words, ``prompted`` the same from a pass that writes fillers;
* ``inserted(clip_id, w, start_s, end_s, after)`` recognised words without a partner, after which transcript word.

Every detector returns ``(clip_id, flaw, start_s, end_s, d, w0, w1, facts)``.
What other clips are in a table never changes a clip's result: what is usual
comes as ``Norms``, and the rest is measured against the clip itself.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql.types import DoubleType

from tempora.functions.text import FILLERS, syllables
from tempora.operators import align, intervals, series

# The area of each flaw.
CATEGORY = {
    "PACE_FAST": "Pacing", "PACE_SLOW": "Pacing", "PAUSE_BAD": "Pausing", "PAUSE_LOST": "Pausing", "MONOTONE": "Intonation", "UPTALK": "Intonation",
    "EMPH_FLAT": "Intonation", "FADE": "Volume", "SHOUT": "Volume", "FILLER": "Fluency", "REPEAT": "Fluency", "RARE_HESIT": "Fluency", "SLUR": "Clarity",
    "WORD_SKIP": "Text fidelity", "WORD_SWAP": "Text fidelity",
}

# Thresholds where no fitted ones are given.
DEFAULTS = {
    "pause_bad": 0.8, "pause_loose_mult": 1.6, "lost_frac": 0.25, "pace_k_fast": 2.0, "pace_k_slow": 2.0, "pace_min_s": 1.2, "pace_win": 2, "mono_ratio": 0.62,
    "mono_min_s": 2.4, "uptalk_st": 2.0, "fade_db": 3.5, "shout_db": 4.0, "slur_db": 4.0, "swap_sim": 0.8, "ins_p": 0.5, "filler_min_s": 0.1, "repeat_sim": 0.6,
    "skip_min_words": 1, "flat_range": 2.0, "flat_min_s": 0.25, "flat_istd": 4.0, "flat_mult": 0.8, "flat_unexpl": 0.2, "long_pause": 1.0,
}

# Words whose length tells little of their duration.
FUNCTION_WORDS = (
    "the a an of to in on at for and or but is are was were be it its that this with as by from we he she they i you his her their our my"
).split()

# Flaws measured against the rest of the clip, and those that need a text which was really given.
SELF_NORMALISED = ("PACE_FAST", "PACE_SLOW", "FADE", "SHOUT", "SLUR", "MONOTONE")
NEEDS_TEXT = ("WORD_SKIP", "WORD_SWAP", "REPEAT")

FOUND = "clip_id string, flaw string, start_s double, end_s double, d double, w0 int, w1 int, facts map<string, string>"
STEP = 0.01


@dataclass(frozen=True)
class Norms:
    """What is usual among clean speakers; the values here hold where nothing was fitted.

    ``durations`` are the coefficients of a word's log duration: syllables,
    letters, function word, before a pause, at a sentence's end, one.
    """

    sentence_pause: float = 0.5
    final_rise: float = -3.0
    fade_db: float = -1.0
    durations: tuple[float, ...] = ()


@dataclass(frozen=True)
class Classifier:
    """A fitted logistic classifier; a feature without spread adds nothing."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float
    means: tuple[float, ...]
    sds: tuple[float, ...]

    def probability(self) -> Column:
        total = F.lit(float(self.bias))
        for name, w, m, s in zip(self.features, self.weights, self.means, self.sds):
            if w and s > 1e-8:
                total = total + w * (F.col(name) - m) / s
        return 1 / (1 + F.exp(-total))


@dataclass(frozen=True)
class Clips:
    """The tables of some recordings, for ``detected``."""

    words: DataFrame
    frames: DataFrame
    clips: DataFrame
    heard: DataFrame
    prompted: DataFrame
    inserted: DataFrame
    norms: Norms = field(default_factory=Norms)
    insertions: Classifier | None = None


def by_word() -> Window:
    return Window.partitionBy("clip_id").orderBy("i")


def facts(**values: Column) -> Column:
    """Facts of a detection as strings; null ones are left out."""
    if not values:
        return F.from_json(F.lit("{}"), "map<string, string>")
    made = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(made, lambda k, v: v.isNotNull())


def regions(df: DataFrame, flaw: str | Column, **told: Column) -> DataFrame:
    name = F.lit(flaw) if isinstance(flaw, str) else flaw
    return df.select(
        "clip_id", name.alias("flaw"), F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"), F.col("d").cast("double").alias("d"),
        F.col("w0").cast("int").alias("w0"), F.col("w1").cast("int").alias("w1"), facts(**told).alias("facts"),
    )


def frames_in(spans: DataFrame, frames: DataFrame, start: str, end: str) -> DataFrame:
    """``frames`` of the span of every row of ``spans``, by an equi-join on frame numbers."""
    first, last = F.floor(F.greatest(F.lit(0.0), F.col(start)) / STEP).cast("long"), F.greatest(F.lit(1), F.floor(F.col(end) / STEP)).cast("long") - 1
    asked = spans.filter(last >= first).withColumn("frame_i", F.explode(F.sequence(first, last)))
    return asked.join(frames.withColumn("frame_i", F.col("frame_i").cast("long")), ["clip_id", "frame_i"])


def quartile_range() -> Column:
    """Of the voiced frames of a group, where there are more than ten."""
    return series.quartile_range("f0_st", 11)


def measured(spans: DataFrame, frames: DataFrame, start: str, end: str, keys: list[str], value: Column, name: str) -> DataFrame:
    """``spans`` with a measure of their frames, null where there are too few."""
    of_frames = frames_in(spans.select("clip_id", *keys, start, end), frames, start, end).groupBy("clip_id", *keys).agg(value.alias(name))
    return spans.join(of_frames, ["clip_id", *keys], "left")


def spread_words(runs: DataFrame, words: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """``runs(w0, w1)`` widened by words on both sides, with the times of the first and last one."""
    last = words.groupBy("clip_id").agg(F.max("i").alias("last_i"))
    wide = runs.join(last, "clip_id").withColumn("w0", F.greatest(F.lit(0), F.col("w0") - before)).withColumn("w1", F.least("last_i", F.col("w1") + after)).drop("last_i")
    starts, ends = words.select("clip_id", F.col("i").alias("w0"), "start_s"), words.select("clip_id", F.col("i").alias("w1"), "end_s")
    return wide.drop("start_s", "end_s").join(starts, ["clip_id", "w0"]).join(ends, ["clip_id", "w1"])


def word_runs(df: DataFrame, flag: Column, *aggregates: Column) -> DataFrame:
    return series.runs(df, ["clip_id"], ["i"], flag, [F.min("i").alias("w0"), F.max("i").alias("w1"), *aggregates])


# ---------------------------------------------------------------- pauses


def boundary_silences(words: DataFrame, silences: DataFrame, most_s: float = 0.7, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """The longest silence at each boundary ``(clip_id, k, mid, long, s0, s1)``; each silence goes to the nearest boundary only."""
    later = F.lead(start).over(by_word())
    ends = words.select("clip_id", F.col("i").alias("k"), ((F.col(end) + later) / 2).alias("t")).filter("t is not null")
    centres = silences.select("clip_id", ((F.col("start_s") + F.col("end_s")) / 2).alias("t"), (F.col("end_s") - F.col("start_s")).alias("long"), F.col("start_s").alias("s0"), F.col("end_s").alias("s1"))
    met = intervals.nearest(centres, ends, ["clip_id"], "t", ["k"], most=most_s).filter("r_k is not null")
    longest = met.groupBy("clip_id", F.col("r_k").alias("k")).agg(F.max_by(F.struct("long", "s0", "s1"), F.struct("long", -F.col("s0"))).alias("s"))
    at = ends.withColumnRenamed("t", "mid").join(longest, ["clip_id", "k"], "left")
    return at.select("clip_id", "k", "mid", F.coalesce("s.long", F.lit(0.0)).alias("long"), F.coalesce("s.s0", "mid").alias("s0"), F.coalesce("s.s1", "mid").alias("s1"))


def pauses(words: DataFrame, frames: DataFrame, clips: DataFrame, norms: Norms, th: Mapping[str, float]) -> DataFrame:
    """Pauses where none belongs, and none where one belongs, by the kind of boundary after a word."""
    quiet = series.silences(frames.withColumn("role", F.lit("par")), least_s=0.1)
    last = words.groupBy("clip_id").agg(F.max("i").alias("last_i"))
    at = boundary_silences(words, quiet).join(words.select("clip_id", F.col("i").alias("k"), "btype"), ["clip_id", "k"]).join(clips, "clip_id").join(last, "clip_id")
    at = at.filter((F.col("s0") >= 0.4) & (F.col("s1") <= F.col("duration_s") - 0.3))
    limit = F.when(F.col("btype") == "phrase_tight", th["pause_bad"]).when(F.col("btype") == "phrase_loose", th["pause_bad"] * th["pause_loose_mult"])
    long = (F.col("btype") != "sentence") & (F.col("long") >= th["long_pause"])
    words_of = {"w0": F.col("k"), "w1": F.col("k") + 1}
    bad = at.filter(long | (F.col("long") >= limit)).withColumns({"start_s": F.col("s0"), "end_s": F.col("s1"), "d": F.col("long"), **words_of})
    usual = norms.sentence_pause
    lost = at.filter((F.col("btype") == "sentence") & (F.col("k") < F.col("last_i") - 1) & (F.col("long") < th["lost_frac"] * usual))
    lost = lost.withColumns({"start_s": F.col("mid") - 0.05, "end_s": F.col("mid") + 0.05, "d": F.greatest(usual - F.col("long"), F.lit(0.0)), **words_of})
    told = regions(bad, "PAUSE_BAD", boundary=F.col("btype"), long_hesitation=F.when(long, F.lit(True)))
    return told.unionByName(regions(lost, "PAUSE_LOST", boundary=F.col("btype"), typical_s=F.lit(usual)))


# ---------------------------------------------------------------- pace


def duration_parts() -> tuple[Column, ...]:
    """What a word's duration depends on: syllables, letters, function word, before a pause, at a sentence's end, one."""
    return (
        syllables(F.col("clean")), F.length("clean"), F.col("clean").isin(FUNCTION_WORDS).cast("int"), F.col("btype").isin("sentence", "clause_punct").cast("int"),
        (F.col("btype") == "sentence").cast("int"), F.lit(1),
    )


def duration_residuals(words: DataFrame, norms: Norms) -> DataFrame:
    """``words`` with ``resid``: log duration less what length and position let expect and less the clip's median; ``expected_s``; null where not heard."""
    predicted = sum((c * p for c, p in zip(norms.durations, duration_parts())), F.lit(0.0))
    log = F.when(F.col("heard"), F.log(F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.03))))
    told = words.withColumn("predicted", predicted).withColumn("raw", log - F.col("predicted"))
    usual = told.groupBy("clip_id").agg(F.median("raw").alias("usual"))
    return told.join(usual, "clip_id").withColumn("resid", F.col("raw") - F.col("usual")).withColumn("expected_s", F.when(F.col("heard"), F.exp(F.col("predicted") + F.col("usual")))).drop("raw", "usual", "predicted")


def pace(words: DataFrame, norms: Norms, th: Mapping[str, float]) -> DataFrame:
    """Runs of words whose durations are far from expected, against the clip's own spread; spans reach to the words that the mean took in."""
    half = int(th["pace_win"])
    smooth = duration_residuals(words, norms).withColumn("v", series.mean_around("resid", ["clip_id"], ["i"], half))
    scored = series.robust_scores(smooth, ["clip_id"], "v", floor=0.05).withColumn("z", F.col("v") / F.col("spread"))
    enough = scored.groupBy("clip_id").agg(F.count("v").alias("valid")).filter("valid >= 10").select("clip_id")
    scored = scored.join(enough, "clip_id", "left_semi")
    out = None
    for flaw, flag, sign in (("PACE_FAST", F.col("z") <= -th["pace_k_fast"], -1), ("PACE_SLOW", F.col("z") >= th["pace_k_slow"], 1)):
        found = spread_words(word_runs(scored, flag, F.exp(sign * F.median("v")).alias("d")), words, half, half)
        found = regions(found.filter(F.col("end_s") - F.col("start_s") >= th["pace_min_s"]), flaw)
        out = found if out is None else out.unionByName(found)
    return out


# ---------------------------------------------------------------- pitch and level


def monotone(words: DataFrame, frames: DataFrame, th: Mapping[str, float], rows: int = 12, step: int = 3) -> DataFrame:
    """Stretches whose pitch range is a small share of the clip's."""
    whole = frames.groupBy("clip_id").agg(quartile_range().alias("whole")).filter("whole > 0.5")
    n = words.groupBy("clip_id").agg((F.max("i") + 1).alias("n"))
    firsts = n.select("clip_id", F.explode(F.expr(f"sequence(0, greatest(0, n - {rows}), {step})")).alias("w0")).withColumn("w1", F.col("w0") + rows - 1)
    windows = measured(spread_words(firsts, words), frames, "start_s", "end_s", ["w0", "w1"], quartile_range(), "own").join(whole, "clip_id")
    flat = windows.filter(F.col("own") <= th["mono_ratio"] * F.col("whole")).select("clip_id", F.explode(F.sequence("w0", "w1")).alias("i")).distinct().withColumn("flat", F.lit(True))
    found = spread_words(word_runs(words.join(flat, ["clip_id", "i"], "left"), F.col("flat")), words).filter(F.col("end_s") - F.col("start_s") >= th["mono_min_s"])
    found = measured(found, frames, "start_s", "end_s", ["w0", "w1"], quartile_range(), "own").join(whole, "clip_id")
    return regions(found.withColumn("d", F.coalesce(F.col("whole") - F.col("own"), F.lit(0.0))), "MONOTONE", iqr_here=F.round("own", 2), iqr_clip=F.round("whole", 2))


def ahead(words: DataFrame, frames: DataFrame, rows: int, value: Column, least: int, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """``words`` with ``v``: a measure of the frames of the word and those after it, ``rows`` in all or as many as there are."""
    w = by_word()
    spans = words.withColumn("_to", F.last(end).over(w.rowsBetween(0, rows - 1)))
    return measured(spans, frames, start, "_to", ["i"], F.when(F.count(F.lit(1)) > least, value), "v").drop("_to")


def top_share(value: str = "hf", share: float = 0.3) -> Column:
    """Mean of the largest ``share`` of a group's values; a group is the frames of a few words."""
    ordered = F.sort_array(F.collect_list(value), asc=False)
    top = F.slice(ordered, 1, F.greatest(F.lit(1), F.floor(share * F.size(ordered)).cast("int")))
    return F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)


def window_runs(told: DataFrame, words: DataFrame, limit: Column, rows: int, flaw: str, least_s: float) -> DataFrame:
    """Runs of ``told(clip_id, i, over)`` at or above ``limit``, widened by the window, with the largest value in it."""
    found = spread_words(word_runs(told, F.coalesce("over", F.lit(0.0)) >= limit), words, 0, rows - 1).filter(F.col("end_s") - F.col("start_s") >= least_s)
    inside = found.withColumn("i", F.explode(F.sequence("w0", "w1"))).join(told.select("clip_id", "i", "over"), ["clip_id", "i"])
    peaks = inside.groupBy("clip_id", "w0", "w1").agg(F.max(F.coalesce("over", F.lit(0.0))).alias("d"))
    return regions(found.drop("d").join(peaks, ["clip_id", "w0", "w1"]), flaw)


def _against_clip(words: DataFrame, frames: DataFrame, rows: int, value: Column, least: int, sign: int, limit: float, flaw: str, least_s: float) -> DataFrame:
    v = ahead(words, frames, rows, value, least)
    usual = v.groupBy("clip_id").agg(F.median("v").alias("usual"), F.count("v").alias("valid")).filter("valid >= 10")
    return window_runs(v.join(usual, "clip_id").withColumn("over", sign * (F.col("v") - F.col("usual"))), words, F.lit(limit), rows, flaw, least_s)


def shout(words: DataFrame, frames: DataFrame, th: Mapping[str, float]) -> DataFrame:
    """Stretches of six words much louder than the clip."""
    return _against_clip(words, frames, 6, F.percentile("inten", F.lit(0.8)), 5, 1, th["shout_db"], "SHOUT", 0.6)


def slur(words: DataFrame, frames: DataFrame, th: Mapping[str, float]) -> DataFrame:
    """Stretches of seven words whose consonants are much weaker than the clip's."""
    return _against_clip(words, frames, 7, top_share(), 8, -1, th["slur_db"], "SLUR", 1.0)


def sentences(words: DataFrame) -> DataFrame:
    """``words`` with ``sentence`` (from 1); one ends with a word before a sentence boundary."""
    return series.sessions(words, ["clip_id"], ["i"], F.lag("btype").over(by_word()) == "sentence").withColumnRenamed("session", "sentence")


def sentence_tails(words: DataFrame, tail_s: float, spare: int, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Sentences of five words or more whose last word was heard: ``(clip_id, sentence, first, w0, w1)``.

    ``w0`` is the first word, but for the sentence's ``spare`` first ones, from
    which on less than ``tail_s`` seconds are left.
    """
    whole = Window.partitionBy("clip_id", "sentence")
    s = sentences(words).withColumns({"first": F.min("i").over(whole), "w1": F.max("i").over(whole), "last_s": F.max_by(end, "i").over(whole), "ok": F.max_by("heard", "i").over(whole)})
    late = (F.col("i") >= F.col("first") + spare) & (F.col("last_s") - F.col(start) < tail_s)
    s = s.filter((F.col("w1") - F.col("first") >= 4) & F.col("ok")).withColumn("late", F.when(late | (F.col("i") == F.col("w1")), F.col("i")))
    return s.groupBy("clip_id", "sentence", "first", "w1").agg(F.min("late").alias("w0"))


def final_rise(last_words: DataFrame, frames: DataFrame, start: str = "start_s", end: str = "end_s", name: str = "rise") -> DataFrame:
    """``(clip_id, i, rise)``: the pitch of a word's last five voiced frames over that of its loudest one; null under six."""
    voiced = frames_in(last_words.select("clip_id", "i", start, end), frames.filter("f0_st is not null"), start, end)
    late = voiced.withColumn("late", F.row_number().over(Window.partitionBy("clip_id", "i").orderBy(F.desc("frame_i"))))
    rise = F.median(F.when(F.col("late") <= 5, F.col("f0_st"))) - F.max_by("f0_st", F.struct("inten", -F.col("frame_i")))
    return late.groupBy("clip_id", "i").agg(F.when(F.count(F.lit(1)) >= 6, rise).alias(name))


def uptalk(words: DataFrame, frames: DataFrame, norms: Norms, th: Mapping[str, float]) -> DataFrame:
    """Sentences whose pitch rises at the end, against the usual final rise."""
    tails = sentence_tails(words, 1.0, 1)
    lasts = words.join(tails.select("clip_id", F.col("w1").alias("i")), ["clip_id", "i"])
    rises = final_rise(lasts, frames).withColumnRenamed("i", "w1")
    found = tails.join(rises, ["clip_id", "w1"]).withColumn("d", F.col("rise") - norms.final_rise).filter(F.col("d") >= th["uptalk_st"])
    return regions(spread_words(found, words), "UPTALK", rise_st=F.round("rise", 2), typical_st=F.lit(norms.final_rise))


def level_fall(tails: DataFrame, words: DataFrame, frames: DataFrame, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """``tails`` with ``fall``: the mean level of their words less that of the sentence before them; null under five frames of either."""
    at = {n: words.select("clip_id", F.col("i").alias(n), F.col(c).alias(f"{n}_s")) for n, c in (("first", start), ("w0", start), ("w1", end))}
    spans = tails.join(at["first"], ["clip_id", "first"]).join(at["w0"], ["clip_id", "w0"]).join(at["w1"], ["clip_id", "w1"])
    enough = F.when(F.count(F.lit(1)) >= 5, F.avg("inten"))
    spans = measured(measured(spans, frames, "w0_s", "w1_s", ["sentence"], enough, "tail_level"), frames, "first_s", "w0_s", ["sentence"], enough, "rest_level")
    return spans.withColumn("fall", F.col("tail_level") - F.col("rest_level")).drop("first_s", "w0_s", "w1_s", "tail_level", "rest_level")


def fade(words: DataFrame, frames: DataFrame, norms: Norms, th: Mapping[str, float]) -> DataFrame:
    """Sentences whose end is much softer than the rest, against the usual fall."""
    told = level_fall(sentence_tails(words, 1.4, 2), words, frames).withColumn("d", norms.fade_db - F.col("fall")).filter(F.col("d") >= th["fade_db"])
    return regions(spread_words(told, words), "FADE", typical_db=F.lit(norms.fade_db))


# ---------------------------------------------------------------- text


def skipped(words: DataFrame, th: Mapping[str, float]) -> DataFrame:
    """Runs of transcript words that were not heard, not at either end."""
    ends = words.groupBy("clip_id").agg(F.max("i").alias("last_i"))
    missing = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("i", "clean"))), lambda x: x["clean"]))
    gone = word_runs(words, ~F.col("heard"), missing.alias("missing")).join(ends, "clip_id").filter((F.col("w0") > 0) & (F.col("w1") < F.col("last_i")) & (F.col("n") >= th["skip_min_words"]))
    before, after = words.select("clip_id", (F.col("i") + 1).alias("w0"), F.col("end_s").alias("left_s")), words.select("clip_id", (F.col("i") - 1).alias("w1"), F.col("start_s").alias("right_s"))
    at = gone.join(before, ["clip_id", "w0"]).join(after, ["clip_id", "w1"]).withColumn("t", (F.col("left_s") + F.col("right_s")) / 2)
    return regions(at.withColumns({"start_s": F.col("t") - 0.025, "end_s": F.col("t") + 0.025, "d": F.col("n")}), "WORD_SKIP", n_words=F.col("n"), missing=F.col("missing"))


def swapped(words: DataFrame, th: Mapping[str, float]) -> DataFrame:
    """Words heard as another."""
    other = words.filter(F.col("heard") & (F.col("sim") < th["swap_sim"])).withColumns({"end_s": F.greatest("end_s", F.col("start_s") + 0.1), "d": F.lit(1.0), "w0": F.col("i"), "w1": F.col("i")})
    return regions(other, "WORD_SWAP", heard=F.col("heard_w"))


def said_fillers(prompted: DataFrame, th: Mapping[str, float]) -> DataFrame:
    """Filler words of the prompted pass; of those that begin in the same tenth of a second the first."""
    long = prompted.filter(F.col("w").isin(FILLERS) & (F.col("end_s") - F.col("start_s") >= th["filler_min_s"]))
    first = Window.partitionBy("clip_id", F.bround("start_s", 1)).orderBy("start_s", "end_s")
    one = long.withColumn("_k", F.row_number().over(first)).filter("_k = 1").withColumns({"d": F.col("end_s") - F.col("start_s"), "w0": F.lit(0), "w1": F.lit(0)})
    return regions(one, "FILLER", heard=F.col("w"))


@F.pandas_udf(DoubleType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([align.similarity(x, y) for x, y in zip(a, b)], dtype=float)


def repeated(words: DataFrame, inserted: DataFrame, th: Mapping[str, float]) -> DataFrame:
    """Inserted words that are like one of the transcript's words near them (three before, four after)."""
    own = inserted.filter(~F.col("w").isin(FILLERS)).withColumn("id", F.struct("start_s", "end_s", "w", "after"))
    near = own.withColumn("i", F.explode(F.sequence(F.greatest(F.lit(0), F.col("after") - 3), F.col("after") + 4))).join(words.select("clip_id", "i", "clean"), ["clip_id", "i"])
    met = near.filter(alike("w", "clean") >= th["repeat_sim"]).select("clip_id", "id").distinct().select("clip_id", "id.*")
    at = F.greatest(F.lit(0), F.col("after"))
    return regions(met.withColumns({"d": F.col("end_s") - F.col("start_s"), "w0": at, "w1": at}), "REPEAT", heard=F.col("w"))


# ---------------------------------------------------------------- voiced sounds that no word explains


def word_before(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with ``w0``, the last heard word that ends by its start (0 where none does), and the one after it."""
    ends = words.filter("heard").select("clip_id", (F.col("end_s") - 0.05).alias("t"), "i")
    last = intervals.asof_before(found.withColumn("t", F.col("start_s")), ends.withColumn("t", F.col("t")), ["clip_id"], "t", ["i"])
    n = words.groupBy("clip_id").agg(F.max("i").alias("last_i"))
    told = last.join(n, "clip_id").withColumn("w0", F.coalesce("r_i", F.lit(0)))
    return told.withColumn("w1", F.least(F.col("w0") + 1, F.col("last_i"))).drop("t", "r_t", "r_i", "last_i")


def nearest_edge(found: DataFrame, edges: DataFrame, at: str, name: str) -> DataFrame:
    """``found`` with the distance of its time ``at`` from the nearest of ``edges(clip_id, t)``."""
    met = intervals.nearest(found.withColumn("t", F.col(at)), edges.select("clip_id", "t", F.lit(0).alias("e")), ["clip_id"], "t", ["e"])
    return met.withColumn(name, F.col("gap")).drop("t", "r_t", "r_e", "gap")


INSERTION_FEATURES = ("len", "level", "f0sd", "voiced", "d_edge", "ctx_left", "ctx_right", "flux", "high")


def unexplained(frames: DataFrame, heard: DataFrame, prompted: DataFrame, least_s: float = 0.08) -> DataFrame:
    """Voiced stretches outside all recognised words, with the nine features that tell a filler from what is left over."""
    said = heard.select("clip_id", "start_s", "end_s").unionByName(prompted.filter(~F.col("w").isin(FILLERS)).select("clip_id", "start_s", "end_s"))
    first, last = F.floor(F.greatest(F.col("start_s") + 0.03, F.lit(0.0)) / STEP).cast("long"), F.floor(F.greatest(F.col("end_s") - 0.03, F.lit(0.0)) / STEP).cast("long") - 1
    covered = said.filter(last >= first).select("clip_id", F.explode(F.sequence(first, last)).alias("frame_i")).distinct().withColumn("covered", F.lit(True))
    w = Window.partitionBy("clip_id").orderBy("frame_i")
    quiet = frames.groupBy("clip_id").agg((0.65 * F.percentile("inten", F.lit(0.05))).alias("quiet"))
    marked = frames.withColumn("frame_i", F.col("frame_i").cast("long")).join(covered, ["clip_id", "frame_i"], "left").join(quiet, "clip_id")
    marked = marked.withColumns({
        "step": F.abs(F.col("hf") - F.lag("hf").over(w)), "left": F.min("inten").over(w.rowsBetween(-30, -1)), "right": F.min("inten").over(w.rowsBetween(1, 30)),
    })
    flag = (F.col("inten") > F.col("quiet")) & F.col("covered").isNull() & F.col("voiced")
    found = series.runs(marked, ["clip_id"], ["frame_i"], flag, [
        F.min("frame_i").alias("i"), F.max("frame_i").alias("j"), F.avg("inten").alias("level"), F.when(F.count("f0_st") > 3, F.stddev_pop("f0_st")).otherwise(9.0).alias("f0sd"),
        F.avg(F.col("voiced").cast("double")).alias("voiced"), F.coalesce(F.min_by("left", "frame_i"), F.lit(0.0)).alias("ctx_left"),
        F.coalesce(F.max_by("right", "frame_i"), F.lit(0.0)).alias("ctx_right"), F.sort_array(F.collect_list(F.struct("frame_i", "step"))).alias("steps"), F.avg("hf").alias("high"),
    ])
    inner = F.filter(F.slice(F.col("steps.step"), 2, F.greatest(F.lit(1), F.size("steps"))), lambda x: x.isNotNull())
    mean = F.aggregate(inner, F.lit(0.0), lambda a, x: a + x) / F.size(inner)
    found = found.withColumn("len", (F.col("j") - F.col("i") + 1) * STEP).filter(F.col("len") >= least_s - 1e-9)
    found = found.withColumns({"start_s": F.col("i") * STEP, "end_s": (F.col("j") + 1) * STEP, "flux": F.when((F.col("len") > 0.05) & (F.size(inner) > 0), mean).otherwise(0.0)})
    edges = said.select("clip_id", F.col("start_s").alias("t")).unionByName(said.select("clip_id", F.col("end_s").alias("t")))
    found = nearest_edge(nearest_edge(found, edges, "start_s", "a"), edges, "end_s", "b")
    return found.withColumn("d_edge", F.coalesce(F.least("a", "b"), F.col("start_s"))).select("clip_id", "start_s", "end_s", *INSERTION_FEATURES)


def hums(words: DataFrame, frames: DataFrame, clips: DataFrame, heard: DataFrame, prompted: DataFrame, classifier: Classifier | None, th: Mapping[str, float]) -> DataFrame:
    """Unexplained voiced stretches that the classifier takes for fillers (without one each has probability one half)."""
    told = unexplained(frames, heard, prompted).withColumn("p", classifier.probability() if classifier else F.lit(0.5)).join(clips, "clip_id")
    told = told.filter((F.col("p") >= th["ins_p"]) & (F.col("start_s") > 0.3) & (F.col("end_s") < F.col("duration_s") - 0.3)).withColumn("d", F.col("end_s") - F.col("start_s"))
    return regions(word_before(told, words), "FILLER", heard=F.lit("voiced hum / drawl"), p=F.round("p", 2))


def held_vowels(words: DataFrame, frames: DataFrame, clips: DataFrame, norms: Norms, th: Mapping[str, float]) -> DataFrame:
    """Flat voiced stretches that no word's own vowel explains, beside a word's edge or a long silence.

    A word explains at most a share of its expected duration over all
    stretches, earlier ones first: what it explains of one is the difference
    of two running sums cut at that share.
    """
    flat = series.flat_stretches(frames, th["flat_range"], th["flat_min_s"]).join(clips, "clip_id")
    flat = flat.filter((F.col("level_sd") <= th["flat_istd"]) & (F.col("start_s") >= 0.3) & (F.col("end_s") <= F.col("duration_s") - 0.3)).drop("duration_s")
    can = duration_residuals(words, norms).filter("heard").select("clip_id", "i", "start_s", "end_s", (th["flat_mult"] * F.col("expected_s") + 0.05).alias("most"))
    met = intervals.overlap_join(flat, can, ["clip_id"], 0.5).withColumn("shared", F.least("end_s", "r_end_s") - F.greatest("start_s", "r_start_s"))
    so_far = Window.partitionBy("clip_id", "r_i").orderBy("start_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = met.withColumn("total", F.sum("shared").over(so_far)).withColumn("use", F.least("total", "r_most") - F.least(F.col("total") - F.col("shared"), F.col("r_most")))
    used = met.groupBy("clip_id", "start_s").agg(F.sum("use").alias("explained"))
    left = flat.join(used, ["clip_id", "start_s"], "left").filter(F.col("end_s") - F.col("start_s") - F.coalesce("explained", F.lit(0.0)) >= th["flat_unexpl"])
    big = series.silences(frames.withColumn("role", F.lit("par")), least_s=0.1).filter("end_s - start_s >= 0.3")
    edges = None
    for df in (words.filter("heard"), big):
        for c in ("start_s", "end_s"):
            some = df.select("clip_id", F.col(c).alias("t"))
            edges = some if edges is None else edges.unionByName(some)
    near = nearest_edge(nearest_edge(left, edges, "start_s", "a"), edges, "end_s", "b").filter("a <= 0.08 or b <= 0.08").withColumn("d", F.col("end_s") - F.col("start_s"))
    return regions(word_before(near.select("clip_id", "start_s", "end_s", "d"), words), "FILLER", heard=F.lit("held vowel"), kind=F.lit("hesitation sound or drawn-out word"))


def fillers(c: Clips, th: Mapping[str, float]) -> DataFrame:
    """Said fillers and hums, and held vowels that do not overlap one of these by more than 50 ms."""
    base = said_fillers(c.prompted, th).unionByName(hums(c.words, c.frames, c.clips, c.heard, c.prompted, c.insertions, th))
    flat = held_vowels(c.words, c.frames, c.clips, c.norms, th)
    met = intervals.overlap_join(flat.select("clip_id", "start_s", "end_s"), base.select("clip_id", "start_s", "end_s"), ["clip_id"], 0.5)
    known = met.filter(F.least("end_s", "r_end_s") - F.greatest("start_s", "r_start_s") > 0.05).select("clip_id", "start_s", "end_s").distinct()
    return base.unionByName(flat.join(known, ["clip_id", "start_s", "end_s"], "left_anti"))


# ---------------------------------------------------------------- all together

#: Each producer with the flaws it makes; only those that are wanted are planned.
PRODUCERS = {
    ("PAUSE_BAD", "PAUSE_LOST"): lambda c, th: pauses(c.words, c.frames, c.clips, c.norms, th),
    ("PACE_FAST", "PACE_SLOW"): lambda c, th: pace(c.words, c.norms, th),
    ("MONOTONE",): lambda c, th: monotone(c.words, c.frames, th),
    ("UPTALK",): lambda c, th: uptalk(c.words, c.frames, c.norms, th),
    ("FADE",): lambda c, th: fade(c.words, c.frames, c.norms, th),
    ("SHOUT",): lambda c, th: shout(c.words, c.frames, th),
    ("SLUR",): lambda c, th: slur(c.words, c.frames, th),
    ("FILLER",): fillers,
    ("REPEAT",): lambda c, th: repeated(c.words, c.inserted, th),
    ("WORD_SKIP",): lambda c, th: skipped(c.words, th),
    ("WORD_SWAP",): lambda c, th: swapped(c.words, th),
}


def detected(c: Clips, thresholds: Mapping[str, float] | None = None, flaws: tuple[str, ...] | None = None) -> DataFrame:
    """The detections of all or the wanted ``flaws``, each once."""
    th = {**DEFAULTS, **{k: v for k, v in (thresholds or {}).items() if k in DEFAULTS}}
    wanted = set(CATEGORY if flaws is None else flaws)
    found = c.words.sparkSession.createDataFrame([], FOUND)
    for makes, producer in PRODUCERS.items():
        if wanted & set(makes):
            found = found.unionByName(producer(c, th))
    once = Window.partitionBy("clip_id", "flaw", F.round("start_s", 3), F.round("end_s", 3)).orderBy("w0", "w1", "d")
    return found.filter(F.col("flaw").isin(*wanted)).withColumn("_k", F.row_number().over(once)).filter("_k = 1").drop("_k")


def usable(found: DataFrame, clips: DataFrame, disabled: tuple[str, ...] = (), least_s: float = 10.0, text_given: bool = True) -> DataFrame:
    """Detections without disabled flaws, without text checks where no text was given, and of short clips without those against the clip itself."""
    kept = found.filter(~F.col("flaw").isin(*disabled)) if disabled else found
    kept = kept if text_given else kept.filter(~F.col("flaw").isin(*NEEDS_TEXT))
    long = clips.filter(F.col("duration_s") >= least_s).select("clip_id", F.lit(True).alias("_long"))
    told = kept.join(long, "clip_id", "left")
    return told.filter(F.col("_long") | ~F.col("flaw").isin(*SELF_NORMALISED)).drop("_long")
