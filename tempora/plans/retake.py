"""Retakes: measures of one phrase, the range a speaker's clean phrases lead to expect, points after a retake."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from tempora.functions.text import FILLERS, syllables
from tempora.operators import series


def outside(value: Column, low: Column, high: Column) -> Column:
    """The distance of a value from a range."""
    return F.greatest(F.lit(0.0), low - value, value - high)


def phrase_measures(words: DataFrame, frames: DataFrame, step_s: float = 0.01, pause_s: float = 0.3) -> DataFrame:
    """Per clip of one phrase: syllables a second without long silences, longest inner and the last silence, fall of level, high band, pitch range, fillers.

    ``words(clip_id, w)``; ``frames(clip_id, frame_i, inten, hf, f0_st, voiced)``.
    """
    top = frames.groupBy("clip_id").agg((F.percentile("inten", F.lit(0.95)) - 28).alias("floor"), F.max("frame_i").alias("last"), F.count(F.lit(1)).alias("n"))
    marked = frames.join(top, "clip_id").withColumn("active", F.col("inten") > F.col("floor"))
    quiet = series.runs(marked, ["clip_id"], ["frame_i"], ~F.col("active"), [F.min("frame_i").alias("i"), F.max("frame_i").alias("j"), F.max("last").alias("last")])
    quiet = quiet.withColumn("long_s", (F.col("j") - F.col("i") + 1) * step_s)
    silent = quiet.groupBy("clip_id").agg(
        F.sum(F.when(F.col("long_s") > pause_s, F.col("long_s")).otherwise(0.0)).alias("silent_s"),
        F.max(F.when((F.col("i") > 0) & (F.col("j") < F.col("last")), F.col("long_s"))).alias("pause_in"), F.max(F.when(F.col("j") == F.col("last"), F.col("long_s"))).alias("pause_end"),
    )
    third = F.floor(3 * F.col("frame_i") / F.col("n"))
    heard = marked.groupBy("clip_id").agg(
        (F.count(F.lit(1)) * step_s).alias("whole_s"), F.median(F.when(F.col("active"), F.col("hf"))).alias("hf"),
        (F.percentile(F.when(third == 0, F.col("inten")), F.lit(0.8)) - F.percentile(F.when(third >= 2, F.col("inten")), F.lit(0.8))).alias("fade"),
        F.when(F.count(F.when(F.col("voiced"), 1)) > 20, F.percentile(F.when(F.col("voiced"), F.col("f0_st")), F.lit(0.75)) - F.percentile(F.when(F.col("voiced"), F.col("f0_st")), F.lit(0.25))).alias("pitch"),
    )
    said = words.groupBy("clip_id").agg(F.sum(syllables(F.col("w"))).alias("syllables"), F.count_if(F.lower("w").isin(FILLERS)).alias("fillers"))
    told = heard.join(silent, "clip_id", "left").join(said, "clip_id", "left").fillna({"silent_s": 0.0, "pause_in": 0.0, "pause_end": 0.0, "syllables": 0, "fillers": 0})
    return told.withColumn("rate", F.when(F.col("whole_s") > F.col("silent_s"), F.col("syllables") / (F.col("whole_s") - F.col("silent_s")))).drop("whole_s", "silent_s")


def clean_windows(words: DataFrame, size: int = 8) -> DataFrame:
    """Windows of ``size`` words, one after the other, none with a flagged word: ``words(clip_id, i, flagged)``."""
    found = series.sessions(words, ["clip_id"], ["i"], F.coalesce(F.col("flagged") | F.lag("flagged").over(Window.partitionBy("clip_id").orderBy("i")), F.lit(False)))
    place = F.row_number().over(Window.partitionBy("clip_id", "session").orderBy("i")) - 1
    numbered = found.filter("not flagged").withColumn("window", F.floor(place / size))
    return numbered.groupBy("clip_id", "session", "window").agg(F.min("i").alias("w0"), F.max("i").alias("w1"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == size).drop("n")


def expected(measures: DataFrame, value: str, low: float = 0.85, high: float = 1.20) -> DataFrame:
    """Per clip the range round the median of its clean windows' ``value``."""
    return measures.groupBy("clip_id").agg((F.median(value) * low).alias("low"), (F.median(value) * high).alias("high"))


def points_after(regions: DataFrame) -> DataFrame:
    """``regions(points_lost, first, again, low, high)`` with the points that stay lost: in proportion to how far the retake still is outside."""
    was, now = outside(F.col("first"), F.col("low"), F.col("high")), outside(F.col("again"), F.col("low"), F.col("high"))
    left = F.when(was > 0, F.least(F.lit(1.0), now / was)).otherwise(F.when(now > 0, 1.0).otherwise(0.0))
    return regions.withColumn("points_after", F.round(F.col("points_lost") * left, 2))


# A sentence for each flaw; the number is d, the text the words concerned.
SENTENCES = {
    "PACE_FAST": "You speed up to %.2f times the usual pace at “%s”.", "PACE_SLOW": "You slow down by a factor of %.2f at “%s”.", "PAUSE_BAD": "A pause of %.1f s breaks “%s”.",
    "PAUSE_LOST": "A pause is %.1f s too short after “%s”.", "MONOTONE": "Your pitch moves %.1f semitones less than usual in “%s”.", "UPTALK": "Your pitch rises by %.1f semitones at the end of “%s”.",
    "EMPH_FLAT": "The stress that is missing amounts to %.1f in “%s”.", "FADE": "Your voice drops by %.1f dB at the end of “%s”.", "SHOUT": "You are %.1f dB louder than usual in “%s”.",
    "SLUR": "Consonants are %.1f dB weaker than usual in “%s”.", "FILLER": "A filler of %.1f s stands at “%s”.", "REPEAT": "A repeat of %.1f s stands at “%s”.",
    "RARE_HESIT": "You hesitate for %.1f s before “%s”.", "WORD_SKIP": "%.0f words are missing at “%s”.", "WORD_SWAP": "Another word stands for (%.2f) “%s”.",
}


#: What to do about each flaw.
TIPS = {
    "PACE_FAST": "Give the words that carry the point more time.", "PACE_SLOW": "Read a phrase through in one go once it has begun.", "PAUSE_BAD": "Pause where the text has a stop, not between a word and its phrase.",
    "PAUSE_LOST": "Stop after a sentence before the next one begins.", "MONOTONE": "Choose a few words of each sentence and raise your pitch on them.", "UPTALK": "Let statements end low; keep rises for questions.",
    "EMPH_FLAT": "Make the words that matter longer, louder and higher.", "FADE": "Take a breath at clauses, so that the last words have as much voice as the first.", "SHOUT": "Keep your level even and stress words by pitch and time.",
    "SLUR": "Finish your consonants, at the ends of words most of all.", "FILLER": "Breathe in silence where you would fill a gap.", "REPEAT": "Practise how the phrase begins until it comes at once.",
    "RARE_HESIT": "Say the hard word by itself a few times first.", "WORD_SKIP": "Read the line slowly and check every word.", "WORD_SWAP": "Look at the exact wording again.",
}


def explained(regions: DataFrame) -> DataFrame:
    """``regions(flaw, d, words_text)`` with a sentence each."""
    told = F.lit(None).cast("string")
    for flaw, pattern in SENTENCES.items():
        told = F.when(F.col("flaw") == flaw, F.format_string(pattern, F.col("d"), F.col("words_text"))).otherwise(told)
    return regions.withColumn("explanation", told)


def summary(regions: DataFrame, areas: DataFrame) -> DataFrame:
    """One sentence for each clip: how many regions, the costliest, the weakest area (of equal ones the last name)."""
    worst = regions.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("flaw", F.struct("points_lost", "flaw")).alias("costliest"))
    weakest = areas.groupBy("clip_id").agg(F.max_by("category", F.struct(-F.col("area_score"), "category")).alias("weakest"))
    both = weakest.join(worst, "clip_id", "left").fillna({"n": 0})
    text = F.when(F.col("n") == 0, "Nothing was flagged.").otherwise(F.format_string("%d flagged; most costly: %s; weakest area: %s.", F.col("n"), F.col("costliest"), F.col("weakest")))
    return both.select("clip_id", "n", text.alias("summary"))


# What is measured for a flaw, how it is called and in what.
MEASURES = {
    "PACE_FAST": ("rate", "Speaking rate", "syllables per second"), "PACE_SLOW": ("rate", "Speaking rate", "syllables per second"), "PAUSE_BAD": ("pause_in", "Longest pause inside the phrase", "seconds"),
    "PAUSE_LOST": ("pause_end", "Pause after the last word", "seconds"), "FADE": ("fade", "Drop in loudness from start to end", "dB"), "SHOUT": ("spread", "Loudest part above the typical level", "dB"),
    "SLUR": ("slur", "Consonant brightness", "dB"), "MONOTONE": ("pitch", "Pitch range", "semitones"), "FILLER": ("fillers", "Filler sounds heard", "count"), "RARE_HESIT": ("fillers", "Filler sounds heard", "count"),
    "REPEAT": ("words", "Words matching the text", "share"), "WORD_SKIP": ("words", "Words matching the text", "share"), "WORD_SWAP": ("words", "Words matching the text", "share"),
}


def phrase_of(regions: DataFrame, words: DataFrame) -> DataFrame:
    """``regions(clip_id, rid, flaw, w0, w1)`` that can be said again, with the phrase ``a`` to ``b`` to read, its text, times and what is measured.

    A lost pause or a fade needs the five words before it; others three on both
    sides, 25 words at most.
    """
    last = words.groupBy("clip_id").agg(F.max("i").alias("last_i"))
    end = F.col("flaw").isin("PAUSE_LOST", "FADE")
    a, b = F.greatest(F.lit(0), F.col("w0") - F.when(end, 5).otherwise(3)), F.least("last_i", F.col("w1") + F.when(end, 0).otherwise(3))
    table = F.create_map(*[x for f, (key, name, unit) in MEASURES.items() for x in (F.lit(f), F.struct(F.lit(key).alias("key"), F.lit(name).alias("name"), F.lit(unit).alias("unit")))])
    told = regions.filter(F.col("flaw").isin(*MEASURES)).join(last, "clip_id").withColumn("a", a).withColumn("b", F.when(end, b).otherwise(F.least(b, a + 24)))
    told = told.withColumns({"measure": F.try_element_at(table, F.col("flaw")), "r0": F.greatest(F.lit(0), F.col("w0") - F.col("a")), "r1": F.least("b", "w1") - F.col("a")})
    spoken = told.select("clip_id", "rid", F.explode(F.sequence("a", "b")).alias("i")).join(words.select("clip_id", "i", "w", "start_s", "end_s"), ["clip_id", "i"])
    phrases = spoken.groupBy("clip_id", "rid").agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.when(F.col("w").rlike("[A-Za-z]"), F.struct("i", "w")))), lambda x: x["w"])).alias("text"),
        F.min_by("start_s", "i").alias("from_s"), F.max_by("end_s", "i").alias("to_s"),
    )
    return told.drop("last_i").join(phrases, ["clip_id", "rid"])


def first_pause(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Phrases with ``first``: the pause after their last word in the recording (a second after the last word of all)."""
    after = words.select("clip_id", (F.col("i") - 1).alias("b"), F.col("start_s").alias("next_s"))
    told = phrases.join(after, ["clip_id", "b"], "left")
    return told.withColumn("first", F.greatest(F.lit(0.0), F.coalesce(F.col("next_s"), F.col("to_s") + 1.0) - F.col("to_s"))).drop("next_s")


def expected_range(values: DataFrame, key: str) -> DataFrame:
    """``(clip_id, low, high)`` of a measure from the clip's clean windows ``values(clip_id, v)``; an open end is null.

    At most the first 14 windows of a clip are to be given, as its own usual.
    """
    v = lambda p: F.percentile("v", F.lit(p))
    none, n = F.lit(None).cast("double"), F.count("v")
    bounds = {
        "rate": (0.85 * F.coalesce(F.median("v"), F.lit(4.0)), 1.20 * F.coalesce(F.median("v"), F.lit(4.0))),
        "pause_in": (F.lit(0.0), F.greatest(F.lit(0.30), F.coalesce(v(0.9), F.lit(0.0)))),
        "pause_end": (F.lit(0.4), none),
        "fade": (none, F.when(n > 0, F.greatest(F.lit(5.5), F.least(F.lit(7.0), v(0.9) + 1.0))).otherwise(6.0)),
        "spread": (none, F.lit(5.0)),
        "slur": (v(0.25) - 1.5, none),
        "pitch": (F.coalesce(0.8 * F.median("v"), F.lit(0.0)), none),
        "fillers": (F.lit(0.0), F.lit(0.0)),
        "words": (F.lit(0.85), F.lit(1.0)),
    }
    low, high = bounds[key]
    return values.groupBy("clip_id").agg(low.cast("double").alias("low"), high.cast("double").alias("high"))


def first_windows(windows: DataFrame, most: int = 14) -> DataFrame:
    """The first ``most`` clean windows of each clip: ``windows(clip_id, w0)``."""
    return windows.withColumn("_k", F.row_number().over(Window.partitionBy("clip_id").orderBy("w0"))).filter(F.col("_k") <= most).drop("_k")


def word_level(words: DataFrame, levels: DataFrame) -> DataFrame:
    """Per phrase ``(clip_id, rid)``: mean level of its flagged words over the median of three others or more, else null.

    ``words(clip_id, rid, i, flagged, start_s, end_s)`` in the recording's own
    time, ``levels(clip_id, rid, frame_i, level)``.
    """
    first = F.floor(F.col("start_s") / 0.01).cast("long")
    last = F.greatest(first + 1, F.floor(F.col("end_s") / 0.01).cast("long")) - 1
    spread = words.filter("end_s > start_s").withColumn("frame_i", F.explode(F.sequence(first, last)))
    of_word = spread.join(levels.withColumn("frame_i", F.col("frame_i").cast("long")), ["clip_id", "rid", "frame_i"]).groupBy("clip_id", "rid", "i", "flagged").agg(F.avg("level").alias("v"))
    inside, rest = F.avg(F.when(F.col("flagged"), F.col("v"))), F.when(~F.col("flagged"), F.col("v"))
    return of_word.groupBy("clip_id", "rid").agg(F.when(F.count(rest) >= 3, inside - F.median(rest)).alias("spread"))


def words_said(aligned: DataFrame, texts: DataFrame, least: float = 0.8) -> DataFrame:
    """Per clip the share of the text's words that were heard as such: ``aligned(clip_id, ref_i, hyp_j, sim)``, ``texts(clip_id, n)``."""
    good = aligned.filter("ref_i is not null and hyp_j is not null").filter(F.col("sim") >= least).groupBy("clip_id").count()
    return texts.join(good, "clip_id", "left").select("clip_id", (F.coalesce("count", F.lit(0)) / F.greatest("n", F.lit(1))).alias("words"))
