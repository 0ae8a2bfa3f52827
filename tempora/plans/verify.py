"""Whether injected flaws did what they say: times carried through edits, before and after measures, and tests of their dose."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from tempora.operators import intervals, spectral
from tempora.operators.sound import TINY, level
from tempora.plans import evaluate

# ---------------------------------------------------------------- times through edits


def edit_map(edits: DataFrame) -> DataFrame:
    """``edits(clip_id, a, b, n)`` (old stretch a to b replaced by a new one of length n) with ``new_a`` and ``new_b``: where the new stretch lies."""
    before = Window.partitionBy("clip_id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.col("n") - (F.col("b") - F.col("a"))).over(before), F.lit(0))
    return edits.withColumn("new_a", F.col("a") + moved).withColumn("new_b", F.col("new_a") + F.col("n"))


def _carried(points: DataFrame, mapped: DataFrame, at: str, to: str, own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """Times before the first edit stay, those inside one are stretched with it, and later ones move with its end."""
    starts = mapped.select("clip_id", F.col(own[0]).alias(at), F.col(own[1]).alias("own_b"), F.col(other[0]).alias("other_a"), F.col(other[1]).alias("other_b"))
    met = intervals.asof_before(points, starts, ["clip_id"], at, ["own_b", "other_a", "other_b"])
    own_a, own_b, other_a, other_b = (F.col(f"r_{c}") for c in (at, "own_b", "other_a", "other_b"))
    inside = other_a + (F.col(at) - own_a) * (other_b - other_a) / (own_b - own_a)
    told = F.when(own_a.isNull(), F.col(at)).when((F.col(at) < own_b) & (own_b > own_a), inside).otherwise(other_b + (F.col(at) - own_b))
    return met.withColumn(to, told.cast("double")).drop(f"r_{at}", "r_own_b", "r_other_a", "r_other_b")


def to_new(points: DataFrame, edits: DataFrame, at: str = "t", to: str = "new_t") -> DataFrame:
    """``points(clip_id, ..)`` with where their old times are after the edits, which do not overlap; a removed stretch is where it was cut."""
    return _carried(points, edit_map(edits), at, to, ("a", "b"), ("new_a", "new_b"))


def to_old(points: DataFrame, edits: DataFrame, at: str = "t", to: str = "old_t") -> DataFrame:
    """``to_new`` the other way; an inserted stretch comes from where it was put in, and a cut from the end of what was removed there."""
    return _carried(points, edit_map(edits), at, to, ("new_a", "new_b"), ("a", "b"))


# ---------------------------------------------------------------- measures of a flaw

# How a flaw's values of one recording are put together (others: mean), and what is measured.
SUMMED = ("FILLER", "WORD_SKIP", "WORD_SWAP")
UNITS = {
    "PACE_FAST": "speed ratio", "PACE_SLOW": "speed ratio", "PAUSE_BAD": "inserted s", "FILLER": "inserted s", "REPEAT": "inserted s", "PAUSE_LOST": "removed s", "RARE_HESIT": "added s",
    "WORD_SKIP": "removed s", "WORD_SWAP": "words swapped", "MONOTONE": "pitch range lost st", "UPTALK": "final rise added st", "EMPH_FLAT": "pitch peak lost st",
    "FADE": "end level drop dB", "SHOUT": "level gain dB", "SLUR": "band loss dB",
}
SLUR_BAND, FADE_S, RISE_FRAMES = (2000.0, 8000.0), 0.3, 10


def timed_measures(regions: DataFrame) -> DataFrame:
    """``regions`` with ``value``: what the flaws of time did, by the times alone; null for flaws of sound."""
    new, old = F.col("end_s") - F.col("start_s"), F.col("baseline_end_s") - F.col("baseline_start_s")
    flaw = F.col("flaw")
    value = (
        F.when(flaw.isin("PACE_FAST", "PACE_SLOW"), old / F.greatest(new, F.lit(1e-6))).when(flaw.isin("PAUSE_BAD", "FILLER", "REPEAT"), new)
        .when(flaw == "PAUSE_LOST", old - new).when(flaw == "RARE_HESIT", new - old).when(flaw == "WORD_SKIP", old).when(flaw == "WORD_SWAP", 1.0)
    )
    return regions.withColumn("value", value)


def _voiced(x: np.ndarray, sr: int) -> np.ndarray:
    """Semitones of the voiced frames of a stretch."""
    _, hz = spectral.pitch_track(x, sr, spectral.FLOOR_HZ, spectral.CEILING_HZ, 0.005)
    return 12 * np.log2(hz[hz > 0]) if (hz > 0).sum() > 5 else np.empty(0)


def band_level(x: np.ndarray, sr: int, low: float, high: float, size: int = 512) -> float:
    """Mean level in dB of a band over half-overlapping frames."""
    cut = np.lib.stride_tricks.sliding_window_view(np.pad(x, (0, max(0, size - len(x)))), size)[:: size // 2]
    hz = np.fft.rfftfreq(size, 1 / sr)
    power = np.abs(np.fft.rfft(cut * np.hanning(size), axis=1)[:, (hz >= low) & (hz <= high)]) ** 2
    return float(10 * np.log10(power.mean() + TINY)) if power.size else -120.0


def _spread(st: np.ndarray) -> float:
    return float(np.subtract(*np.percentile(st, [75, 25]))) if len(st) else np.nan


#: What a flaw of sound took or added, of a stretch before and after.
OF_SOUND = {
    "MONOTONE": lambda old, new, sr: _spread(_voiced(old, sr)) - _spread(_voiced(new, sr)),
    "UPTALK": lambda old, new, sr: float(np.median(b[-RISE_FRAMES:]) - np.median(a[-RISE_FRAMES:])) if len(a := _voiced(old, sr)) and len(b := _voiced(new, sr)) else np.nan,
    "EMPH_FLAT": lambda old, new, sr: float((a.max() - a.mean()) - (b.max() - b.mean())) if len(a := _voiced(old, sr)) and len(b := _voiced(new, sr)) else np.nan,
    "FADE": lambda old, new, sr: level(old[-int(FADE_S * sr) :]) - level(new[-int(FADE_S * sr) :]),
    "SHOUT": lambda old, new, sr: level(new) - level(old),
    "SLUR": lambda old, new, sr: band_level(old, sr, *SLUR_BAND) - band_level(new, sr, *SLUR_BAND),
}


def measures(regions: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``(clip_id, rid, flaw, level, value, unit)`` of every region, by its times or by ``before`` and ``after(clip_id, sr, samples)``.

    Regions whose stretch has too little voice to measure have no value.
    """
    timed = timed_measures(regions)
    of_sound = timed.filter(F.col("flaw").isin(*OF_SOUND)).groupBy("clip_id").agg(F.collect_list(F.struct("rid", "flaw", "level", "start_s", "end_s", "baseline_start_s", "baseline_end_s")).alias("regions"))  # a clip's regions
    both = of_sound.join(before.select("clip_id", F.col("samples").alias("before"), "sr"), "clip_id").join(after.select("clip_id", "samples"), "clip_id")
    schema = f"clip_id {regions.schema['clip_id'].dataType.simpleString()}, rid {regions.schema['rid'].dataType.simpleString()}, flaw string, level {regions.schema['level'].dataType.simpleString()}, value double"

    def measure(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                sr, old, new = int(row.sr), np.asarray(row.before, float), np.asarray(row.samples, float)
                cut = lambda x, a, b, sr=sr: x[int(round(a * sr)) : int(round(b * sr))]
                told = [(row.clip_id, r["rid"], r["flaw"], r["level"], OF_SOUND[r["flaw"]](cut(old, r["baseline_start_s"], r["baseline_end_s"]), cut(new, r["start_s"], r["end_s"]), sr)) for r in row.regions]
                yield pd.DataFrame(told, columns=["clip_id", "rid", "flaw", "level", "value"])

    heard = both.mapInPandas(measure, schema).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    by_time = timed.filter(~F.col("flaw").isin(*OF_SOUND)).select("clip_id", "rid", "flaw", "level", "value")
    unit = F.element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), F.col("flaw"))
    return by_time.unionByName(heard).withColumn("unit", unit)


# ---------------------------------------------------------------- dose


def doses(told: DataFrame, keys: list[str], levels: range = range(1, 6)) -> DataFrame:
    """``(keys, L1.., spearman, monotonic, rises)`` of ``told(keys, flaw, level, value)``: whether a flaw's effect goes with its level.

    A level's effect is the sum or mean of its regions'.  ``monotonic`` is never
    turning back by more than a millionth over the levels that are there.  Ranks
    and steps are told from one evaluation of the effects.
    """
    flaw = F.col("flaw")
    effect = F.when(flaw.isin(*SUMMED), F.sum("value")).otherwise(F.avg("value"))
    of_level = told.filter(F.col("level").isin(*levels)).groupBy(*keys, "flaw", "level").agg(effect.alias("effect")).filter("effect is not null")
    group, one = [*keys, "flaw"], F.lit(1)
    step = F.col("effect") - F.lag("effect").over(Window.partitionBy(*group).orderBy("level"))
    ranked = of_level.select("*", step.alias("step"), evaluate.centred_rank(group, "level", one).alias("_xr"), evaluate.centred_rank(group, "effect", one).alias("_yr"))
    x, y = F.col("_xr"), F.col("_yr")
    spearman = evaluate.rank_correlation(F.count(one), F.sum(x * y), F.sum(x * x), F.sum(y * y), least=2)
    wide: list[Column] = [F.max(F.when(F.col("level") == k, F.col("effect"))).alias(f"L{k}") for k in levels]
    rises, falls = F.coalesce(F.min("step") >= -1e-6, F.lit(True)), F.coalesce(F.max("step") <= 1e-6, F.lit(True))
    return ranked.groupBy(*group).agg(*wide, spearman.alias("spearman"), (rises | falls).alias("monotonic"), rises.alias("rises"))
