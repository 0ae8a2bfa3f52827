"""Where each flaw of a benchmark goes: spots with weights, reserved in a weighted order, and their labels.

``words(take_id, i, w, clean, punct, start_s, end_s, pos, tag, lemma, content,
function, reducible, btype, zipf)`` are a take's words with their parts of
speech, ``zipf`` how common a word is; ``zones(take_id, zone_start, zone_end)``;
``frames(clip_id, frame_i, f0_st, inten, hf, voiced)`` with the take as clip;
``prominence(take_id, i, prominence)``.

A rule gives ``SPOT`` rows: the span, the words, the weight or score by which
spots are tried, and the stretch that has to be free.  Trying is in a hashed
order, so levels of a flaw share their spots.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from tempora.operators import detect
from tempora.operators.compare import OPENERS
from tempora.plans import catalog, placement
from tempora.plans.placement import one_of

SPOT = ("take_id", "flaw", "start_s", "end_s", "w0", "w1", "weight", "claim_start", "claim_end", "why")
# Stretches of seconds that a flaw takes, how natural a hesitation is at a boundary, and what is skipped or restarted most.
LENGTHS = {"PACE_FAST": (1.0, 2.0), "PACE_SLOW": (0.7, 1.4), "MONOTONE": (3.0, 5.0), "EMPH_FLAT": (3.0, 5.0), "SHOUT": (1.0, 3.0), "SLUR": (1.5, 3.5)}
HESITATION = {"sentence": 6.0, "before_coord": 6.0, "before_subord": 5.0, "clause_punct": 4.0, "before_relative": 3.0, "after_discourse": 3.0, "phrase_loose": 0.2, "phrase_tight": 0.0}
SKIPPED = {"DET": 3.0, "ADP": 2.5, "AUX": 1.5, "CCONJ": 1.0, "PRON": 0.7, "PART": 1.0}
RESTARTED = ("DET", "PRON", "CCONJ", "ADP")
# What a label says of why a place was taken.
WHY = {
    "PACE_FAST": "rushing a list / long sentence",
    "PACE_SLOW": "dragging at a sentence opening / hard word",
    "MONOTONE": "flattened the most expressive stretch (F0 IQR %.1f st)",
    "SLUR": "slurred the crispest-articulated stretch (%.0f dB consonant energy)",
    "EMPH_FLAT": "flattened the focal words",
    "SHOUT": "sudden vocal effort from a phrase onset",
    "UPTALK": "rising end anchored at the last stressed vowel",
    "FADE": "trails off after %.1f s without a breath",
    "REPEAT": "false start at a clause opener",
    "RARE_HESIT": "hesitation before the rare word '%s'",
    "WORD_SKIP": "reader skips the %s '%s'",
    "WORD_SWAP": "misread '%s' as '%s' (%s)",
}
# How far apart two places of a flaw have to be.
MARGINS = {"FILLER": 0.4, "REPEAT": 0.3, "WORD_SKIP": 0.25, "WORD_SWAP": 0.25}


@dataclass(frozen=True)
class Takes:
    words: DataFrame
    zones: DataFrame
    frames: DataFrame
    prominence: DataFrame
    corpus: DataFrame | None = None  # (take_id, joined): takes whose full stops are joints of recordings


def _in_take() -> Window:
    return Window.partitionBy("take_id").orderBy("i")


def _why(flaw: str, *values: Column) -> Column:
    return F.format_string(WHY[flaw], *values) if values else F.lit(WHY[flaw])


def _spots(df: DataFrame, flaw: str, weight: Column, why: Column, before: float = 0.0, after: float = 0.0) -> DataFrame:
    told = df.withColumns({"flaw": F.lit(flaw), "weight": weight.cast("double"), "why": why})
    claim = {c: F.col(c) if c in df.columns else F.col(e) + s for c, e, s in (("claim_start", "start_s", -before), ("claim_end", "end_s", after))}
    return told.withColumns(claim).select(*SPOT)


def _boundaries(t: Takes) -> DataFrame:
    """Boundaries with the words on both sides, at the middle of the gap: ``b_*`` before, ``a_*`` after."""
    sides = lambda p, k: t.words.select("take_id", (F.col("i") + k).alias("k"), *[F.col(c).alias(f"{p}_{c}") for c in ("w", "clean", "punct", "start_s", "end_s", "content", "function", "reducible", "btype", "zipf")])
    both = placement.word_boundaries(t.words, t.zones).join(sides("b", 0), ["take_id", "k"]).join(sides("a", -1), ["take_id", "k"])
    middle = (F.col("t0") + F.col("t1")) / 2
    return both.withColumns({"start_s": middle, "end_s": middle, "w0": F.col("k"), "w1": F.col("k") + 1, "gap": F.col("t1") - F.col("t0")})


def _told(df: DataFrame) -> Column:
    strip = lambda c: F.regexp_replace(c, "^[,.;:!?]+|[,.;:!?]+$", "")
    return placement.described(F.col("b_btype"), strip("b_w"), strip("a_w"))


def _windows(t: Takes, flaw: str) -> DataFrame:
    """A flaw's windows; takes without any have somewhat shorter and longer ones, whatever stops they cross."""
    low, high = LENGTHS[flaw]
    usual = placement.word_windows(t.words, t.zones, low, high)
    others = placement.word_windows(t.words, t.zones, 0.7 * low, 1.3 * high, False).join(usual.select("take_id").distinct(), "take_id", "left_anti")
    return usual.unionByName(others).withColumnsRenamed({"i0": "w0", "i1": "w1"})


def _sentences(t: Takes) -> DataFrame:
    """``(take_id, sentence, s, e, lists)``: first and last word of each sentence, the clauses that end in it, and its number."""
    cut = detect.sentences(t.words.withColumnRenamed("take_id", "clip_id")).withColumnRenamed("clip_id", "take_id")
    closes = F.length("punct") > 0
    return cut.groupBy("take_id", "sentence").agg(F.min("i").alias("s"), F.max("i").alias("e"), (F.count_if(closes) - F.max_by(closes.cast("int"), "i")).alias("lists"), F.max_by("punct", "i").alias("stop"))


def _measured(t: Takes, windows: DataFrame, value: Column, name: str) -> DataFrame:
    spans = windows.withColumnRenamed("take_id", "clip_id")
    return detect.measured(spans, t.frames, "start_s", "end_s", ["w0", "w1"], value, name).withColumnRenamed("clip_id", "take_id")


# ---------------------------------------------------------------- rules


def pace(t: Takes, flaw: str) -> DataFrame:
    """Rushing in lists, long sentences and the last third; dragging at openings and before hard words."""
    windows, sentences = _windows(t, flaw), _sentences(t)
    of_word = t.words.join(sentences, "take_id").filter("i between s and e").select("take_id", F.col("i").alias("w0"), "s", "e")
    ends = t.words.groupBy("take_id").agg(F.max("end_s").alias("until"))
    inside = windows.withColumn("i", F.explode(F.sequence("w0", "w1"))).join(t.words.select("take_id", "i", "punct", "clean", "content", "zipf"), ["take_id", "i"])
    facts = inside.groupBy("take_id", "w0", "w1", "start_s", "end_s").agg(
        F.count_if((F.length("punct") > 0) & (F.col("i") < F.col("w1"))).alias("clauses"), F.max((F.length("clean") > 4) & F.col("content") & (F.col("zipf") < 3.5)).alias("hard")
    )
    told = facts.join(of_word, ["take_id", "w0"]).join(ends, "take_id")
    if flaw == "PACE_FAST":
        weight = 1.0 + F.when(F.col("clauses") >= 2, 1.5).otherwise(0) + F.when(F.col("e") - F.col("s") >= 14, 1.0).otherwise(0) + F.when(F.col("start_s") > 2 * F.col("until") / 3, 1.2).otherwise(0)
        return _spots(told, flaw, weight, _why(flaw))
    weight = 1.0 + F.when(F.col("w0") - F.col("s") <= 2, 2.0).otherwise(0) + F.when(F.coalesce("hard", F.lit(False)), 1.5).otherwise(0)
    return _spots(told, flaw, weight, _why(flaw))


def pause_bad(t: Takes, flaw: str) -> DataFrame:
    """Inside a tight phrase without a gap, most of all after a short word that can be drawn out, not near the take's end."""
    ends = t.words.groupBy("take_id").agg(F.max("end_s").alias("until"))
    at = _boundaries(t).join(ends, "take_id").filter("b_btype = 'phrase_tight' and b_punct = '' and a_punct = '' and gap < 0.08 and t1 < 0.8 * until")
    weight = F.when(F.col("b_reducible") & (F.length("b_clean") <= 3), 3.0).when(F.col("b_function"), 1.5).otherwise(0.8)
    drawn = F.when(F.col("b_reducible") & (F.length("b_clean") <= 4), F.col("b_start_s")).otherwise(F.col("start_s"))
    return _spots(at.withColumn("claim_start", drawn), flaw, weight, _told(at), after=1.2)


def pause_lost(t: Takes, flaw: str) -> DataFrame:
    """Long gaps at stops (commas only where full stops are joints), the longest most; what is reserved is the gap."""
    at = _boundaries(t)
    joined = t.corpus if t.corpus is not None else at.select("take_id").distinct().withColumn("joined", F.lit(False))
    at = at.join(joined, "take_id", "left").filter((F.col("b_btype") == "clause_punct") | ((F.col("b_btype") == "sentence") & ~F.coalesce("joined", F.lit(False)))).filter("gap > 0.17")
    return _spots(at.withColumns({"claim_start": F.col("t0"), "claim_end": F.col("t1")}), flaw, F.pow("gap", F.lit(2.0)), _told(at))


def monotone(t: Takes, flaw: str) -> DataFrame:
    """The stretches whose pitch moves most."""
    told = _measured(t, _windows(t, flaw), detect.quartile_range(), "v").filter("v is not null")
    return _spots(told, flaw, F.col("v"), _why(flaw, F.col("v")))


def slur(t: Takes, flaw: str) -> DataFrame:
    """The stretches whose consonants are strongest."""
    told = _measured(t, _windows(t, flaw), detect.top_share(), "v").filter("v is not null")
    return _spots(told, flaw, F.col("v"), _why(flaw, F.col("v")))


def flat_stress(t: Takes, flaw: str) -> DataFrame:
    """The stretches with the most prominent words that carry meaning."""
    windows = _windows(t, flaw).withColumnsRenamed({"w0": "i0", "w1": "i1"})
    best = placement.best_windows(windows, t.prominence, placement.focal_words(t.words)).withColumnsRenamed({"i0": "w0", "i1": "w1"})
    return _spots(best, flaw, F.col("score"), _why(flaw))


def shout(t: Takes, flaw: str) -> DataFrame:
    return _spots(_windows(t, flaw), flaw, F.lit(1.0), _why(flaw))


def _tails(t: Takes, tail_s: float, spare: int) -> DataFrame:
    """Sentences of six words or more in the zone with the start of their tail."""
    times = t.words.select("take_id", "i", "start_s", "end_s")
    told = _sentences(t).filter("e - s >= 5").join(times.select("take_id", F.col("i").alias("s"), F.col("start_s").alias("first_s")), ["take_id", "s"]).join(times.select("take_id", F.col("i").alias("e"), F.col("end_s").alias("last_s")), ["take_id", "e"])
    told = told.join(t.zones, "take_id").filter("first_s >= zone_start and last_s <= zone_end")
    late = times.join(told.select("take_id", "sentence", "s", "e", "last_s"), "take_id").filter((F.col("i") <= F.col("e")) & (F.col("i") >= F.col("s") + spare) & ((F.col("last_s") - F.col("start_s") < tail_s) | (F.col("i") == F.col("e"))))
    starts = late.groupBy("take_id", "sentence").agg(F.min("i").alias("w0"), F.min_by("start_s", "i").alias("start_s"))
    last = told.groupBy("take_id").agg(F.max("e").alias("last_e"))
    return told.join(starts, ["take_id", "sentence"]).join(last, "take_id").withColumns({"w1": F.col("e"), "end_s": F.col("last_s"), "final": F.col("e") == F.col("last_e")})


def uptalk(t: Takes, flaw: str) -> DataFrame:
    """Ends of statements, list items rather than openings and conclusions; three words at least."""
    told = _tails(t, 1.0, 2).filter("stop <> '?'")
    third = t.words.select("take_id", (F.col("i") + 2).alias("e"), F.col("start_s").alias("third_s"))
    told = told.join(third, ["take_id", "e"]).withColumns({"w0": F.least("w0", F.col("e") - 2), "start_s": F.least("start_s", "third_s")})
    weight = (1.0 + F.when(F.col("lists") >= 2, 0.6).otherwise(0)) * F.when(F.col("final"), 0.25).when(F.col("s") == 0, 0.6).otherwise(1.0)
    return _spots(told, flaw, weight, _why(flaw))


def fade(t: Takes, flaw: str) -> DataFrame:
    """Ends of sentences, the more the longer since the last real pause, and the take's last one; three seconds at most."""
    w = _in_take()
    paused = t.words.withColumn("breath", (F.col("start_s") - F.lag("end_s").over(w) > 0.25).cast("int"))
    since = paused.withColumn("from_s", F.last(F.when(F.coalesce("breath", F.lit(1)) == 1, F.col("start_s")), True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    told = _tails(t, 1.4, 2).join(since.select("take_id", F.col("i").alias("e"), "from_s"), ["take_id", "e"]).withColumn("breath_s", F.col("last_s") - F.greatest("from_s", "first_s")).filter("end_s - start_s <= 3.0")
    return _spots(told, flaw, 1.0 + F.col("breath_s") / 2.5 + F.when(F.col("final"), 2.0).otherwise(0.0), _why(flaw, F.col("breath_s")))


def filler(t: Takes, flaw: str) -> DataFrame:
    """Where people hesitate: at stops and openers, after a short function word, before a hard word."""
    at = _boundaries(t)
    tight = F.when(F.col("b_reducible") & (F.length("b_clean") <= 3), 0.25).otherwise(0.0)
    usual = F.when(F.col("b_btype") == "phrase_tight", tight).otherwise(one_of(HESITATION, F.col("b_btype"), F.lit(0.0)))
    hard = F.when(F.col("a_content") & (F.length("a_clean") > 5) & (F.col("a_zipf") < 4.2), 1.2).otherwise(0.0)
    return _spots(at, flaw, usual + hard, _told(at), after=1.0)


def repeat(t: Takes, flaw: str) -> DataFrame:
    """The function word that opens a clause, where four words without a stop follow."""
    w = _in_take()
    told = t.words.withColumns({"opens": F.lag("btype").over(w).isin(*OPENERS), "fourth_s": F.lead("end_s", 3).over(w), "stops": F.max(F.length("punct")).over(w.rowsBetween(0, 2))}).join(t.zones, "take_id")
    told = told.filter("opens and function and clean <> '' and stops = 0 and start_s >= zone_start and fourth_s <= zone_end")
    told = told.withColumns({"claim_end": F.col("fourth_s"), "end_s": F.col("start_s"), "w0": F.col("i"), "w1": F.col("i")})
    return _spots(told, flaw, F.when(F.col("pos").isin(*RESTARTED), 2.5).otherwise(1.5), _why(flaw))


def rare_hesitation(t: Takes, flaw: str) -> DataFrame:
    """Before rare words of five letters or more."""
    n = t.words.groupBy("take_id").agg(F.max("i").alias("last_i"))
    told = t.words.join(t.zones, "take_id").join(n, "take_id").filter("i >= 2 and i <= last_i - 2 and start_s >= zone_start and end_s <= zone_end and length(clean) > 4 and zipf < 3.5")
    return _spots(told.withColumns({"w0": F.col("i"), "w1": F.col("i")}), flaw, F.lit(1.0), _why(flaw, F.col("clean")), 0.3, 0.1)


def skipped_word(t: Takes, flaw: str) -> DataFrame:
    """Small function words, not the first or last of a sentence."""
    w = _in_take()
    n = t.words.groupBy("take_id").agg(F.max("i").alias("last_i"))
    told = t.words.withColumn("opens", F.lag("btype").over(w) == "sentence").join(t.zones, "take_id").join(n, "take_id")
    told = told.filter("i >= 2 and i <= last_i - 2 and start_s >= zone_start and end_s <= zone_end and punct = '' and not opens and length(clean) > 1 and end_s - start_s > 0.06").filter(F.col("pos").isin(*SKIPPED))
    return _spots(told.withColumns({"w0": F.col("i"), "w1": F.col("i")}), flaw, one_of(SKIPPED, F.col("pos")), _why(flaw, F.lower("pos"), F.col("clean")))


def swapped_word(t: Takes, flaw: str) -> DataFrame:
    """Content words that another word of the take looks like, or that has their part of speech and about their length."""
    w = t.words.withColumn("long", F.col("end_s") - F.col("start_s"))
    ask = w.filter("punct = '' and content and length(clean) > 2 and long > 0.12").join(t.zones, "take_id").filter("i >= 2 and end_s >= zone_start and end_s <= zone_end")
    donor = w.filter("punct = ''").select("take_id", F.col("i").alias("j"), F.col("clean").alias("other"), F.col("pos").alias("pos_j"), F.col("lemma").alias("lemma_j"), F.col("long").alias("long_j"))
    met = ask.join(donor, "take_id").filter((F.abs(F.col("i") - F.col("j")) > 3) & (F.col("clean") != F.col("other")))  # the words of one take
    apart = F.levenshtein("clean", "other")
    alike = (F.length("other") > 2) & (F.substring("clean", 1, 1) == F.substring("other", 1, 1)) & (F.abs(F.length("clean") - F.length("other")) <= 2) & (apart <= 2) & (F.col("long_j") / F.col("long")).between(0.6, 1.6)
    same = (F.col("pos") == F.col("pos_j")) & (F.col("lemma") != F.col("lemma_j")) & (F.col("long_j") / F.col("long")).between(0.8, 1.25)
    kind = F.when(alike, F.struct(F.lit(1).alias("k"), apart.alias("d"), F.col("j"), F.col("other"), F.lit("similar word").alias("kind"))).when(same, F.struct(F.lit(3).alias("k"), F.lit(0).alias("d"), F.col("j"), F.col("other"), F.lit("same pos").alias("kind")))
    best = met.withColumn("kind", kind).filter("kind is not null").groupBy("take_id", "i", "clean", "start_s", "end_s").agg(F.min("kind").alias("best"))
    told = best.withColumns({"w0": F.col("i"), "w1": F.col("i")})
    return _spots(told, flaw, F.lit(1.0), _why(flaw, F.col("clean"), F.col("best.other"), F.col("best.kind")))


RULES: dict[str, Callable[[Takes, str], DataFrame]] = {
    "PACE_FAST": pace, "PACE_SLOW": pace, "PAUSE_BAD": pause_bad, "PAUSE_LOST": pause_lost, "MONOTONE": monotone, "UPTALK": uptalk, "EMPH_FLAT": flat_stress, "FADE": fade, "SHOUT": shout,
    "FILLER": filler, "REPEAT": repeat, "RARE_HESIT": rare_hesitation, "SLUR": slur, "WORD_SKIP": skipped_word, "WORD_SWAP": swapped_word,
}
#: By how much the order of flaws that go by a score, not by weights, is shaken.
SHAKEN = {"MONOTONE": 0.4, "EMPH_FLAT": 0.5, "SLUR": 1.5}


def spots_of(t: Takes, flaw: str) -> DataFrame:
    return RULES[flaw](t, flaw)


def placed(t: Takes, flaw: str, n: int | None = None, seed: int = 0) -> DataFrame:
    """A take's places of a flaw in order of time: ``n`` of them, or a number from 1 to 3 by the take's hash."""
    unit = (F.pmod(F.xxhash64(F.lit(seed), F.lit(flaw), "take_id", "w0", "w1"), F.lit(1 << 20)) + 1) / ((1 << 20) + 1)
    key = F.col("weight") + SHAKEN[flaw] * unit if flaw in SHAKEN else catalog.weighted_order(unit, F.col("weight"))
    keyed = spots_of(t, flaw).withColumn("_key", key).filter("_key is not null")
    asked = keyed.withColumnsRenamed({"start_s": "s", "end_s": "e"}).withColumnsRenamed({"claim_start": "start_s", "claim_end": "end_s"})
    many = placement.region_count(F.lit(seed), F.col("take_id"), F.lit(flaw)) if n is None else n
    kept = placement.claimed(asked, [F.desc("_key"), F.asc("w0"), F.asc("w1")], many, MARGINS.get(flaw, 0.2))
    return kept.select("take_id", "flaw", F.col("s").alias("start_s"), F.col("e").alias("end_s"), "w0", "w1", "weight", "why")


def labelled(places: DataFrame, level: int) -> DataFrame:
    """Places with their area, level, what the level does and whether sound is put in, taken out or changed."""
    kind = F.when(F.col("flaw").isin("PAUSE_BAD", "FILLER", "REPEAT"), "insert").when(F.col("flaw").isin("PAUSE_LOST", "WORD_SKIP"), "delete").otherwise("modify")
    told = placement.with_category(places).withColumns({"level": F.lit(level), "kind": kind, "value": placement.level_value(F.col("flaw"), F.lit(level))})
    return told.withColumnsRenamed({"w0": "word_start", "w1": "word_end"})
