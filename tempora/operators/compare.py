"""A recording against its reference: word times through the warping path, lag events, detectors.

The path maps reference frames to participant frames.  Its lag is read in two
ways: steep short stretches are events (something was put in or left out), the
lasting slope is tempo.  Events are taken out of the map before durations are
measured.  ``compared`` builds the table of words; the detectors take it with
the frames of both sides and return what those of ``detect`` return.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from tempora.operators import align, detect, intervals, series
from tempora.operators.detect import STEP, by_word, measured, regions, spread_words, word_runs

# Thresholds of the comparison where no fitted ones are given.
DEFAULTS = {
    "skip_min": 0.08, "skip_frac": 0.6, "pause_ins_min": 0.20, "pace_fast": 1.12, "pace_slow": 0.88, "pace_min_s": 1.2, "mono_ratio": 0.62, "mono_min_s": 2.4,
    "cost_ref": 0.03, "g_max": 5.0, "repeat_min": 0.14, "emph_min_words": 2, "swap_contrast": 0.12, "expand_emph": 1, "expand_slur": 0, "abs_pause": 0, "abs_lost": 0,
    "pause_abs": 0.7, "lost_frac": 0.35, "rare_min": 0.30, "uptalk_st": 1.5, "fade_db": 3.5, "shout_db": 3.0, "slur_db": 3.0, "emph_drop": 0.9,
}
# Thresholds that widen where the path as a whole is costly.
SCALED = ("swap_contrast", "emph_drop", "uptalk_st", "slur_db", "shout_db", "fade_db")
# Boundaries at which a repeat may open, and those that end a clause.
OPENERS = ("sentence", "clause_punct", "before_coord", "before_subord", "before_relative", "after_discourse")
CLAUSE_ENDS = ("sentence", "clause_punct", "before_coord", "before_subord", "before_relative")
# Flaws too unreliable to be told unasked.
EXPERIMENTAL = ("EMPH_FLAT", "REPEAT", "UPTALK", "RARE_HESIT")

REACH, HALF = 10, 75


@dataclass(frozen=True)
class Comparison:
    """The tables of some compared recordings.

    ``words`` from ``compared`` with ``btype`` and ``zipf_next`` (how common the
    next word is, null unless it is a long content word); ``events`` from
    ``placed_events``; frames of both sides; ``gains`` from ``gain``.
    """

    words: DataFrame
    events: DataFrame
    own: DataFrame
    reference: DataFrame
    gains: DataFrame


def gain(path: DataFrame, th: Mapping[str, float] = DEFAULTS) -> DataFrame:
    """``(clip_id, gain)``: by how much a clip's scaled thresholds grow with its path cost."""
    g = F.greatest(F.lit(1.0), F.least(F.lit(float(th["g_max"])), F.max("path_cost") / max(th["cost_ref"], 1e-3)))
    return path.groupBy("clip_id").agg(g.alias("gain"))


# ---------------------------------------------------------------- the map of times


def tempo_track(path: DataFrame, reach: int = REACH, half: int = HALF) -> DataFrame:
    """Of each reference frame: participant time, lag, slope of the lag, running median of it, cost."""
    w = Window.partitionBy("clip_id").orderBy("ref_frame")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    track = align.lag_track(path)
    ahead, behind = F.coalesce(F.lead("lag_s", reach).over(w), F.last("lag_s").over(whole)), F.coalesce(F.lag("lag_s", reach).over(w), F.first("lag_s").over(whole))
    sloped = track.withColumn("slope", (ahead - behind) / (2 * reach * STEP))
    return sloped.withColumn("tempo", series.median_around("slope", ["clip_id"], ["ref_frame"], half, half))


def steep_stretches(track: DataFrame, least_s: float = 0.12, most_s: float = 1.2, reach: int = REACH) -> DataFrame:
    """``(clip_id, r0, r1, mag)`` of stretches where the lag rises or falls steeply, ``mag`` in signed seconds.

    A stretch opens at a steep slope and goes on while it is at least a lesser
    one, so it is what follows the first steep frame of a run of lesser ones.
    """
    n = track.groupBy("clip_id").agg(F.max("ref_frame").alias("last"))
    found = None
    for sign, start, stay in ((1, 0.6, 0.35), (-1, 0.45, 0.3)):
        s = sign * F.col("slope")
        some = series.runs(track, ["clip_id"], ["ref_frame"], s > stay, [F.min(F.when(s > start, F.col("ref_frame"))).alias("a"), F.max("ref_frame").alias("b")])
        some = some.filter("a is not null").select("clip_id", "a", "b", F.lit(sign).alias("sign"))
        found = some if found is None else found.unionByName(some)
    wide = found.join(n, "clip_id").select("clip_id", "sign", F.greatest(F.lit(0), F.col("a") - reach // 2).alias("r0"), F.least("last", F.col("b") + reach // 2).alias("r1"))
    at = {r: track.select("clip_id", F.col("ref_frame").alias(r), F.col("lag_s").alias(f"{r}_lag")) for r in ("r0", "r1")}
    sized = wide.join(at["r0"], ["clip_id", "r0"]).join(at["r1"], ["clip_id", "r1"]).withColumn("mag", F.col("r1_lag") - F.col("r0_lag"))
    return sized.filter((F.abs("mag") >= least_s - 1e-9) & ((F.col("r1") - F.col("r0")) * STEP <= most_s + 1e-9) & (F.signum("mag") == F.col("sign"))).select("clip_id", "r0", "r1", "mag")


def without_jitter(events: DataFrame, apart_s: float = 1.0) -> DataFrame:
    """``events`` without neighbours of about the same size and opposite sign, which cancel each other.

    Each event cancels with at most one neighbour, from the left: in a chain of
    neighbours that would cancel, the first takes the second, the third the
    fourth, and so on.
    """
    w = Window.partitionBy("clip_id").orderBy("r0", "r1", "mag")
    after = F.lead(F.struct("r0", "mag")).over(w)
    close = ((after["r0"] - F.col("r1")) * STEP <= apart_s + 1e-9) & (F.signum(after["mag"]) != F.signum("mag"))
    size = F.abs(F.abs(after["mag"]) - F.abs("mag")) <= 0.08 + 0.4 * F.greatest(F.abs(after["mag"]), F.abs("mag"))
    linked = events.withColumn("_link", F.coalesce(close & size, F.lit(False)))
    chained = series.sessions(linked, ["clip_id"], ["r0", "r1", "mag"], ~F.lag("_link").over(w))
    place = F.row_number().over(Window.partitionBy("clip_id", "session").orderBy("r0", "r1", "mag"))
    first = chained.withColumn("_first", F.col("_link") & (place % 2 == 1))
    goes = F.col("_first") | F.coalesce(F.lag("_first").over(Window.partitionBy("clip_id", "session").orderBy("r0", "r1", "mag")), F.lit(False))
    return first.withColumn("_goes", goes).filter("not _goes").select("clip_id", "r0", "r1", "mag")


def lag_events(track: DataFrame) -> DataFrame:
    """``(clip_id, kind, t0, t1, mag, r0, r1, signed)`` of insertions and deletions."""
    kept = without_jitter(steep_stretches(track))
    kind = F.when(F.col("mag") > 0, "ins").otherwise("del")
    return kept.select("clip_id", kind.alias("kind"), (F.col("r0") * STEP).alias("t0"), (F.col("r1") * STEP).alias("t1"), F.abs("mag").alias("mag"), "r0", "r1", F.col("mag").alias("signed"))


def without_events(track: DataFrame, events: DataFrame) -> DataFrame:
    """``track`` with ``steady_s``: participant times with every event's jump smoothed out, never falling.

    An event's part is a ramp between its frames and its whole size after
    them: ramps are exploded, sizes are a running sum.
    """
    x = (F.col("ref_frame") - F.col("r0")) / F.greatest(F.lit(1), F.col("r1") - F.col("r0"))
    ramps = events.filter("r1 > r0 + 1").select("clip_id", "r0", "r1", "signed", F.explode(F.sequence(F.col("r0") + 1, F.col("r1") - 1)).alias("ref_frame"))
    ramps = ramps.groupBy("clip_id", "ref_frame").agg(F.sum(F.col("signed") * x * x * (3 - 2 * x)).alias("ramp"))
    jumps = events.groupBy("clip_id", F.col("r1").alias("ref_frame")).agg(F.sum("signed").alias("jump"))
    w = Window.partitionBy("clip_id").orderBy("ref_frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = track.join(ramps, ["clip_id", "ref_frame"], "left").join(jumps, ["clip_id", "ref_frame"], "left").fillna({"ramp": 0.0, "jump": 0.0})
    flat = both.withColumn("_steady", F.col("par_s") - F.sum("jump").over(w) - F.col("ramp"))
    return flat.withColumn("steady_s", F.max("_steady").over(w)).drop("_steady", "ramp", "jump")


def placed_events(events: DataFrame, track: DataFrame, path: DataFrame, words: DataFrame) -> DataFrame:
    """``events`` with the boundary ``k`` they are nearest to and the participant's stretch ``q0`` to ``q1``.

    Of an insertion that is the stretch of its size with the highest cost
    (smoothed over five participant frames), near where the path puts it.
    """
    later = F.lead("start_s").over(by_word())
    mids = words.select("clip_id", F.col("i").alias("k"), ((F.col("end_s") + later) / 2).alias("t")).filter("t is not null")
    near = intervals.nearest(events.withColumn("t", (F.col("t0") + F.col("t1")) / 2), mids, ["clip_id"], "t", ["k"])
    near = near.withColumn("k", F.coalesce("r_k", F.lit(0))).drop("t", "r_t", "r_k", "gap")
    at = {r: track.select("clip_id", F.col("ref_frame").alias(r), F.col("par_s").alias(p)) for r, p in (("r0", "p0"), ("r1", "p1"))}
    timed = near.join(at["r0"], ["clip_id", "r0"]).join(at["r1"], ["clip_id", "r1"])
    w = Window.partitionBy("clip_id").orderBy("par_frame")
    cost = path.groupBy("clip_id", "par_frame").agg(F.avg("cost").alias("c"))
    smooth = cost.withColumn("c", F.sum("c").over(w.rowsBetween(-2, 2)) / 5).withColumn("until", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    sums = smooth.select("clip_id", "par_frame", F.coalesce("until", F.lit(0.0)).alias("before"), (F.coalesce("until", F.lit(0.0)) + F.col("c")).alias("upto"))
    ends = cost.groupBy("clip_id").agg(F.max("par_frame").alias("last"))
    size = F.greatest(F.lit(2), F.rint(F.col("mag") / STEP)).cast("int")
    low, high = F.greatest(F.lit(0), F.floor(F.col("p0") / STEP + 1e-9).cast("int") - 15), F.least(F.col("last"), F.floor(F.col("p1") / STEP + 1e-9).cast("int") + 15)
    asked = timed.filter("kind = 'ins'").join(ends, "clip_id").withColumns({"size": size, "low": low, "high": high}).filter("high - low > size")
    tried = asked.select("clip_id", "r0", "r1", "size", F.explode(F.expr("sequence(low, high - size + 1)")).alias("b0")).withColumn("b1", F.col("b0") + F.col("size") - 1)
    tried = tried.join(sums.select("clip_id", F.col("par_frame").alias("b0"), "before"), ["clip_id", "b0"]).join(sums.select("clip_id", F.col("par_frame").alias("b1"), "upto"), ["clip_id", "b1"])
    best = tried.groupBy("clip_id", "r0", "r1", "size").agg(F.max_by("b0", F.struct(F.col("upto") - F.col("before"), -F.col("b0"))).alias("b0"))
    best = best.select("clip_id", "r0", "r1", (F.col("b0") * STEP).alias("_q0"), ((F.col("b0") + F.col("size")) * STEP).alias("_q1"))
    told = timed.join(best, ["clip_id", "r0", "r1"], "left")
    return told.withColumns({"q0": F.coalesce("_q0", "p0"), "q1": F.coalesce("_q1", "p1")}).drop("_q0", "_q1")


def compared(words: DataFrame, track: DataFrame, events: DataFrame) -> DataFrame:
    """Reference ``words(clip_id, i, w, start_s, end_s)`` with the participant's times, durations, tempo ratio, cost and gaps.

    ``ps`` and ``pe`` are where the participant says the word, ``dur_p`` is its
    length without events, ``rho`` is over 1 where the participant is faster
    than its own median, ``kappa`` the clip's median ratio of durations,
    ``dgap`` what events add at the boundary after the word.
    """
    steady = without_events(track, events)
    last = track.groupBy("clip_id").agg(F.max("ref_frame").alias("last_frame"), F.median("tempo").alias("usual_tempo"))

    def frame(t: Column) -> Column:
        return F.least(F.col("last_frame"), F.greatest(F.lit(0), F.rint(t / STEP).cast("int")))

    asked = words.join(last, "clip_id").withColumns({"_a": frame(F.col("start_s")), "_b": frame(F.col("end_s")), "_m": frame((F.col("start_s") + F.col("end_s")) / 2)})
    for place, columns in (("_a", {"par_s": "ps", "steady_s": "_sa"}), ("_b", {"par_s": "_pe", "steady_s": "_sb"}), ("_m", {"tempo": "tempo"})):
        asked = asked.join(steady.select("clip_id", F.col("ref_frame").alias(place), *[F.col(c).alias(n) for c, n in columns.items()]), ["clip_id", place])
    costs = asked.select("clip_id", "i", F.explode(F.sequence("_a", F.greatest("_a", "_b"))).alias("ref_frame")).join(track.select("clip_id", "ref_frame", "cost"), ["clip_id", "ref_frame"])
    timed = asked.join(costs.groupBy("clip_id", "i").agg(F.avg("cost").alias("cost")), ["clip_id", "i"], "left")
    timed = timed.withColumns({"pe": F.greatest("_pe", "ps"), "dur_r": F.col("end_s") - F.col("start_s"), "dur_p": F.greatest(F.col("_sb") - F.col("_sa"), F.lit(0.0))})
    ratio = F.when((F.col("dur_r") > 0.08) & (F.col("dur_p") > 0.02), F.col("dur_r") / F.greatest("dur_p", F.lit(1e-3)))
    kappas = timed.groupBy("clip_id").agg(F.coalesce(F.median(ratio), F.lit(1.0)).alias("kappa"))
    later = F.lead("start_s").over(by_word())
    timed = timed.join(kappas, "clip_id").withColumns({
        "rho": (1 + F.col("usual_tempo")) / F.greatest(1 + F.col("tempo"), F.lit(0.2)), "gap_r": F.coalesce(later - F.col("end_s"), F.lit(0.0)),
    })
    near = intervals.nearest(
        events.withColumn("t", (F.col("t0") + F.col("t1")) / 2).select("clip_id", "t", "signed"),
        words.select("clip_id", F.col("i").alias("k"), ((F.col("end_s") + later) / 2).alias("t")).filter("t is not null"), ["clip_id"], "t", ["k"],
    )
    added = near.groupBy("clip_id", F.coalesce("r_k", F.lit(0)).alias("i")).agg(F.sum("signed").alias("dgap"))
    timed = timed.join(added, ["clip_id", "i"], "left").fillna({"dgap": 0.0})
    return timed.withColumn("gap_p", F.col("gap_r") / F.greatest("kappa", F.lit(1e-3)) + F.col("dgap")).drop("_a", "_b", "_m", "_sa", "_sb", "_pe", "last_frame", "usual_tempo")


def words_compared(words: DataFrame, track: DataFrame) -> DataFrame:
    """``compared`` with the events of the track itself."""
    return compared(words, track, lag_events(track))


def _own(words: DataFrame) -> DataFrame:
    """The words by the participant's times."""
    return words.select("clip_id", "i", F.col("ps").alias("start_s"), F.col("pe").alias("end_s"), *[c for c in ("btype", "dur_r") if c in words.columns])


def _reference(words: DataFrame) -> DataFrame:
    return words.select("clip_id", "i", "start_s", "end_s")


# ---------------------------------------------------------------- detectors


def pace(words: DataFrame, th: Mapping[str, float] = DEFAULTS) -> DataFrame:
    """Runs of words (long enough in the reference) whose smoothed tempo ratio is out of range."""
    w = by_word().rowsBetween(-1, 1)
    smooth = words.withColumn("smooth", F.coalesce(F.percentile(F.when(F.col("dur_r") > 0.06, F.col("rho")), F.lit(0.5)).over(w), F.lit(1.0)))
    out = None
    for flaw, flag, least, d in (
        ("PACE_FAST", F.col("smooth") >= th["pace_fast"], th["pace_min_s"], F.median("smooth")),
        ("PACE_SLOW", F.col("smooth") <= th["pace_slow"], 0.8 * th["pace_min_s"], 1 / F.greatest(F.median("smooth"), F.lit(1e-3))),
    ):
        runs = word_runs(smooth, flag, F.sum("dur_r").alias("ref_s"), d.alias("d"), F.median("smooth").alias("ratio")).filter(F.col("ref_s") >= least)
        found = regions(spread_words(runs, _own(words)), flaw, ratio=F.round("ratio", 2))
        out = found if out is None else out.unionByName(found)
    return out


def swaps(words: DataFrame, gains: DataFrame, th: Mapping[str, float] = DEFAULTS) -> DataFrame:
    """Words that fit the reference much worse than the four on either side."""
    contrast = F.col("cost") - F.coalesce(series.centre_of_neighbours("cost", ["clip_id"], ["i"], 4), F.lit(0.0))
    told = words.withColumn("d", contrast).join(gains, "clip_id").filter((F.col("d") >= th["swap_contrast"] * F.col("gain")) & (F.col("dur_r") >= 0.1))
    told = told.withColumns({"start_s": F.col("ps"), "end_s": F.greatest("pe", F.col("ps") + 0.1), "w0": F.col("i"), "w1": F.col("i")})
    return regions(told, "WORD_SWAP", cost=F.round("cost", 3))


def pauses(words: DataFrame, own: DataFrame, reference: DataFrame, th: Mapping[str, float] = DEFAULTS, most_s: float = 0.6) -> DataFrame:
    """Pauses that are longer or shorter than the reference's at a boundary; ``own`` and ``reference(clip_id, start_s, end_s)`` are silences."""
    mine = detect.boundary_silences(_own(words), own, most_s)
    theirs = detect.boundary_silences(_reference(words), reference, most_s).select("clip_id", "k", F.col("long").alias("theirs"))
    last = words.groupBy("clip_id").agg(F.max_by("pe", "i").alias("until"))
    at = mine.join(theirs, ["clip_id", "k"]).join(words.select("clip_id", F.col("i").alias("k"), "btype", "pe"), ["clip_id", "k"]).join(last, "clip_id")
    at = at.filter((F.col("mid") >= 0.4) & (F.col("mid") <= F.col("until") - 0.3)).withColumns({"w0": F.col("k"), "w1": F.col("k") + 1})
    limit = F.when(F.col("btype") == "phrase_tight", th["pause_abs"]).when(F.col("btype") == "phrase_loose", 1.6 * th["pause_abs"])
    more = F.col("long") - F.col("theirs")
    bad = at.filter((F.col("long") > 0) & (more >= limit)).withColumns({"start_s": F.col("s0"), "end_s": F.col("s1"), "d": more})
    need = F.when(F.col("btype") == "sentence", 0.45).when(F.col("btype") == "clause_punct", 0.3)
    lost = at.filter((F.col("theirs") >= need) & (F.col("long") < th["lost_frac"] * F.col("theirs")))
    lost = lost.withColumns({"start_s": F.col("pe"), "end_s": F.col("pe") + F.greatest(F.lit(0.05), -more), "d": -more})
    return regions(bad, "PAUSE_BAD", boundary=F.col("btype")).unionByName(regions(lost, "PAUSE_LOST", boundary=F.col("btype")))


def block_features(frames: DataFrame, blocks: DataFrame) -> DataFrame:
    """Of inserted ``blocks(clip_id, block, start_s, end_s)`` of six frames or more: mean change of the high band, voiced share."""
    met = detect.frames_in(blocks.select("clip_id", "block", "start_s", "end_s"), frames.select("clip_id", "frame_i", "hf", "voiced"), "start_s", "end_s")
    stepped = met.withColumn("change", F.abs(F.col("hf") - F.lag("hf").over(Window.partitionBy("clip_id", "block").orderBy("frame_i"))))
    return stepped.groupBy("clip_id", "block").agg(F.avg("change").alias("change"), F.avg(F.col("voiced").cast("double")).alias("voiced"), F.count(F.lit(1)).alias("n")).filter("n >= 6")


def silent_share(frames: DataFrame, spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``spans`` with ``silent`` and ``sounding``: shares of their frames that are silent and voiced; of no frames 1 and 0."""
    quiet = frames.groupBy("clip_id").agg((0.65 * F.percentile("inten", F.lit(0.05))).alias("quiet"))
    met = detect.frames_in(spans.select("clip_id", *keys, start, end), frames.join(quiet, "clip_id"), start, end)
    shares = met.groupBy("clip_id", *keys).agg(F.avg((F.col("inten") < F.col("quiet")).cast("double")).alias("silent"), F.avg(F.col("voiced").cast("double")).alias("sounding"))
    return spans.join(shares, ["clip_id", *keys], "left").fillna({"silent": 1.0, "sounding": 0.0})


def from_events(c: Comparison, th: Mapping[str, float] = DEFAULTS, repeats: detect.Classifier | None = None) -> DataFrame:
    """What the events mean: hesitations, pauses, repeats, fillers, skipped words, lost pauses."""
    n = c.words.groupBy("clip_id").agg(F.max("i").alias("last_i"))
    e = c.events.join(n, "clip_id").withColumn("k", F.least("k", F.col("last_i") - 1)).filter("k >= 0")
    at = c.words.select("clip_id", F.col("i").alias("k"), "btype", "zipf_next", "gap_r", F.col("pe").alias("k_end"))
    e = e.join(at, ["clip_id", "k"]).join(c.words.select("clip_id", (F.col("i") - 1).alias("k"), F.col("pe").alias("next_end")), ["clip_id", "k"], "left")
    added = silent_share(c.own, e.filter((F.col("kind") == "ins") & (F.col("mag") >= th["repeat_min"])), ["r0", "r1"], "q0", "q1")
    blocks = added.select("clip_id", F.struct("r0", "r1").alias("block"), F.col("q0").alias("start_s"), F.col("q1").alias("end_s"))
    shape = block_features(c.own, blocks).select("clip_id", F.col("block.r0").alias("r0"), F.col("block.r1").alias("r1"), "change", "voiced")
    added = added.join(shape, ["clip_id", "r0", "r1"], "left").fillna({"change": 0.0, "voiced": 0.5})
    p = repeats.probability() if repeats else F.when(F.col("voiced") < 0.55, 1.0).otherwise(0.0)
    added = added.withColumn("p", F.when(F.col("btype").isin(*OPENERS), p).otherwise(0.0)).withColumns({"start_s": F.col("q0"), "end_s": F.col("q1"), "d": F.col("mag")})
    rare, silent = F.coalesce(F.col("zipf_next") < 3.5, F.lit(False)) & (F.col("mag") >= th["rare_min"]), F.col("silent") >= 0.6
    flaw = (
        F.when(rare, "RARE_HESIT").when(silent, F.when(F.lit(th["abs_pause"] < 1) & (F.col("mag") >= th["pause_ins_min"]) & ((F.col("btype") == "phrase_tight") | ((F.col("btype") == "phrase_loose") & (F.col("mag") >= 0.45))), "PAUSE_BAD"))
        .when(F.col("p") >= 0.5, "REPEAT").when(F.col("mag") >= th["pause_ins_min"], "FILLER")
    )
    told = added.withColumn("made", flaw).filter("made is not null")
    first = F.when(F.col("made").isin("RARE_HESIT", "REPEAT"), F.col("k") + 1).otherwise(F.col("k"))
    until = F.when(F.col("made") == "RARE_HESIT", F.greatest("next_end", F.col("end_s") + 0.05)).otherwise(F.col("end_s"))
    inserted = regions(told.withColumns({"w0": first, "w1": F.col("k") + 1, "end_s": until}), F.col("made"), boundary=F.col("btype"))
    gone = e.filter("kind = 'del'")
    whole = intervals.overlap_join(
        gone.select("clip_id", "r0", "r1", "mag", (F.col("t0") - 0.05).alias("start_s"), (F.col("t1") + 0.05).alias("end_s")), c.words.select("clip_id", "i", "ps", "pe", "dur_r", "start_s", "end_s"), ["clip_id"], 1.0
    ).filter("r_start_s >= start_s and r_end_s <= end_s")
    inside = whole.groupBy("clip_id", "r0", "r1", "mag").agg(F.min("r_i").alias("w0"), F.max("r_i").alias("w1"), F.sum("r_dur_r").alias("said_s"), F.count(F.lit(1)).alias("n_words"), F.min_by("r_ps", "r_i").alias("start_s"), F.max_by("r_pe", "r_i").alias("last_s"))
    skips = inside.filter((F.col("mag") >= th["skip_min"]) & (F.col("said_s") > th["skip_frac"] * F.col("mag"))).withColumns({"end_s": F.greatest("last_s", F.col("start_s") + 0.05), "d": F.col("mag")})
    rest = gone.join(skips.select("clip_id", "r0", "r1"), ["clip_id", "r0", "r1"], "left_anti")
    lost = rest.filter(F.lit(th["abs_lost"] < 1) & F.col("btype").isin("clause_punct", "sentence") & (F.col("gap_r") >= 0.15))
    lost = lost.withColumns({"start_s": F.col("k_end"), "end_s": F.col("k_end") + F.greatest(F.lit(0.05), F.col("gap_r") - F.col("mag")), "d": F.col("mag"), "w0": F.col("k"), "w1": F.col("k") + 1})
    out = inserted.unionByName(regions(skips, "WORD_SKIP", n_words=F.col("n_words"))).unionByName(regions(lost, "PAUSE_LOST", boundary=F.col("btype")))
    if th["abs_pause"] >= 1 or th["abs_lost"] >= 1:
        quiet = [series.silences(f.withColumn("role", F.lit("any"))) for f in (c.own, c.reference)]
        kinds = [k for k, on in (("PAUSE_BAD", th["abs_pause"]), ("PAUSE_LOST", th["abs_lost"])) if on >= 1]
        out = out.unionByName(pauses(c.words, *quiet, th).filter(F.col("flaw").isin(*kinds)))
    return out


def monotone(c: Comparison, th: Mapping[str, float] = DEFAULTS, rows: int = 12, step: int = 3) -> DataFrame:
    """Stretches whose pitch range falls short of the reference's, both by their clip's range."""
    own, theirs = _own(c.words), _reference(c.words)
    whole = c.own.groupBy("clip_id").agg(detect.quartile_range().alias("ip")).join(c.reference.groupBy("clip_id").agg(detect.quartile_range().alias("ir")), "clip_id").filter("ip > 0.5 and ir > 0.5")
    n = c.words.groupBy("clip_id").agg((F.max("i") + 1).alias("n"))
    firsts = n.select("clip_id", F.explode(F.expr(f"sequence(0, greatest(0, n - {rows}), {step})")).alias("w0")).withColumn("w1", F.col("w0") + rows - 1)

    def ranged(spans: DataFrame) -> DataFrame:
        mine = measured(spread_words(spans.select("clip_id", "w0", "w1"), own), c.own, "start_s", "end_s", ["w0", "w1"], detect.quartile_range(), "wp")
        other = measured(spread_words(spans.select("clip_id", "w0", "w1"), theirs), c.reference, "start_s", "end_s", ["w0", "w1"], detect.quartile_range(), "wr")
        return mine.join(other.select("clip_id", "w0", "w1", "wr"), ["clip_id", "w0", "w1"]).join(whole, "clip_id")

    flat = ranged(firsts).filter((F.col("wr") >= 1.2) & ((F.col("wp") / F.col("ip")) / (F.col("wr") / F.col("ir")) <= th["mono_ratio"]))
    flat = flat.select("clip_id", F.explode(F.sequence("w0", "w1")).alias("i")).distinct().withColumn("flat", F.lit(True))
    runs = word_runs(c.words.select("clip_id", "i").join(flat, ["clip_id", "i"], "left"), F.col("flat"))
    found = ranged(runs).filter(F.col("end_s") - F.col("start_s") >= th["mono_min_s"])
    return regions(found.withColumn("d", F.col("wr") * F.col("ip") / F.col("ir") - F.col("wp")), "MONOTONE", iqr_part=F.round("wp", 2), iqr_ref=F.round("wr", 2))


def _tails(words: DataFrame, tail_s: float, spare: int) -> DataFrame:
    return detect.sentence_tails(words.withColumn("heard", F.lit(True)), tail_s, spare)


def uptalk(c: Comparison, th: Mapping[str, float] = DEFAULTS) -> DataFrame:
    """Sentences whose pitch rises at the end more than the reference's."""
    tails = _tails(c.words, 1.0, 1)
    lasts = c.words.join(tails.select("clip_id", F.col("w1").alias("i")), ["clip_id", "i"])
    rises = detect.final_rise(lasts, c.own, "ps", "pe", "mine").join(detect.final_rise(lasts, c.reference, "start_s", "end_s", "theirs"), ["clip_id", "i"]).withColumnRenamed("i", "w1")
    told = tails.join(rises, ["clip_id", "w1"]).join(c.gains, "clip_id").withColumn("d", F.col("mine") - F.col("theirs")).filter(F.col("d") >= th["uptalk_st"] * F.col("gain"))
    return regions(spread_words(told, _own(c.words)), "UPTALK", rise_part=F.round("mine", 2), rise_ref=F.round("theirs", 2))


def fade(c: Comparison, th: Mapping[str, float] = DEFAULTS) -> DataFrame:
    """Sentences whose end falls off more than the reference's."""
    tails = _tails(c.words, 1.4, 2)
    mine = detect.level_fall(tails, c.words, c.own, "ps", "pe").withColumnRenamed("fall", "mine")
    theirs = detect.level_fall(tails, c.words, c.reference).select("clip_id", "sentence", F.col("fall").alias("theirs"))
    told = mine.join(theirs, ["clip_id", "sentence"]).join(c.gains, "clip_id").withColumn("d", F.col("theirs") - F.col("mine")).filter(F.col("d") >= th["fade_db"] * F.col("gain"))
    return regions(spread_words(told, _own(c.words)), "FADE")


def _beside(c: Comparison, rows: int, value: Column, least: int, sign: int, key: str, th: Mapping[str, float], flaw: str, least_s: float) -> DataFrame:
    mine = detect.ahead(_own(c.words), c.own, rows, value, least).select("clip_id", "i", F.col("v").alias("mine"))
    theirs = detect.ahead(_reference(c.words), c.reference, rows, value, least).select("clip_id", "i", F.col("v").alias("theirs"))
    told = mine.join(theirs, ["clip_id", "i"]).join(c.gains, "clip_id").withColumn("over", sign * (F.col("mine") - F.col("theirs")))
    return detect.window_runs(told, _own(c.words), th[key] * F.col("gain"), rows, flaw, least_s)


def shout(c: Comparison, th: Mapping[str, float] = DEFAULTS) -> DataFrame:
    """Stretches of six words louder than the reference's."""
    return _beside(c, 6, F.percentile("inten", F.lit(0.8)), 5, 1, "shout_db", th, "SHOUT", 0.6)


def slur(c: Comparison, th: Mapping[str, float] = DEFAULTS) -> DataFrame:
    """Stretches of seven words with weaker consonants than the reference's."""
    return _beside(c, 7, detect.top_share(), 8, -1, "slur_db", th, "SLUR", 1.0)


GROUPED = StructType([StructField("clip_id", StringType()), StructField("w0", IntegerType()), StructField("w1", IntegerType()), StructField("d", DoubleType()), StructField("words", IntegerType())])


def flat_stress(c: Comparison, th: Mapping[str, float] = DEFAULTS, window_s: float = 4.0) -> DataFrame:
    """Groups of words within ``window_s`` that are prominent in the reference and not in the recording.

    A group takes its words from later ones, so a clip's (few) such words are
    taken in order.
    """

    def prominence(times: DataFrame, frames: DataFrame, name: str) -> DataFrame:
        of_words = series.word_features(times, frames.withColumn("role", F.lit("par")))
        return of_words.select("clip_id", "i", F.col("prominence").alias(name))

    both = prominence(_reference(c.words), c.reference, "theirs").join(prominence(_own(c.words).select("clip_id", "i", "start_s", "end_s"), c.own, "mine"), ["clip_id", "i"])
    lost = F.when(F.col("theirs") > 0.8, F.col("theirs") - F.col("mine")).otherwise(0.0)
    marked = both.withColumn("d", lost).join(c.gains, "clip_id").filter(F.col("d") >= th["emph_drop"] * F.col("gain")).join(_reference(c.words), ["clip_id", "i"]).select("clip_id", "i", "d", "start_s", "end_s")

    def grouped(rows):
        open_ = list(rows)
        while open_:
            head, *rest = open_
            near = [r for r in rest if r["end_s"] <= head["start_s"] + window_s] if head["end_s"] <= head["start_s"] + window_s else []
            near = [head, *near]
            if len(near) >= th["emph_min_words"]:
                yield {"clip_id": head["clip_id"], "w0": near[0]["i"], "w1": near[-1]["i"], "d": sum(r["d"] for r in near) / len(near), "words": len(near)}
                open_ = [r for r in rest if r not in near]
            else:
                open_ = rest

    groups = series.folded(marked, ["clip_id"], ["i"], grouped, GROUPED)
    return regions(spread_words(groups, _own(c.words)), "EMPH_FLAT", words=F.col("words"))


def clause_spans(words: DataFrame) -> DataFrame:
    """``(clip_id, i, c0, c1)``: first and last word of each word's clause."""
    cut = series.sessions(words.select("clip_id", "i", "btype"), ["clip_id"], ["i"], F.lag("btype").over(by_word()).isin(*CLAUSE_ENDS))
    whole = Window.partitionBy("clip_id", "session")
    return cut.select("clip_id", "i", F.min("i").over(whole).alias("c0"), F.max("i").over(whole).alias("c1"))


def expanded(found: DataFrame, words: DataFrame, th: Mapping[str, float] = DEFAULTS) -> DataFrame:
    """Detections of flaws that act on a clause, over the whole clauses of their first and last words."""
    flaws = [f for f, key in (("EMPH_FLAT", "expand_emph"), ("SLUR", "expand_slur")) if th[key]]
    if not flaws:
        return found
    spans = clause_spans(words)
    wide = found.filter(F.col("flaw").isin(*flaws)).join(spans.select("clip_id", F.col("i").alias("w0"), "c0"), ["clip_id", "w0"]).join(spans.select("clip_id", F.col("i").alias("w1"), "c1"), ["clip_id", "w1"])
    wide = spread_words(wide.withColumns({"w0": F.col("c0"), "w1": F.col("c1")}).drop("c0", "c1"), _own(words))
    return found.filter(~F.col("flaw").isin(*flaws)).unionByName(wide.select(found.columns))


def filtered(found: DataFrame, clips: DataFrame, edge_s: float = 0.3, small: float = 0.5) -> DataFrame:
    """Detections without those that begin at a clip's edges, and without small ones of events that a slow stretch accounts for."""
    inside = found.join(clips.select("clip_id", "duration_s"), "clip_id").filter((F.col("start_s") >= 0.4) & (F.col("start_s") <= F.col("duration_s") - edge_s)).drop("duration_s")
    slight = inside.filter((F.col("d") < small) & (F.col("flaw") != "PACE_SLOW"))
    slow = found.filter("flaw = 'PACE_SLOW'").select("clip_id", "start_s", "end_s")
    key = ["flaw", "start_s", "end_s", "w0"]
    kept = intervals.without_overlap(slight, slow, ["clip_id"], key, 2.0, margin=0.2)
    return inside.filter((F.col("d") >= small) | (F.col("flaw") == "PACE_SLOW")).unionByName(kept.select(inside.columns))


def detected(c: Comparison, thresholds: Mapping[str, float] | None = None, repeats: detect.Classifier | None = None) -> DataFrame:
    """All detections of a comparison.

    Those of events are filtered at the edges and against slow stretches;
    swapped words count only where nothing else was found near; flaws of a
    clause are widened to it at the end.
    """
    th = {**DEFAULTS, **{k: v for k, v in (thresholds or {}).items() if k in DEFAULTS}}
    steady = pace(c.words, th)
    lasts = c.words.groupBy("clip_id").agg(F.max_by("pe", "i").alias("duration_s"))
    slow = steady.filter("flaw = 'PACE_SLOW'")
    events = filtered(from_events(c, th, repeats).unionByName(slow), lasts).filter("flaw <> 'PACE_SLOW'")
    wide = monotone(c, th).unionByName(slur(c, th)).unionByName(shout(c, th)).unionByName(flat_stress(c, th))
    others = events.unionByName(steady).unionByName(wide)
    alone = intervals.without_overlap(swaps(c.words, c.gains, th), others.select("clip_id", "start_s", "end_s"), ["clip_id"], ["w0"], 2.0, margin=0.1)
    found = others.unionByName(alone).unionByName(uptalk(c, th)).unionByName(fade(c, th))
    return expanded(found, c.words, th)


# ---------------------------------------------------------------- words off silences


def snapped(words: DataFrame, silences: DataFrame, frames: DataFrame | None = None, least_s: float = 0.12, early: float = 0.6, edge_s: float = 0.02, touch_s: float = 0.1) -> DataFrame:
    """Heard ``words(clip_id, i, start_s, end_s)`` with times that agree with the ``silences`` inside them.

    A silence in the first part of a word is the pause before it: the word
    begins where it ends, and the sound before it goes back to the word before.
    A later one ends the word, and the sound after it is the next word's start.
    One word's change is the next one's beginning, so a clip's words are taken
    in order.  With ``frames`` each word also has ``ts`` and ``te``, its first
    and last sounding frame, where these are 40 ms or more apart.
    """
    both = words.select("clip_id", "i", "start_s", "end_s", F.lit(1).alias("word")).unionByName(
        silences.filter(F.col("end_s") - F.col("start_s") >= least_s - 1e-9).select("clip_id", F.lit(-1).alias("i"), "start_s", "end_s", F.lit(0).alias("word"))
    )
    schema = StructType([StructField("clip_id", words.schema["clip_id"].dataType), StructField("i", IntegerType()), StructField("start_s", DoubleType()), StructField("end_s", DoubleType())])

    def move(rows):
        quiet, said = [], []
        for r in rows:  # silences come first, by time
            (said if r["word"] else quiet).append(r)
        for k, word in enumerate(said):
            before, after = said[k - 1] if k else None, said[k + 1] if k + 1 < len(said) else None
            while True:
                start, end = word["start_s"], word["end_s"]
                inner = next((q for q in quiet if q["start_s"] > start + edge_s and q["end_s"] < end - edge_s), None)
                if inner is None:
                    break
                if inner["start_s"] - start < early * (end - start):
                    if before:
                        before["end_s"] = inner["start_s"] if start - before["end_s"] <= touch_s else min(before["end_s"], inner["start_s"])
                    word["start_s"] = inner["end_s"]
                else:
                    if after and after["start_s"] - end <= touch_s:
                        after["start_s"] = min(after["start_s"], inner["end_s"])
                    word["end_s"] = inner["start_s"]
        yield from ({c: w[c] for c in schema.names} for w in said)

    moved = series.folded(both, ["clip_id"], ["word", "i", "start_s"], move, schema)
    if frames is None:
        return moved
    quiet = frames.groupBy("clip_id").agg((0.65 * F.percentile("inten", F.lit(0.05))).alias("quiet"))
    inside = detect.frames_in(moved.withColumn("_to", F.col("end_s") + STEP), frames.join(quiet, "clip_id").select("clip_id", "frame_i", "inten", "quiet"), "start_s", "_to").filter("inten >= quiet")
    sounding = inside.groupBy("clip_id", "i").agg(F.min("frame_i").alias("a"), F.max("frame_i").alias("b")).filter((F.col("b") - F.col("a")) * STEP >= 0.04 - 1e-9)
    told = moved.join(sounding, ["clip_id", "i"], "left")
    return told.withColumns({"ts": F.when(F.col("a").isNotNull(), F.greatest("start_s", F.col("a") * STEP)), "te": F.when(F.col("b").isNotNull(), F.least("end_s", (F.col("b") + 1) * STEP))}).drop("a", "b")

