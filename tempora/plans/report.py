"""Reports: a split's measures, the headline, acceptance, agreement with people, and the predictors that test the harness."""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from tempora.operators import intervals
from tempora.operators.compare import EXPERIMENTAL
from tempora.plans import evaluate

# What a detector has to reach.
PASS_MARKS = {"f1": 0.7, "start_ms": 150.0, "end_ms": 150.0, "category_accuracy": 0.85, "spearman": 0.85, "false_flags_per_minute": 0.5}


# ---------------------------------------------------------------- predictors for the harness itself


def oracle(regions: DataFrame) -> DataFrame:
    """The true regions as predictions: the level (3 where there is none) as severity, sure of everything."""
    return regions.withColumn("severity", F.coalesce(F.col("level").cast("double"), F.lit(3.0))).withColumn("confidence", F.lit(1.0))


def nothing(regions: DataFrame) -> DataFrame:
    """No prediction at all."""
    return oracle(regions).filter(F.lit(False))


# ---------------------------------------------------------------- a split


def _numbered(truth: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    return truth.withColumnRenamed("rid", "i") if "rid" in truth.columns else truth, found.withColumnRenamed("rid", "j") if "rid" in found.columns else found


def groundings(truth: DataFrame, found: DataFrame, thresholds: Sequence[float] = (0.3, 0.5), width: float = 5.0) -> DataFrame:
    """``(iou, by, label, tp, n_truth, n_found, precision, recall, f1)`` by flaw and by category, label null over all."""
    truth, found = _numbered(truth, found)
    out = None
    for threshold in thresholds:
        for by in ("flaw", "category"):
            keep = lambda df, n: df.select("clip_id", n, F.col(by).alias("label"), "start_s", "end_s")  # noqa: E731, B023
            one = evaluate.grounding(keep(truth, "i"), keep(found, "j"), threshold, "label", width).select(F.lit(threshold).alias("iou"), F.lit(by).alias("by"), "label", "tp", "n_truth", "n_found", "precision", "recall", "f1")
            out = one if out is None else out.unionByName(one)
    return out


def located(truth: DataFrame, found: DataFrame, threshold: float = 0.3, width: float = 5.0) -> DataFrame:
    """Matches by time alone, with the category of both sides."""
    truth, found = _numbered(truth, found)
    cut = lambda df, n: df.select("clip_id", n, "category", "start_s", "end_s")
    return intervals.matched(cut(truth, "i"), cut(found, "j"), threshold, same=(), width=width)


def category_accuracy(matches: DataFrame) -> DataFrame:
    return matches.agg(F.avg((F.col("category") == F.col("r_category")).cast("double")).alias("category_accuracy"), F.count(F.lit(1)).alias("n"))


def summary(truth: DataFrame, found: DataFrame, clips: DataFrame, width: float = 5.0) -> DataFrame:
    """``(measure, value)`` of a split: F1 at both thresholds, F1 by starts, times, accuracy of areas, false flags a minute.

    ``truth`` and ``found(clip_id, rid, flaw, category, start_s, end_s)``,
    ``clips(clip_id, duration_s)``.
    """
    told = groundings(truth, found, width=width).filter("label is null").select(F.concat_ws("", "by", F.lit("_f1@"), F.col("iou").cast("string")).alias("measure"), F.col("f1").alias("value"))
    t, f = _numbered(truth, found)
    onsets = evaluate.onset_grounding(t, f).filter("flaw is null").select(F.lit("onset_f1").alias("measure"), F.col("f1").alias("value"))
    same = intervals.matched(t, f, 0.3, width=width)
    times = evaluate.timing(same).select(F.explode(F.create_map(F.lit("start_ms"), F.col("start_ms"), F.lit("end_ms"), F.col("end_ms"))).alias("measure", "value"))
    areas = category_accuracy(located(truth, found, width=width)).select(F.lit("category_accuracy").alias("measure"), F.col("category_accuracy").alias("value"))
    flags = evaluate.false_flags_per_minute(clips, truth, found).select(F.lit("false_flags_per_minute").alias("measure"), F.col("flags_per_minute").alias("value"))
    return told.unionByName(onsets).unionByName(times).unionByName(areas).unionByName(flags)


def passed(measures: DataFrame) -> DataFrame:
    """``measures(measure, value)`` that have a pass mark, with whether they reach it (times and false flags from below)."""
    marks = measures.sparkSession.createDataFrame([("flaw_f1@0.5" if k == "f1" else k, float(v)) for k, v in PASS_MARKS.items()], "measure string, mark double")
    low = F.col("measure").isin("start_ms", "end_ms", "false_flags_per_minute")
    return measures.join(F.broadcast(marks), "measure").withColumn("passes", F.when(low, F.col("value") <= F.col("mark")).otherwise(F.col("value") >= F.col("mark")))  # the table of marks


def headline(truth: DataFrame, found: DataFrame, clips: DataFrame, disabled: Sequence[str] = (), experimental: Sequence[str] = EXPERIMENTAL, width: float = 5.0) -> DataFrame:
    """``summary`` over the flaws that are neither experimental nor disabled."""
    out = [*experimental, *disabled]
    keep = lambda df: df.filter(~F.col("flaw").isin(*out)) if out else df
    return summary(keep(truth), keep(found), clips, width)


# ---------------------------------------------------------------- acceptance


def dose_response(scores: DataFrame, clean: DataFrame, levels: int = 5, limit: float = -0.9) -> DataFrame:
    """Per flaw with a score at every level the rank correlation of level (0: clean) and score; failing where it is over ``limit`` or null.

    ``scores(flaw, level, overall)``; ``clean`` is one row.
    """
    whole = scores.groupBy("flaw").agg(F.countDistinct("level").alias("n")).filter(F.col("n") == levels).select("flaw")
    zero = whole.crossJoin(F.broadcast(clean.select(F.lit(0).alias("level"), F.col("clean").alias("overall"))))  # one row
    told = evaluate.spearman(scores.join(whole, "flaw", "left_semi").select("flaw", "level", "overall").unionByName(zero), ["flaw"], "level", "overall")
    return told.withColumn("failing", F.coalesce(F.col("rho") > limit, F.lit(True)))


def acceptance(invariance: DataFrame, locality: DataFrame, flags_per_minute: float, most_shift: float = 3.0, most_loss: float = 2.0, most_flags: float = 0.5) -> DataFrame:
    """One row: the worst shift under a condition, the mean loss in other areas, and whether both pass."""
    one = invariance.agg(F.max("worst_shift").alias("worst_shift")).crossJoin(F.broadcast(locality.agg(F.avg("lost_elsewhere").alias("mean_loss"))))  # one row each
    return one.withColumns({
        "flags_per_minute": F.lit(float(flags_per_minute)), "invariance_passes": (F.col("worst_shift") < most_shift) & F.lit(flags_per_minute <= most_flags), "locality_passes": F.col("mean_loss") < most_loss,
    })


# ---------------------------------------------------------------- agreement with people


def flags_met(flags: DataFrame, marks: DataFrame, within_s: float = 1.0, width: float = 5.0) -> DataFrame:
    """``flags(clip, flag, start_s, end_s)`` with whether a mark ``(clip, t_s)`` lies within them or ``within_s`` of them."""
    points = marks.select("clip", (F.col("t_s") - within_s).alias("start_s"), (F.col("t_s") + within_s + 1e-9).alias("end_s"))
    wide = flags.select("clip", "flag", "start_s", (F.col("end_s") + 1e-9).alias("end_s"))
    met = intervals.overlap_join(wide, points, ["clip"], width).select("clip", "flag").distinct().withColumn("met", F.lit(True))
    return flags.join(met, ["clip", "flag"], "left").withColumn("met", F.coalesce("met", F.lit(False)))


def unmatched(flags: DataFrame, marks: DataFrame, labelled: DataFrame, within_s: float = 1.0, width: float = 5.0) -> DataFrame:
    """Flags on ``labelled(clip)`` clips that no mark meets."""
    return flags_met(flags.join(labelled, "clip", "left_semi"), marks, within_s, width).filter("not met").drop("met")


def agreed(flags: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row over unmatched ``flags(flag)``: how many were listened to, and how many more people agreed with than not: ``verdicts(flag, verdict)``."""
    votes = verdicts.groupBy("flag").agg((F.count_if(F.col("verdict") == "agree") > F.count_if(F.col("verdict") == "disagree")).alias("yes"))
    told = flags.join(votes, "flag", "left")
    return told.agg(F.count(F.lit(1)).alias("unmatched"), F.count("yes").alias("reviewed"), F.count_if(F.coalesce("yes", F.lit(False))).alias("agreed"))


def raters_agree(reference: DataFrame, other: DataFrame, within_s: float = 1.0, width: float = 5.0) -> DataFrame:
    """One row: how many of one rater's ``marks(clip, mark_id, t_s, area)`` another's meet, of any and the same area, and the other way round."""

    def met(mine: DataFrame, theirs: DataFrame) -> DataFrame:
        a = mine.select("clip", "mark_id", "area", (F.col("t_s") - within_s).alias("start_s"), (F.col("t_s") + within_s + 1e-9).alias("end_s"), "t_s")
        b = theirs.select("clip", "area", F.col("t_s").alias("start_s"), (F.col("t_s") + 1e-9).alias("end_s"), "t_s")
        pairs = intervals.overlap_join(a, b, ["clip"], width).filter(F.abs(F.col("t_s") - F.col("r_t_s")) <= within_s)
        return mine.join(pairs.groupBy("clip", "mark_id").agg(F.max(F.col("area") == F.col("r_area")).alias("same")), ["clip", "mark_id"], "left")

    one = met(reference, other).agg(F.count(F.lit(1)).alias("reference_marks"), F.count("same").alias("any_area"), F.count_if(F.coalesce("same", F.lit(False))).alias("same_area"))
    two = met(other, reference).agg(F.count(F.lit(1)).alias("other_marks"), F.count("same").alias("near_marks"))
    return one.crossJoin(F.broadcast(two))  # one row each


def found_injected(injected: DataFrame, flags: DataFrame, within_s: float = 1.0, width: float = 5.0) -> DataFrame:
    """``injected(clip, rid, start_s, end_s)`` with whether a flag begins or has its middle near them, or they begin near a flag."""
    wide = flags.select("clip", F.col("start_s").alias("f0"), F.col("end_s").alias("f1"), (F.col("start_s") - within_s).alias("start_s"), (F.col("end_s") + within_s + 1e-9).alias("end_s"))
    asked = injected.select("clip", "rid", F.col("start_s").alias("a"), F.col("end_s").alias("b"), (F.col("start_s") - within_s).alias("start_s"), (F.col("end_s") + within_s + 1e-9).alias("end_s"))
    pairs = intervals.overlap_join(asked, wide, ["clip"], width)
    near = lambda t, a, b: t.between(a - within_s, b + within_s)
    hit = near(F.col("r_f0"), F.col("a"), F.col("b")) | near((F.col("r_f0") + F.col("r_f1")) / 2, F.col("a"), F.col("b")) | near(F.col("a"), F.col("r_f0"), F.col("r_f1"))
    met = pairs.filter(hit).select("clip", "rid").distinct().withColumn("found", F.lit(True))
    return injected.join(met, ["clip", "rid"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def score_agreement(engine: DataFrame, ratings: DataFrame) -> DataFrame:
    """One row: rank correlation of the engine's ``(clip, overall)`` with the mean of people's ``(clip, score)``."""
    mean = ratings.groupBy("clip").agg(F.avg("score").alias("score"))
    return evaluate.spearman(engine.join(mean, "clip").withColumn("all", F.lit("all")), ["all"], "overall", "score").drop("all")
