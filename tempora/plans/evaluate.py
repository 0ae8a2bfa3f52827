"""Evaluation: precision, recall, F1, confusion, dose-response, invariance, agreement, AUC."""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from tempora.operators import intervals


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def prf(tp: Column, n_truth: Column, n_found: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 where a denominator is."""
    p, r = _ratio(tp, n_found), _ratio(tp, n_truth)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def grounding(truth: DataFrame, found: DataFrame, threshold: float, label: str = "flaw", width: float = 5.0) -> DataFrame:
    """P, R and F1 per label of ``truth(clip_id, i, ...)`` and ``found(clip_id, j, ...)``, and over all (label null).

    ``width`` is about the length of a usual region.
    """
    pairs = intervals.matched(truth, found, threshold, same=[label], width=width)
    return _rolled_up(truth, found, pairs, label)


def onset_grounding(truth: DataFrame, found: DataFrame, collar: float = 0.25, label: str = "flaw") -> DataFrame:
    """The same for regions that match by their starts alone."""
    return _rolled_up(truth, found, intervals.matched_onsets(truth, found, collar, same=[label]), label)


def _rolled_up(truth: DataFrame, found: DataFrame, pairs: DataFrame, label: str) -> DataFrame:
    counts = (
        truth.select(label, F.lit(1).alias("t"), F.lit(0).alias("f"), F.lit(0).alias("m"))
        .union(found.select(label, F.lit(0), F.lit(1), F.lit(0)))
        .union(pairs.select(label, F.lit(0), F.lit(0), F.lit(1)))
    )
    sums = counts.rollup(label).agg(F.sum("m").alias("tp"), F.sum("t").alias("n_truth"), F.sum("f").alias("n_found"))
    p, r, f1 = prf(F.col("tp"), F.col("n_truth"), F.col("n_found"))
    return sums.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1)


def timing(pairs: DataFrame) -> DataFrame:
    """Median distance of starts and ends of matches, in milliseconds."""
    return pairs.agg(
        F.median(1000 * F.abs(F.col("start_s") - F.col("r_start_s"))).alias("start_ms"), F.median(1000 * F.abs(F.col("end_s") - F.col("r_end_s"))).alias("end_ms")
    )


def confusion(pairs: DataFrame, truth: str, found: str, labels: Sequence[str]) -> DataFrame:
    """A row for each true label with the counts of each found label."""
    return pairs.groupBy(truth).pivot(found, list(labels)).count().fillna(0)


def centred_rank(keys: Sequence[str], value: str, n: Column) -> Column:
    """Mean rank of ``value`` in its group of rows that stand for ``n`` each, less the mean of all ranks."""
    group = Window.partitionBy(*keys)
    return F.sum(n).over(group.orderBy(value)) - F.sum(n).over(Window.partitionBy(*keys, value)) / 2 - F.sum(n).over(group) / 2


def rank_correlation(n: Column, xy: Column, xx: Column, yy: Column, least: int) -> Column:
    """From the number of rows and the sums of products of centred ranks; null under ``least`` rows or for a constant."""
    return F.when((n >= least) & (xx > 0) & (yy > 0), xy / F.sqrt(xx * yy))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Rank correlation with mean ranks of ties; null under ``least`` rows or for a constant.

    Equal pairs are first counted together, and the windows are over distinct
    pairs and distinct ``x``.  Values are ranked where they are and never joined
    by: a sum of doubles has other last bits each time a cluster works it out.
    """
    counts = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    n, yr = F.col("_n"), F.col("_yr")
    by_x = counts.withColumn("_yr", centred_rank(keys, "_y", n)).groupBy(*keys, "_x").agg(F.sum(n).alias("_v"), F.sum(n * yr).alias("_w"), F.sum(n * yr * yr).alias("_yy"))
    v, xr = F.col("_v"), F.col("_xr")
    found = by_x.withColumn("_xr", centred_rank(keys, "_x", v)).groupBy(*keys).agg(F.sum(v).alias("n"), F.sum(xr * F.col("_w")).alias("_xy"), F.sum(v * xr * xr).alias("_xx"), F.sum("_yy").alias("_yy"))
    return found.select(*keys, "n", rank_correlation(F.col("n"), F.col("_xy"), F.col("_xx"), F.col("_yy"), least).alias("rho"))


def auc(df: DataFrame, keys: Sequence[str], positive: str, value: str) -> DataFrame:
    """Area under the curve by rank sums, with the numbers behind it.

    Equal values are first counted together, so the running rank is over
    distinct values only.
    """
    flag = F.col(positive).cast("int")
    steps = df.filter(F.col(value).isNotNull() & F.col(positive).isNotNull()).groupBy(*keys, value).agg(F.sum(flag).alias("p"), F.sum(1 - flag).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = steps.withColumn("wins", F.col("p") * (below + F.col("q") / 2))
    sums = wins.groupBy(*keys).agg(F.sum("wins").alias("wins"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    return sums.select(*keys, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("wins") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def false_flags_per_minute(clips: DataFrame, truth: DataFrame, found: DataFrame) -> DataFrame:
    clean = clips.join(truth.select("clip_id").distinct(), "clip_id", "left_anti")
    flags = found.groupBy("clip_id").count()
    return clean.join(flags, "clip_id", "left").agg((F.coalesce(F.sum("count"), F.lit(0)) / (F.sum("duration_s") / 60)).alias("flags_per_minute"))


def invariance(scores: DataFrame) -> DataFrame:
    """How far each condition moves the score of a take from its clean one: ``scores(take_id, condition, overall)``."""
    clean = scores.filter("condition is null").select("take_id", F.col("overall").alias("clean"))
    moved = scores.filter("condition is not null").join(clean, "take_id").withColumn("shift", F.abs(F.col("overall") - F.col("clean")))
    return moved.groupBy("condition").agg(F.avg("shift").alias("mean_shift"), F.max("shift").alias("worst_shift"), F.count(F.lit(1)).alias("n"))


def locality(before: DataFrame, after: DataFrame) -> DataFrame:
    """Loss in areas other than the flaw's own: ``before(take_id, category, area_score)``, ``after`` also with clip_id and own_category."""
    both = after.join(before.select("take_id", "category", F.col("area_score").alias("was")), ["take_id", "category"])
    lost = F.when(F.col("category") != F.col("own_category"), F.greatest(F.lit(0.0), F.col("was") - F.col("area_score")))
    return both.groupBy("clip_id").agg(F.coalesce(F.sum(lost), F.lit(0.0)).alias("lost_elsewhere"))


def marks_met(marks: DataFrame, flags: DataFrame, within_s: float = 1.0, width: float = 5.0) -> DataFrame:
    """Per rater how many ``marks(rater, clip, t_s, area, mark_id)`` a flag meets, of any and of the same area."""
    points = marks.withColumn("start_s", F.col("t_s") - within_s).withColumn("end_s", F.col("t_s") + within_s + 1e-9)
    pairs = intervals.overlap_join(points, flags.select("clip", "start_s", (F.col("end_s") + 1e-9).alias("end_s"), "category"), ["clip"], width)
    met = pairs.groupBy("rater", "mark_id").agg(F.max(F.col("area") == F.col("r_category")).alias("same"))
    told = marks.join(met, ["rater", "mark_id"], "left")
    return told.groupBy("rater").agg(F.count(F.lit(1)).alias("n_marks"), F.count("same").alias("any_area"), F.sum(F.coalesce(F.col("same").cast("int"), F.lit(0))).alias("same_area"))
