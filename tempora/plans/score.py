"""Rubric score: fitted severities, penalties, areas, overall, bands, points lost.

Region to area to clip are three aggregations on the clip's key; the rubric is
a bounded table of literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window


@dataclass(frozen=True)
class Rubric:
    """Rates of the score; ``areas`` weighs the areas of each genre."""

    areas: dict[str, dict[str, float]]
    flaw_weight: dict[str, float] = field(default_factory=dict)
    event_flaws: tuple[str, ...] = ()
    default_genre: str = "interpretive_reading"
    scale: float = 35.0
    exponent: float = 2.0
    lone_discount: float = 0.5
    least_confidence: float = 0.4
    span_cap: float = 3.0
    span_unit_s: float = 2.0
    blend_mean: float = 0.6
    bands: tuple[tuple[str, float], ...] = (("polished", 90.0), ("strong", 75.0), ("noticeable", 60.0))
    lowest_band: str = "needs work"
    fluency_area: str = "fluency"


def severity(candidates: DataFrame, knots: DataFrame) -> DataFrame:
    """``candidates(flaw, d)`` with ``severity``: d on its flaw's knots (flaw, x, y), flat outside, from 0 to 5; without knots d itself."""
    lines = knots.groupBy("flaw").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("knots"))  # some tens of knots a flaw
    told = candidates.join(lines, "flaw", "left")
    d, k = F.col("d"), F.col("knots")
    below = F.filter(k, lambda p: p["x"] <= d)
    above = F.filter(k, lambda p: p["x"] > d)
    a, b = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    between = a["y"] + (b["y"] - a["y"]) * (d - a["x"]) / (b["x"] - a["x"])
    value = F.when(k.isNull(), d).when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).otherwise(between)
    return told.withColumn("severity", F.least(F.lit(5.0), F.greatest(F.lit(0.0), value))).drop("knots")


def _lookup(values: dict[str, float], key: Column, default: float) -> Column:
    if not values:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def penalties(regions: DataFrame, clips: DataFrame, rubric: Rubric) -> DataFrame:
    """Each region with its penalty.

    ``regions(clip_id, rid, flaw, category, start_s, end_s, severity,
    confidence, reliability)``; ``clips(clip_id, duration_s, genre, rough,
    fluency)``.  A region that alone counts in its area of a rough recording
    gets the discount.
    """
    r = regions.join(clips, "clip_id")
    counted = (F.col("confidence") >= rubric.least_confidence) & ~((F.col("category") == rubric.fluency_area) & ~F.col("fluency"))
    length = F.when(F.col("flaw").isin(list(rubric.event_flaws)), 1.0).otherwise(F.least(F.lit(rubric.span_cap), (F.col("end_s") - F.col("start_s")) / rubric.span_unit_s))
    full = _lookup(rubric.flaw_weight, F.col("flaw"), 1.0) * F.col("confidence") * F.col("reliability") * F.pow("severity", F.lit(rubric.exponent)) * length
    r = r.withColumn("counted", counted).withColumn("full", F.when(counted, full).otherwise(0.0))
    area = Window.partitionBy("clip_id", "category")
    r = r.withColumn("lone", F.col("rough") & (F.sum(F.col("counted").cast("int")).over(area) == 1))
    return r.withColumn("penalty", F.col("full") * F.when(F.col("lone"), rubric.lone_discount).otherwise(1.0)).drop("full")


def areas(priced: DataFrame, clips: DataFrame, rubric: Rubric) -> DataFrame:
    """A row for each clip and area of its genre: weight, penalty, score from 0 to 100 (one decimal)."""
    table = [(g, c, float(w)) for g, of in rubric.areas.items() for c, w in of.items()]
    weights = F.broadcast(clips.sparkSession.createDataFrame(table, "genre_used string, category string, weight double"))  # the rubric's table
    known = F.col("genre").isin(list(rubric.areas))
    wide = clips.withColumn("genre_used", F.when(known, F.col("genre")).otherwise(F.lit(rubric.default_genre))).join(weights, "genre_used")
    off = (F.col("category") == rubric.fluency_area) & ~F.col("fluency")
    clip = Window.partitionBy("clip_id")
    left = F.sum(F.when(off, 0.0).otherwise(F.col("weight"))).over(clip)
    wide = wide.withColumn("weight", F.when(off, 0.0).otherwise(F.col("weight") * F.sum("weight").over(clip) / left))
    sums = priced.groupBy("clip_id", "category").agg(F.sum("penalty").alias("penalty"), F.max("lone").alias("lone"))
    scored = wide.join(sums, ["clip_id", "category"], "left").fillna({"penalty": 0.0, "lone": False})
    minutes = F.greatest(F.col("duration_s") / 60, F.lit(0.25))
    return scored.withColumn("area_score", F.round(100 * F.exp(-(F.col("penalty") / minutes) / rubric.scale), 1)).select("clip_id", "category", "weight", "penalty", "lone", "area_score")


def band(score: Column, rubric: Rubric, worst: Column | None = None) -> Column:
    """The band of a score; a worst area under 30 puts it lowest, under 50 at most third."""
    named = F.lit(rubric.lowest_band)
    for name, least in reversed(rubric.bands):
        named = F.when(score >= least, F.lit(name)).otherwise(named)
    if worst is None:
        return named
    third = rubric.bands[-1][0]
    capped = F.when((worst < 50) & named.isin([n for n, _ in rubric.bands[:-1]]), F.lit(third)).otherwise(named)
    return F.when(worst < 30, F.lit(rubric.lowest_band)).otherwise(capped)


def overall(scored: DataFrame, rubric: Rubric) -> DataFrame:
    """A row for each clip: overall score, band, worst area, areas as a map."""
    heavy = F.col("weight") > 0
    blend = F.sum(F.col("weight") * F.col("area_score")) / F.sum("weight")
    worst = F.coalesce(F.min(F.when(heavy & ~F.col("lone"), F.col("area_score"))), F.min(F.when(heavy, F.col("area_score"))), F.lit(100.0))
    clips = scored.groupBy("clip_id").agg(
        F.round(rubric.blend_mean * blend + (1 - rubric.blend_mean) * worst, 1).alias("overall"), worst.alias("worst_area_score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "area_score")))).alias("categories"),
    )
    return clips.withColumn("band", band(F.col("overall"), rubric, F.col("worst_area_score")))


def points_lost(priced: DataFrame, scored: DataFrame) -> DataFrame:
    """Each region's share of what its area costs the clip (two decimals)."""
    total = scored.withColumn("all_weight", F.sum("weight").over(Window.partitionBy("clip_id"))).select("clip_id", "category", "weight", "all_weight", F.col("penalty").alias("of_area"), "area_score")
    told = priced.join(total, ["clip_id", "category"])
    share = F.when(F.col("of_area") > 0, F.col("weight") * (100 - F.col("area_score")) * F.col("penalty") / F.col("of_area") / F.col("all_weight")).otherwise(0.0)
    return told.withColumn("points_lost", F.round(share, 2)).drop("of_area", "all_weight", "area_score", "weight")


def score(regions: DataFrame, clips: DataFrame, rubric: Rubric) -> tuple[DataFrame, DataFrame]:
    """``(clips, regions)`` with scores and points lost."""
    priced = penalties(regions, clips, rubric)
    scored = areas(priced, clips, rubric)
    return overall(scored, rubric), points_lost(priced, scored)
