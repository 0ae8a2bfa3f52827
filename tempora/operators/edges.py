"""Places of cuts: the lowest frame near a point, word edges moved into valleys, and voiced stretches inside spans.

Frames are ``(clip_id, frame_i, ..)`` with steps of ``step_s``.  What looks
around a frame is a window of so many rows, so nothing is searched point by
point; what goes from word to word streams through a fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql.types import StructField, StructType

from tempora.operators import series

# Words closer than this touch; a cut stays so far from the words' other ends, and within so much of where they touch.
TOUCHING_S, KEPT_S, REACH_S = 0.06, 0.03, 0.05


def lowest_near(df: DataFrame, keys: list[str], order: list[str], value: str, back: int, ahead: int, to: str = "low") -> DataFrame:
    """``df`` with ``to`` and ``to_offset``: the lowest value from ``back`` rows before to ``ahead`` rows after each row, and how many rows away it is.

    Of equally low rows the nearest, of equally near ones the earlier.  Null values are never lowest.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("_row", F.row_number().over(w))
    known = F.col(value).isNotNull()
    before = F.min(F.when(known, F.struct(F.col(value).alias("v"), (-F.col("_row")).alias("r")))).over(w.rowsBetween(-back, 0))  # the latest of equals
    after = F.min(F.when(known, F.struct(F.col(value).alias("v"), F.col("_row").alias("r")))).over(w.rowsBetween(0, ahead))  # the earliest of equals
    told = numbered.withColumn("_before", before).withColumn("_after", after)
    away = lambda side, sign: F.struct(F.col(f"{side}.v").alias("v"), F.abs(sign * F.col(f"{side}.r") - F.col("_row")).alias("away"), (sign * F.col(f"{side}.r") - F.col("_row")).alias("offset"))
    best = F.least(F.when(F.col("_before").isNotNull(), away("_before", F.lit(-1))), F.when(F.col("_after").isNotNull(), away("_after", F.lit(1))))
    found = told.withColumn("_best", best)
    return found.withColumn(to, F.col("_best.v")).withColumn(f"{to}_offset", F.col("_best.offset").cast("int")).drop("_row", "_before", "_after", "_best")


def quiet_near(df: DataFrame, keys: list[str], order: list[str], value: str, floor: Column, reaches: list[int], to: str = "low") -> DataFrame:
    """``lowest_near`` within the first of the growing ``reaches`` whose lowest value is below ``floor``, else within the last."""
    out = df
    for n, reach in enumerate(reaches):
        out = lowest_near(out, keys, order, value, reach, reach, f"_low{n}")
    below = [F.when(F.col(f"_low{n}") < floor, F.struct(F.col(f"_low{n}").alias("v"), F.col(f"_low{n}_offset").alias("o"))) for n in range(len(reaches))]
    last = len(reaches) - 1
    best = F.coalesce(*below, F.struct(F.col(f"_low{last}").alias("v"), F.col(f"_low{last}_offset").alias("o")))
    out = out.withColumn("_best", best).withColumn(to, F.col("_best.v")).withColumn(f"{to}_offset", F.col("_best.o"))
    return out.drop("_best", *[c for n in range(len(reaches)) for c in (f"_low{n}", f"_low{n}_offset")])


def floors(frames: DataFrame, level: str = "level", share: float = 0.05) -> DataFrame:
    """``(clip_id, floor_db)``: the level that so many of a clip's frames stay below."""
    return series.quantiles(frames, ["clip_id"], {"floor_db": share}, level)


def smoothed(frames: DataFrame, level: str = "level") -> DataFrame:
    """Levels as means of three frames, with zeros beyond a clip's ends."""
    w = Window.partitionBy("clip_id").orderBy("frame_i")
    return frames.withColumn(level, (F.coalesce(F.lag(level).over(w), F.lit(0.0)) + F.col(level) + F.coalesce(F.lead(level).over(w), F.lit(0.0))) / 3)


def refined_words(words: DataFrame, frames: DataFrame, step_s: float = 0.005, touching_s: float = TOUCHING_S, kept_s: float = KEPT_S, reach_s: float = REACH_S) -> DataFrame:
    """``words(clip_id, i, start_s, end_s)`` of which touching ones share one cut at the lowest of ``frames(clip_id, frame_i, level)`` near where they touch.

    A cut stays ``kept_s`` from the first word's own start, as far as that was
    moved before, and from the second one's end, and within ``reach_s`` of the
    middle; of equally low frames the first.  Words with a pause between them,
    and those without a frame to choose, stay as they are.
    """
    w = Window.partitionBy("clip_id").orderBy("i")
    pairs = words.withColumns({"next_start": F.lead("start_s").over(w), "next_end": F.lead("end_s").over(w)}).withColumn("middle", (F.col("end_s") + F.col("next_start")) / 2)
    touching = F.col("next_start") - F.col("end_s") < touching_s
    at = lambda c: F.floor(F.round(c / step_s, 6)).cast("long")
    lowest, highest = at(F.col("middle") - reach_s), at(F.least(F.col("next_end") - kept_s, F.col("middle") + reach_s))
    # at most 2 * reach / step frames a boundary
    asked = pairs.filter(touching & (lowest <= highest)).select("clip_id", "i", F.explode(F.sequence(lowest, highest)).alias("frame_i"))
    near = asked.join(smoothed(frames).select("clip_id", F.col("frame_i").cast("long").alias("frame_i"), "level"), ["clip_id", "frame_i"])
    levels = near.groupBy("clip_id", "i").agg(F.array_sort(F.collect_list(F.struct("frame_i", "level"))).alias("levels"))
    told = pairs.withColumn("touching", F.coalesce(touching, F.lit(False))).join(levels, ["clip_id", "i"], "left").select("clip_id", "i", "start_s", "end_s", "middle", "touching", "levels")
    schema = StructType([words.schema["clip_id"], words.schema["i"], *[StructField(c, words.schema["start_s"].dataType) for c in ("start_s", "end_s")]])

    def moved(rows: Iterator[dict]) -> Iterator[dict]:
        start = None
        for r in rows:
            start = r["start_s"] if start is None else start
            end, following = r["end_s"], None
            if r["touching"]:
                first = int(max(start + kept_s, r["middle"] - reach_s) / step_s + 1e-6)
                left = [(x["level"], x["frame_i"]) for x in r["levels"] or [] if x["frame_i"] >= first]
                end = following = (min(left)[1] + 1) * step_s if left else r["middle"]
            yield {"clip_id": r["clip_id"], "i": r["i"], "start_s": start, "end_s": end}
            start = following

    return series.folded(told, ["clip_id"], ["i"], moved, schema)


def voiced_stretches(spans: DataFrame, frames: DataFrame, step_s: float = 0.01, least_s: float = 0.05) -> DataFrame:
    """``(clip_id, rid, start_s, end_s, f0)``: the longest voiced stretch inside each span, the first of equals, and its median pitch (unvoiced frames count as 0).

    ``frames(clip_id, frame_i, voiced, f0)``; single unvoiced frames inside do not break a stretch, and shorter ones than ``least_s`` are none.
    """
    first, last = F.ceil(F.round(F.col("start_s") / step_s, 6)).cast("long"), F.ceil(F.round(F.col("end_s") / step_s, 6)).cast("long") - 1
    inside = spans.filter(first <= last).select("clip_id", "rid", F.explode(F.sequence(first, last)).alias("frame_i"))
    held = inside.join(frames.select("clip_id", F.col("frame_i").cast("long").alias("frame_i"), "voiced", "f0"), ["clip_id", "frame_i"])
    w = Window.partitionBy("clip_id", "rid").orderBy("frame_i")
    bridged = held.withColumn("bridged", F.col("voiced") | (F.coalesce(F.lag("voiced").over(w), F.lit(False)) & F.coalesce(F.lead("voiced").over(w), F.lit(False))))
    pitch = F.percentile(F.when(F.col("voiced"), F.col("f0")).otherwise(0.0), F.lit(0.5)).alias("f0")
    runs = series.runs(bridged, ["clip_id", "rid"], ["frame_i"], F.col("bridged"), [F.min("frame_i").alias("a"), F.max("frame_i").alias("b"), pitch])
    longest = runs.groupBy("clip_id", "rid").agg(F.min(F.struct((-F.col("n")).alias("n"), "a", "b", "f0")).alias("x")).select("clip_id", "rid", "x.*")
    kept = longest.filter(-F.col("n") * step_s >= least_s - 1e-9)
    return kept.select("clip_id", "rid", ((F.col("a") - 0.5) * step_s).alias("start_s"), ((F.col("b") + 0.5) * step_s).alias("end_s"), "f0")
