"""From detections to a scored label: filters, arbitration, severity, score, points lost, explanations."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tempora.functions.text import first_words
from tempora.operators import compare, detect, intervals
from tempora.plans import score
from tempora.plans.placement import one_of
from tempora.plans.retake import TIPS, explained
from tempora.sources.model import SPEECH, Model

# How a mode is told.
MODES = {"same": "same-speaker", "cross": "cross-speaker", "free": "reference-free"}


def against_reference(c: compare.Comparison, model: Model) -> DataFrame:
    """Detections of recordings that were compared with their own references."""
    return compare.detected(c, model.thresholds, model.repeats)


def against_panel(comparisons: dict[str, compare.Comparison], primary: str, model: Model, need: int = 2) -> DataFrame:
    """Detections against the ``primary`` reference that others of the panel support, without disabled flaws."""
    found = None
    for ref, c in comparisons.items():
        one = compare.detected(c, model.thresholds, model.repeats).withColumn("ref_id", F.lit(ref))
        found = one if found is None else found.unionByName(one)
    key = F.struct("flaw", "start_s", "end_s", "w0", "w1")
    voted = intervals.voted(found.withColumn("id", F.to_json(key)), primary, need)
    kept = voted.filter(~F.col("flaw").isin(*model.disabled)) if model.disabled else voted
    return kept.drop("id", "ref_id", "agreeing")


def without_reference(c: detect.Clips, model: Model, text_given: bool = True) -> DataFrame:
    """Detections of recordings by themselves, without those that the mode, the text or the clip's length rules out."""
    return detect.usable(detect.detected(c, model.thresholds), c.clips, model.disabled, text_given=text_given)


def confidence(snr_db: Column, clipped: Column, bandwidth_hz: Column) -> tuple[Column, Column]:
    """How far a recording can be trusted, from 0 to 1, and its badge."""
    clip = lambda c, low, high: F.greatest(F.lit(low), F.least(F.lit(high), c))
    value = clip((snr_db - 8) / 22, 0.0, 1.0) * (1 - F.least(F.lit(1.0), 200 * clipped)) * clip(bandwidth_hz / 3000, 0.3, 1.0)
    return value, F.when(value > 0.7, "good").when(value > 0.4, "fair").otherwise("poor")


def predicted(
    found: DataFrame, clips: DataFrame, model: Model, rubric: score.Rubric = SPEECH, words: DataFrame | None = None, experimental: bool = False, quality: DataFrame | None = None, references: DataFrame | None = None
) -> DataFrame:
    """A label for every clip, with its regions in order of time and its scores.

    ``found`` as detectors return it; ``clips(clip_id, duration_s, genre,
    confidence, rough, fluency)``; ``words(clip_id, i, w)`` for explanations.
    Experimental flaws are left out before arbitration unless they are wanted,
    as they would outbid reliable ones.  ``quality(clip_id, ..)`` and
    ``references(clip_id, baseline_id, common_words)`` go into a label as they
    are, as ``quality`` and ``reference``; both are left out where not given.
    """
    spark = found.sparkSession
    asked = found if experimental else found.filter(~F.col("flaw").isin(*compare.EXPERIMENTAL))
    settled = intervals.arbitrated(asked.withColumn("category", one_of(detect.CATEGORY, F.col("flaw"))), model.reliability_table(spark))
    told = score.severity(settled, model.knot_table(spark)).join(clips.select("clip_id", "confidence"), "clip_id")
    trust = one_of(model.reliability, F.col("flaw"), F.lit(1.0)) if model.reliability else F.lit(1.0)
    told = told.withColumns({
        "severity": F.bround("severity", 3), "reliability": F.bround(trust, 2), "start_s": F.bround("start_s", 3), "end_s": F.bround("end_s", 3),
        "rid": F.to_json(F.struct("start_s", "end_s", "flaw", "w0", "w1")),
    })
    if words is None:
        told = told.withColumn("words_text", F.lit(""))
    else:
        texts = words.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("all_words"))  # a clip's words
        told = told.join(texts, "clip_id", "left").withColumn("words_text", F.coalesce(first_words(F.col("all_words"), F.col("w0"), F.col("w1")), F.lit(""))).drop("all_words")
    scores, regions = score.score(told.drop("confidence").join(clips.select("clip_id", "confidence"), "clip_id"), clips.drop("confidence"), rubric)
    tip = F.element_at(F.create_map(*[F.lit(x) for pair in TIPS.items() for x in pair]), F.col("flaw"))
    region = F.struct(
        "start_s", "end_s", "flaw", "category", F.col("w0").alias("word_start"), F.col("w1").alias("word_end"), F.lit("modify").alias("kind"), "severity", "confidence", "reliability", "points_lost", "explanation",
        F.map_concat("facts", F.create_map(F.lit("d"), F.bround("d", 3).cast("string")), F.map_filter(F.create_map(F.lit("tip"), tip), lambda k, v: v.isNotNull())).alias("params"),
    )
    order = ("start_s", "end_s", "flaw", "word_start")

    def earlier(a: Column, b: Column) -> Column:
        place = lambda r: F.struct(*[r[c].alias(c) for c in order])
        return F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0)

    what = explained(regions).groupBy("clip_id").agg(F.array_sort(F.collect_list(region), earlier).alias("what"))  # a clip's regions
    of_clip = F.struct("overall", "band", "worst_area_score", "categories", F.lit(MODES[model.mode]).alias("reference_mode"))
    labels = clips.join(scores.select("clip_id", of_clip.alias("scores")), "clip_id").join(what, "clip_id", "left")
    none = F.array().cast(what.schema["what"].dataType)
    more = []
    for name, table in (("quality", quality), ("reference", references)):
        if table is not None:
            labels = labels.join(table.select("clip_id", F.struct(*[c for c in table.columns if c != "clip_id"]).alias(name)), "clip_id", "left")
            more.append(name)
    return labels.select(F.lit("1.1.0").alias("schema_version"), *[c for c in clips.columns if c not in ("confidence", "rough", "fluency")], F.coalesce("what", none).alias("what"), "scores", F.lit("engine").alias("labels_from"), *more)


def covered_audio(audio: DataFrame, words: DataFrame, covered: DataFrame, spare_s: float = 1.5) -> DataFrame:
    """``audio(clip_id, text_id, sr, samples)`` without the end that no stitched reference covers.

    ``words(text_id, i, end_s)`` are those of the text's own reading and
    ``covered(text_id, covered_to)`` is ``stitch.coverage``: a recording is cut in
    the same proportion, and ``spare_s`` later.  Texts that are covered to their
    last word but one, and not at all, stay whole.
    """
    ends = words.groupBy("text_id").agg(F.max("i").alias("last_i"), F.max_by("end_s", "i").alias("last_s"))
    upto = words.select("text_id", F.col("i").alias("covered_to"), F.col("end_s").alias("upto_s"))
    told = covered.select("text_id", "covered_to").join(ends, "text_id").join(upto, ["text_id", "covered_to"])
    shares = told.filter("covered_to < last_i").select("text_id", (F.col("upto_s") / F.col("last_s")).alias("share"))
    n = F.floor(F.col("share") * F.size("samples") + spare_s * F.col("sr")).cast("int")
    cut = F.when(F.col("share").isNotNull(), F.slice("samples", 1, F.least(F.size("samples"), n))).otherwise(F.col("samples"))
    return audio.join(shares, "text_id", "left").withColumn("samples", cut).drop("share")


def rescored(labels: DataFrame, clips: DataFrame, rubric: score.Rubric = SPEECH) -> DataFrame:
    """``(clip_id, overall, band, worst_area_score, categories)`` of labels' regions under another rubric."""
    regions = labels.select("clip_id", F.posexplode("what").alias("rid", "r")).select("clip_id", "rid", "r.flaw", "r.category", "r.start_s", "r.end_s", "r.severity", "r.confidence", "r.reliability")
    return score.score(regions, clips.drop("confidence"), rubric)[0]
