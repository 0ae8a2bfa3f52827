"""What people label: the order of clips, what is a valid label, whose verdicts stand."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from tempora.functions.text import slug
from tempora.operators.series import placed
from tempora.plans.catalog import latest, stable_order

# Areas of marks, and verdicts on flags.
AREAS = ("Pacing", "Pausing", "Intonation", "Volume", "Fluency", "Clarity", "Text fidelity")
VERDICTS = ("agree", "disagree", "unsure")
LABELS = "rater STRING, labels MAP<STRING, STRUCT<clip: STRING, marks: ARRAY<STRUCT<t_s: DOUBLE, area: STRING, pressed_s: DOUBLE>>, score_1_10: INT, note: STRING, timestamp: STRING>>"


def clips_for(clips: DataFrame, raters: DataFrame, done: DataFrame) -> DataFrame:
    """``(rater, clip, place, done)``: each rater's own lasting order of ``clips(clip)``, and what ``(rater, clip)`` is labelled."""
    named = raters.select(slug(F.col("name")).alias("rater")).filter("rater is not null").distinct()
    pairs = clips.select("clip").crossJoin(F.broadcast(named))  # raters are a handful
    told = pairs.join(done.select("rater", "clip").distinct().withColumn("done", F.lit(True)), ["rater", "clip"], "left")
    keyed = told.select("rater", "clip", F.coalesce("done", F.lit(False)).alias("done"), stable_order(F.col("rater"), F.col("clip")).alias("_key"))
    return placed(keyed, ["rater"], ["_key", "clip"]).select("rater", "clip", "place", "done")


def problems(saved: DataFrame, clips: DataFrame) -> DataFrame:
    """``saved(rater, clip, marks array<struct<t_s, area>>, score_1_10)`` with what is wrong, only where something is."""
    told = saved.join(clips.select("clip", F.lit(True).alias("_known")), "clip", "left")
    rules = {
        "name": F.col("rater").isNull(), "clip": F.col("_known").isNull(), "score": ~F.coalesce(F.col("score_1_10").between(1, 10), F.lit(False)),
        "area": F.exists("marks", lambda m: F.coalesce(~m["area"].isin(*AREAS), F.lit(True))),
    }
    wrong = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return told.withColumn("wrong", wrong).filter(F.size("wrong") > 0).drop("_known")


def cleaned(saved: DataFrame) -> DataFrame:
    """Labels as they are stored: the last of a rater and clip, marks by time and rounded, the note trimmed."""
    rounded = F.transform("marks", lambda m: F.struct(F.round(m["t_s"], 3).alias("t_s"), m["area"].alias("area")))
    last = latest(saved, ["rater", "clip"], [F.desc("timestamp")])
    return last.withColumn("marks", F.array_sort(rounded)).withColumn("note", F.trim(F.coalesce("note", F.lit(""))))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """``(rater, clip, marks, score_1_10, note, timestamp)`` of a folder of raters' files."""
    read = spark.read.schema(LABELS).option("multiLine", True).json(path)
    return read.select("rater", F.explode("labels").alias("_c", "l")).select("rater", "l.*")


def marks_of(labels: DataFrame) -> DataFrame:
    return labels.select("rater", "clip", F.posexplode("marks").alias("mark_id", "m")).select("rater", "clip", "mark_id", F.col("m.t_s").alias("t_s"), F.col("m.area").alias("area"))


def to_review(flags: DataFrame, verdicts: DataFrame, reviewer: str) -> DataFrame:
    """Unmatched ``flags(flag, ...)`` with the reviewer's last verdict of ``(reviewer, flag, verdict, timestamp)``, null where there is none."""
    mine = latest(verdicts.filter((F.col("reviewer") == reviewer) & F.col("verdict").isin(*VERDICTS)), ["flag"], [F.desc("timestamp"), F.desc("verdict")])
    return flags.join(mine.select("flag", "verdict"), "flag", "left")


def hidden_set(clean: DataFrame, flawed: DataFrame, seed: int = 2026) -> DataFrame:
    """``(name, source_clip, hidden)``: clean and flawed ``(clip_id)`` under neutral names in a hashed order."""
    both = clean.select(F.col("clip_id").alias("source_clip"), F.lit(False).alias("hidden")).unionByName(flawed.select(F.col("clip_id").alias("source_clip"), F.lit(True).alias("hidden")))
    place = F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "source_clip"), "source_clip"))  # a set to listen to is some tens of clips
    return both.select(F.format_string("h%02d.flac", place).alias("name"), "source_clip", "hidden")
