"""Readers of fitted models, norms and rubrics, and writers of results.

A model file holds, per mode, thresholds, isotonic knots, reliabilities,
disabled flaws and classifiers; its tables are small and always keyed by mode,
as modes share the names of thresholds with other meanings.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tempora.operators import compare, detect
from tempora.plans.score import Rubric

CLASSIFIER = "STRUCT<w: ARRAY<DOUBLE>, b: DOUBLE, mean: ARRAY<DOUBLE>, std: ARRAY<DOUBLE>>"
MODE = (
    "STRUCT<thresholds: MAP<STRING, DOUBLE>, isotonic: MAP<STRING, STRUCT<x: ARRAY<DOUBLE>, y: ARRAY<DOUBLE>>>, reliability: MAP<STRING, DOUBLE>, "
    f"disabled: ARRAY<STRING>, repeat_clf: {CLASSIFIER}, ins_clf: {CLASSIFIER}>"
)
SUMMARY = "STRUCT<median: DOUBLE, mad: DOUBLE, p05: DOUBLE, p95: DOUBLE, n: INT>"
NORMS = f"dur_model STRUCT<coef: ARRAY<DOUBLE>, features: ARRAY<STRING>>, pause MAP<STRING, {SUMMARY}>, final_rise {SUMMARY}, fade_db {SUMMARY}, rate_log_sigma DOUBLE"
MODES = ("same", "cross", "free")


@dataclass(frozen=True)
class Model:
    """What is fitted for one mode."""

    mode: str
    thresholds: dict[str, float] = field(default_factory=dict)
    knots: tuple[tuple[str, float, float], ...] = ()
    reliability: dict[str, float] = field(default_factory=dict)
    disabled: tuple[str, ...] = ()
    repeats: detect.Classifier | None = None
    insertions: detect.Classifier | None = None

    def knot_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.knots), "flaw string, x double, y double")

    def reliability_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.reliability.items()), "flaw string, reliability double")


def models(spark: SparkSession, path: str) -> DataFrame:
    """``(mode, model)`` of a model file."""
    read = spark.read.schema(", ".join(f"{m} {MODE}" for m in MODES)).option("multiLine", True).json(path)
    return read.select(F.explode(F.create_map(*[x for m in MODES for x in (F.lit(m), F.col(m))])).alias("mode", "model")).filter("model is not null")


def thresholds(models: DataFrame) -> DataFrame:
    return models.select("mode", F.explode("model.thresholds").alias("key", "value"))


def knots(models: DataFrame) -> DataFrame:
    of_flaw = models.select("mode", F.explode("model.isotonic").alias("flaw", "m"))
    return of_flaw.select("mode", "flaw", F.explode(F.arrays_zip("m.x", "m.y")).alias("k")).select("mode", "flaw", F.col("k.x").alias("x"), F.col("k.y").alias("y"))


def reliabilities(models: DataFrame) -> DataFrame:
    return models.select("mode", F.explode("model.reliability").alias("flaw", "reliability"))


def disabled(models: DataFrame) -> DataFrame:
    return models.select("mode", F.explode("model.disabled").alias("flaw"))


def resolved_thresholds(mode: str, fitted: dict[str, float]) -> dict[str, float]:
    """Defaults of the comparison, then of the free mode where that is meant, then what was fitted."""
    return {**compare.DEFAULTS, **(detect.DEFAULTS if mode == "free" else {}), **fitted}


def load_model(spark: SparkSession, path: str, mode: str) -> Model:
    """The model of a mode, or of ``same`` where the file has none: a few hundred numbers, which are wanted on the driver."""
    rows = {r.mode: r.model for r in models(spark, path).collect()}
    m = rows.get(mode) or rows.get("same")
    if m is None:
        return Model(mode, resolved_thresholds(mode, {}))

    def classifier(c, features: tuple[str, ...]) -> detect.Classifier | None:
        return detect.Classifier(features, tuple(c.w), c.b, tuple(c.mean), tuple(c.std)) if c else None

    points = tuple((flaw, x, y) for flaw, k in (m.isotonic or {}).items() for x, y in zip(k.x, k.y))
    return Model(
        mode, resolved_thresholds(mode, dict(m.thresholds or {})), points, dict(m.reliability or {}), tuple(m.disabled or ()),
        classifier(m.repeat_clf, ("change", "voiced")), classifier(m.ins_clf, detect.INSERTION_FEATURES),
    )


def load_norms(spark: SparkSession, path: str) -> detect.Norms:
    """What is usual among speakers; what the file lacks keeps its default."""
    r = spark.read.schema(NORMS).option("multiLine", True).json(path).first()
    usual = detect.Norms()
    pause = (r.pause or {}).get("sentence")
    return detect.Norms(
        pause.median if pause else usual.sentence_pause, r.final_rise.median if r.final_rise else usual.final_rise,
        r.fade_db.median if r.fade_db else usual.fade_db, tuple(r.dur_model.coef) if r.dur_model else (),
    )


RUBRIC = (
    "tau DOUBLE, severity_exponent DOUBLE, lone_discount DOUBLE, min_confidence DOUBLE, span_cap DOUBLE, blend_mean DOUBLE, bands MAP<STRING, DOUBLE>, "
    "genre_weights MAP<STRING, MAP<STRING, DOUBLE>>, flaw_weight MAP<STRING, DOUBLE>, event_flaws ARRAY<STRING>"
)


def load_rubric(spark: SparkSession, path: str) -> Rubric:
    """A rubric from a JSON file; what it lacks is as in the usual one."""
    r = spark.read.schema(RUBRIC).option("multiLine", True).json(path).first()
    usual = SPEECH
    bands = tuple(sorted((r.bands or dict(usual.bands)).items(), key=lambda b: -b[1]))
    value = lambda given, else_: else_ if given is None else given
    return Rubric(
        areas={g: dict(w) for g, w in r.genre_weights.items()} if r.genre_weights else usual.areas, flaw_weight=dict(value(r.flaw_weight, usual.flaw_weight)), event_flaws=tuple(value(r.event_flaws, usual.event_flaws)),
        default_genre=usual.default_genre, scale=value(r.tau, usual.scale), exponent=value(r.severity_exponent, usual.exponent), lone_discount=value(r.lone_discount, usual.lone_discount),
        least_confidence=value(r.min_confidence, usual.least_confidence), span_cap=value(r.span_cap, usual.span_cap), blend_mean=value(r.blend_mean, usual.blend_mean), bands=bands, fluency_area=usual.fluency_area,
    )


# The usual rubric.
SPEECH = Rubric(
    areas={
        "interpretive reading": {"Pacing": 0.15, "Pausing": 0.20, "Intonation": 0.25, "Volume": 0.10, "Fluency": 0.10, "Clarity": 0.10, "Text fidelity": 0.10},
        "declamation": {"Pacing": 0.15, "Pausing": 0.20, "Intonation": 0.20, "Volume": 0.20, "Fluency": 0.10, "Clarity": 0.10, "Text fidelity": 0.05},
        "extemporaneous": {"Pacing": 0.15, "Pausing": 0.15, "Intonation": 0.15, "Volume": 0.10, "Fluency": 0.30, "Clarity": 0.15, "Text fidelity": 0.00},
        "persuasive oratory": {"Pacing": 0.15, "Pausing": 0.20, "Intonation": 0.20, "Volume": 0.20, "Fluency": 0.15, "Clarity": 0.10, "Text fidelity": 0.00},
    },
    flaw_weight={"FADE": 8.0, "SHOUT": 1.39, "PACE_SLOW": 3.52, "PAUSE_BAD": 3.0, "FILLER": 0.69, "PACE_FAST": 5.16, "WORD_SKIP": 1.72, "SLUR": 0.83, "PAUSE_LOST": 3.42, "WORD_SWAP": 1.37, "MONOTONE": 1.2},
    event_flaws=("FILLER", "REPEAT", "RARE_HESIT", "PAUSE_BAD", "PAUSE_LOST", "WORD_SKIP", "WORD_SWAP", "UPTALK"),
    default_genre="interpretive reading",
    fluency_area="Fluency",
)


# ---------------------------------------------------------------- writers


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, nulls empty; each task writes its own."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """Label documents as lines of JSON, nulls left out and NaN never written."""
    labels.write.mode("overwrite").json(path)


def without_nan(df: DataFrame) -> DataFrame:
    """``df`` with null for every NaN."""
    numbers = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*[F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in numbers else F.col(f"`{c}`") for c in df.columns])


def checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(name, length, sha256)`` of the files of a folder, and the first 16 digits as an id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    digest = F.sha2("content", 256)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", digest.alias("sha256"), F.substring(digest, 1, 16).alias("id"))


def empty_labels(manifest: DataFrame) -> DataFrame:
    """Label rows without regions for clean takes: ``manifest(clip_id, take_id, baseline_id, genre, speaker_id, duration_s)``."""
    where = F.struct(F.lit("C0").alias("base_condition"), F.lit(None).cast("string").alias("added_condition"))
    return manifest.select("clip_id", "take_id", "baseline_id", "genre", F.struct("speaker_id").alias("who"), where.alias("where"), "duration_s", F.lit("generator").alias("labels_from"))


def clips_of_split(manifest: DataFrame, split: str, conditions: bool = False, flawed_only: bool = False) -> DataFrame:
    """Manifest rows of a split (``all``: of every one), without conditions and clean ones as wanted."""
    rows = manifest if split == "all" else manifest.filter(F.col("split") == split)
    rows = rows if conditions else rows.filter(F.coalesce("added_condition", F.lit("")) == "")
    return rows.filter(F.length(F.coalesce("flaw_codes", F.lit(""))) > 0) if flawed_only else rows
