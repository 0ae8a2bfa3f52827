"""Readers with explicit schemas: labels, word alignments, manifests, references, WAV audio."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

REGION = (
    "flaw STRING, category STRING, level INT, kind STRING, start_s DOUBLE, end_s DOUBLE, baseline_start_s DOUBLE, baseline_end_s DOUBLE, word_start INT, word_end INT, "
    "boundary STRING, context STRING, why STRING, severity DOUBLE, confidence DOUBLE, reliability DOUBLE, points_lost DOUBLE, explanation STRING, params MAP<STRING, STRING>"
)
LABEL = (
    "clip_id STRING, schema_version STRING, take_id STRING, baseline_id STRING, genre STRING, duration_s DOUBLE, seed INT, labels_from STRING, multi_set ARRAY<STRING>, "
    "who STRUCT<speaker_id: STRING, age_band: STRING, accent: STRING, gender: STRING, fluency_profile: STRING, synthetic_voice: BOOLEAN>, "
    "`where` STRUCT<base_condition: STRING, added_condition: STRING, params: MAP<STRING, STRING>>, "
    f"what ARRAY<STRUCT<{REGION}>>, scores STRUCT<overall: DOUBLE, band: STRING, worst_area_score: DOUBLE, categories: MAP<STRING, DOUBLE>>, _corrupt_record STRING"
)
ALIGNMENT = (
    "take_id STRING, sr INT, duration_s DOUBLE, align_source STRING, "
    "words ARRAY<STRUCT<i: INT, w: STRING, clean: STRING, punct: STRING, sent_end: BOOLEAN, clause_end: BOOLEAN, start_s: DOUBLE, end_s: DOUBLE>>"
)
MANIFEST = (
    "clip_id STRING, take_id STRING, baseline_id STRING, genre STRING, speaker_id STRING, age_band STRING, accent STRING, gender STRING, fluency_profile STRING, "
    "base_condition STRING, added_condition STRING, flaw_codes STRING, categories STRING, max_level INT, n_regions INT, duration_s DOUBLE, split STRING, labels_from STRING, "
    "licence STRING, sha256 STRING, origin STRING, register STRING, synthetic_voice BOOLEAN, multi_set STRING"
)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Label documents, one JSON document a file; broken ones keep their text in ``_corrupt_record``."""
    return spark.read.schema(LABEL).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def regions(labels: DataFrame) -> DataFrame:
    """A row for each region, numbered from 0 within its clip."""
    return labels.select("clip_id", F.posexplode("what").alias("rid", "r")).select("clip_id", "rid", "r.*")


def rule_breaks(labels: DataFrame, flaws: list[str], categories: list[str]) -> DataFrame:
    """Labels with the names of the rules that they break; only those that break one."""
    rules = {
        "clip_id": F.col("clip_id").isNull(), "duration": F.coalesce(F.col("duration_s") <= 0, F.lit(True)),
        "flaw": F.exists("what", lambda r: ~r["flaw"].isin(flaws)), "category": F.exists("what", lambda r: ~r["category"].isin(categories)),
        "order": F.exists("what", lambda r: r["end_s"] < r["start_s"]), "level": F.exists("what", lambda r: ~r["level"].between(1, 5)),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return labels.withColumn("broken", broken).filter(F.size("broken") > 0)


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """``words(take_id, i, w, clean, punct, sent_end, clause_end, start_s, end_s)``."""
    return spark.read.schema(ALIGNMENT).option("multiLine", True).json(path).select("take_id", F.explode("words").alias("x")).select("take_id", "x.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows; empty strings stay empty strings and bar-joined values also come as arrays."""
    rows = spark.read.schema(MANIFEST).option("header", True).option("emptyValue", "").option("nullValue", "\u0000").csv(path)
    return rows.withColumn("flaws", F.filter(F.split("flaw_codes", r"\|"), lambda x: x != ""))


def label_or_empty(manifest: DataFrame, labels: DataFrame) -> DataFrame:
    """Every manifest row with its regions, or none where it has no label."""
    what = labels.select("clip_id", "what")
    empty = F.from_json(F.lit("[]"), what.schema["what"].dataType)
    return manifest.join(what, "clip_id", "left").withColumn("what", F.coalesce("what", empty))


def until_total(df: DataFrame, keys: list[str], order: list[str], value: str, total: float) -> DataFrame:
    """Rows in order until their sum reaches ``total``; the row that reaches it is in."""
    from pyspark.sql import Window

    before = F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_before", F.coalesce(before, F.lit(0.0))).filter(F.col("_before") < total).drop("_before")


AUDIO = "path string, sr int, samples array<float>"


def wav(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """PCM WAV files of 8, 16 or 32 bits as mono samples from -1 to 1."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with wave.open(io.BytesIO(content)) as w:
                    width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
                    raw = np.frombuffer(w.readframes(w.getnframes()), {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
                x = (raw - 128) / 128 if width == 1 else raw / 2.0 ** (8 * width - 1)
                yield pd.DataFrame({"path": [name], "sr": [rate], "samples": [x.reshape(-1, channels).mean(axis=1).astype(np.float32)]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(decode, AUDIO)


FRAMES = "path string, frame_i int, inten double, hf double, f0_st double, voiced boolean"


def frames(audio: DataFrame, step_s: float = 0.01, window_s: float = 0.04, low_hz: float = 60.0, high_hz: float = 400.0) -> DataFrame:
    """Frames of 10 ms: level and high band in dB re the clip's median, pitch in semitones by autocorrelation (null where unvoiced)."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, sr, samples in zip(batch["path"], batch["sr"], batch["samples"]):
                x = np.asarray(samples, float)
                step, width = int(round(step_s * sr)), int(round(window_s * sr))
                n = max(0, (len(x) - width) // step + 1)
                if not n:
                    continue
                cut = np.lib.stride_tricks.sliding_window_view(x, width)[::step][:n]
                taper = np.hanning(width)
                power = np.abs(np.fft.rfft(cut * taper, 2 * width, axis=1)) ** 2
                hz = np.fft.rfftfreq(2 * width, 1 / sr)
                level = 10 * np.log10(power.mean(axis=1) + 1e-12)
                high = 10 * np.log10(power[:, hz >= 3000].mean(axis=1) + 1e-12) if (hz >= 3000).any() else level * 0
                auto = np.fft.irfft(power, axis=1)[:, :width] / np.maximum(np.correlate(taper, taper, "full")[width - 1 :], 1e-9)
                lags = slice(max(1, int(sr / high_hz)), min(width - 1, int(sr / low_hz)))
                strength = auto[:, lags] / np.maximum(auto[:, :1], 1e-12)
                best = strength.argmax(axis=1)
                voiced = (strength.max(axis=1) > 0.5) & (level > np.median(level) - 25)
                f0 = sr / (best + lags.start)
                pitch = np.where(voiced, 12 * np.log2(f0 / 100), np.nan)
                yield pd.DataFrame({
                    "path": name, "frame_i": np.arange(n), "inten": level - np.median(level), "hf": high - np.median(high),
                    "f0_st": pd.array([p if v else None for p, v in zip(pitch, voiced)], "Float64"), "voiced": voiced,
                })

    return audio.mapInPandas(measure, FRAMES)
