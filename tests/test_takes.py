"""Paths, states and files of takes, and a label from a FLAC file."""

import json

import numpy as np
import pyspark.sql.functions as F

from test_flac import stream
from tempora.operators import detect, spectral
from tempora.plans import predict, score
from tempora.sources import flac, labels, model, takes


def test_paths_of_clips_and_references(spark, tmp_path):
    for name in ("variants/B01-CHAMP__FADE.flac", "takes/B01-CHAMP__FADE.flac", "takes/B01-CHAMP_C0.flac", "takes/B02-CHAMP_C0.flac", "takes/other.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    variants, own = (takes.listed(spark, f"{tmp_path}/{f}", "*.flac") for f in ("variants", "takes"))
    clips = spark.createDataFrame([("B01-CHAMP__FADE",), ("B02-CHAMP_C0",), ("B03-CHAMP_C0",)], "clip_id string")
    got = {r.clip_id: r.path and r.path.split("/")[-2:] for r in takes.clip_paths(clips, variants, own).collect()}
    assert got == {"B01-CHAMP__FADE": ["variants", "B01-CHAMP__FADE.flac"], "B02-CHAMP_C0": ["takes", "B02-CHAMP_C0.flac"], "B03-CHAMP_C0": None}
    assert takes.listed(spark, f"{tmp_path}/nowhere").count() == 0
    wanted = spark.createDataFrame([(r,) for r in ("B01", "B02", "B09", "cross:B01", "cross:B02", "ref:mine")], "ref_id string")
    custom = spark.createDataFrame([("ref:mine", "u/mine.wav"), ("B02", "u/own.wav")], "ref_id string, path string")
    stitched = spark.createDataFrame([("cross:B01", "s/b01.flac"), ("B01", "s/never.flac")], "ref_id string, path string")
    got = {r.ref_id: r.path and "/".join(r.path.split("/")[-2:]) for r in takes.reference_paths(wanted, own, custom, stitched).collect()}
    assert got == {"B01": "takes/B01-CHAMP_C0.flac", "B02": "u/own.wav", "B09": None, "cross:B01": "s/b01.flac", "cross:B02": None, "ref:mine": "u/mine.wav"}
    assert {r.ref_id: r.path is None for r in takes.reference_paths(wanted, own).collect()}["ref:mine"]


def test_takes_are_written_and_read(spark, tmp_path):
    word = "struct<i: int, w: string, clean: string, punct: string, sent_end: boolean, clause_end: boolean, start_s: double, end_s: double>"
    rows = [("B01", "B01-CHAMP", 22050, 2.00004, "model", "One two.", [(7, "One", "one", "", False, False, 0.10004, 0.5), (8, "two.", "two", ".", True, True, 0.6, 1.23456789)], ("real_corpus", "F"))]
    df = spark.createDataFrame(rows, f"baseline_id string, take_id string, sr int, duration_s double, align_source string, text string, words array<{word}>, source struct<status: string, gender: string>")
    folder = f"file://{tmp_path}"
    assert takes.write_takes(df, folder).count() == 3
    assert (tmp_path / "baselines/B01/reference.txt").read_text() == "One two.\n"
    assert json.loads((tmp_path / "baselines/B01/source.json").read_text()) == {"status": "real_corpus", "gender": "F", "take_id": "B01-CHAMP"}
    words = labels.alignments(spark, f"{tmp_path}/takes/*.align.json").orderBy("i").collect()
    assert [(w.i, w.w, w.start_s, w.end_s, w.sent_end) for w in words] == [(0, "One", 0.1, 0.5, False), (1, "two.", 0.6, 1.2346, True)]
    baselines, audits = spark.createDataFrame([("B01",), ("B02",)], "id string"), spark.createDataFrame([("B02", "clean")], "id string, status string")
    told = takes.baselines_with_state(baselines, takes.source_states(spark, f"{folder}/baselines"), audits).orderBy("id").collect()
    assert [(r.id, r.status, r.audit) for r in told] == [("B01", "real_corpus", "not run"), ("B02", "unbuilt", "clean")]
    assert takes.source_states(spark, f"{folder}/nothing").count() == 0


def test_verdicts_and_what_was_not_placed(spark, tmp_path):
    assert takes.verdicts(spark, f"{tmp_path}/realism.csv").count() == 0
    (tmp_path / "realism.csv").write_text("clip_id,flaw,level,realism,audible,comment,reviewer,timestamp\nc,FADE,3,4,yes,,me,2024\n")
    assert takes.verdicts(spark, f"{tmp_path}/realism.csv").first().level == 3
    jobs = spark.createDataFrame([("t", "FADE"), ("t", "FADE"), ("t", "SHOUT"), ("u", "FADE")], "take_id string, flaw string")
    missing = takes.not_applicable(jobs, jobs.filter("take_id = 't' and flaw = 'FADE'")).orderBy("take_id").collect()
    assert [r.message for r in missing] == ["t: no place for SHOUT", "u: no place for FADE"]


def test_a_flac_file_becomes_a_label(spark, tmp_path):
    """Forty words of 0.3 s, eight of them far louder: read, resampled, measured, detected, arbitrated and scored."""
    sr, n = 8000, 40
    t = np.arange(int(0.3 * n * sr)) / sr
    gain = np.where((t >= 6.0) & (t < 8.4), 8.0, 1.0) * (0.6 + 0.4 * np.sin(2 * np.pi * t / 0.3) ** 2)
    x = (900 * gain * (np.sin(2 * np.pi * 150 * t) + 0.5 * np.sin(2 * np.pi * 300 * t)) + np.random.default_rng(1).integers(-3, 4, len(t))).astype(np.int64)
    blocks = [([x[a : a + 4000]], 0, [("fixed", {"order": 2, "k": 10})]) for a in range(0, len(x), 4000)]
    (tmp_path / "c.flac").write_bytes(stream(blocks, sr, 16, 1, 4000))
    audio = flac.recordings(spark, str(tmp_path), 16000)
    frames = spectral.frames(audio).withColumnRenamed("path", "clip_id").withColumn("clip_id", F.lit("c")).cache()
    words = spark.createDataFrame([("c", i, 0.3 * i, 0.3 * i + 0.28, True, "sentence" if i % 10 == 9 else "phrase_loose", "word", 1.0, "word") for i in range(n)],
                                  "clip_id string, i int, start_s double, end_s double, heard boolean, btype string, clean string, sim double, heard_w string")
    none = spark.createDataFrame([], "clip_id string, w string, start_s double, end_s double, i int")
    clips = spark.createDataFrame([("c", 12.0, None, 0.9, False, False)], "clip_id string, duration_s double, genre string, confidence double, rough boolean, fluency boolean")
    found = detect.detected(detect.Clips(words, frames, clips, none, none, none), flaws=("SHOUT", "PACE_FAST", "PACE_SLOW"))
    label = predict.predicted(found, clips, model.Model("free")).first()
    assert [r.flaw for r in label.what] == ["SHOUT"] and label.scores.overall < 100
    region = label.what[0]
    assert region.start_s <= 6.0 + 1e-6 and region.end_s >= 8.3 and abs(float(region.params["d"]) - 18) < 2 and region.params["tip"]
