"""Placement, pages, reports, models and prediction, sound, stitched references, calibration, retakes on small fixtures."""

import json
import math
import re

import numpy as np
import pyspark.sql.functions as F
import pytest

from tempora import queries_plans
from tempora.operators import detect, sound, stitch
from tempora.plans import baselines, calibrate, leakage, pages, people, placement, predict, report, retake
from tempora.sources import model


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=str)


# ---------------------------------------------------------------- placement


def test_jobs_and_names(spark):
    takes = placement.champions(spark.createDataFrame([("B01",), ("B05",)], "baseline_id string"))
    grid = placement.flaw_grid(takes, [3])
    assert grid.count() == 2 * (15 + 5) and placement.pure_grid(takes).count() == 2 * 75 and placement.condition_jobs(takes).count() == 12
    names = {r.tag: r.clip_id for r in placement.flaw_grid(takes, [2]).filter("take_id = 'B01-CHAMP'").collect()}
    assert names["SHOUT"] == "B01-CHAMP_C0__SHOUT_L2_s4068" and names["MULTI1"].startswith("B01-CHAMP_C0__MULTI1_L3_s")
    whole = placement.distinct_jobs(grid, placement.flaw_grid(takes, range(1, 6)))
    assert whole.count() == 2 * (75 + 5)
    pure = placement.pure_grid(takes).filter("tag = 'PURE_SHOUT' and take_id = 'B01-CHAMP'").first()
    assert pure.seed_tag == "SHOUT" and pure.pure and placement.not_done(grid, grid.filter("tag = 'FADE'")).count() == 38
    bands = spark.createDataFrame([("18",), ("26",), ("70",), ("30-45",), ("60+",)], "age string").select("age", placement.age_band(F.col("age")).alias("b"))
    assert dict(rows(bands, "age", "b")) == {"18": "18-25", "26": "26-45", "70": "65+", "30-45": "26-45", "60+": "65+"}
    counts = spark.range(200).select(placement.region_count(F.col("id")).alias("n")).distinct().collect()
    assert {r.n for r in counts} == {1, 2, 3}


def test_who_and_levels(spark):
    takes = spark.createDataFrame([("B01-CHAMP", "18-25", "Scots", "F", "corpus", "plain", "real", "N20")], "take_id string, age_band string, accent string, gender string, origin string, register string, status string, condition string")
    r = placement.who_and_where(takes).first()
    assert r.who.speaker_id == "CHAMP" and not r.who.synthetic_voice and r["where"].added_condition == "N20"
    told = spark.createDataFrame([("SHOUT", 5), ("REPEAT", 1), ("FADE", 9)], "flaw string, level int").select("flaw", placement.level_value(F.col("flaw"), F.col("level")).alias("v"))
    assert dict(rows(told, "flaw", "v")) == {"SHOUT": 12.0, "REPEAT": None, "FADE": None}


WORDS = "take_id string, i int, w string, clean string, start_s double, end_s double, punct string"


def placed_words(spark, n=30):
    return spark.createDataFrame([("t", i, f"w{i}", f"w{i}", i * 0.5, i * 0.5 + 0.4, "." if i % 5 == 4 else "") for i in range(n)], WORDS)


def test_windows_and_claims(spark):
    words, zones = placed_words(spark), spark.createDataFrame([("t", 0.0, 15.0)], "take_id string, zone_start double, zone_end double")
    clauses = placement.word_windows(words, zones, 2.0, 5.0)
    assert {(r.i0 % 5, r.i1 % 5) for r in clauses.collect()} == {(0, 4)} and clauses.count() == 6 + 5
    every = placement.word_windows(words, zones, 2.0, 5.0, prefer_clauses=False)
    assert rows(every, "i0", "i1") == sorted(((a, b) for a in range(30) for b in range(a, 30) if 2.0 <= b * 0.5 + 0.4 - a * 0.5 <= 5.0), key=str)
    picked = sorted((r.start_s, r.end_s) for r in placement.picked_windows(words, zones, 3, 2.0, 3.0).collect())
    assert len(picked) == 3 and all(b[0] - a[1] >= 0.2 for a, b in zip(picked, picked[1:]))
    wide = placement.picked_windows(words, zones, 2, 40.0, 50.0)
    assert wide.count() == 0
    assert rows(placement.word_boundaries(words, zones), "k") == sorted(((k,) for k in range(2, 27)), key=str)


def test_words_that_matter(spark):
    schema = "take_id string, i int, w string, clean string, pos string, tag string, lemma string, content boolean, btype string"
    data = [
        ("t", 0, "Three", "three", "NUM", "CD", "three", False, "phrase_tight"), ("t", 1, "cats", "cats", "NOUN", "NNS", "cat", True, "phrase_loose"), ("t", 2, "never", "never", "ADV", "RB", "never", True, "phrase_loose"),
        ("t", 3, "sit", "sit", "VERB", "VB", "sit", True, "clause_punct"), ("t", 4, "but", "but", "CCONJ", "CC", "but", False, "phrase_loose"), ("t", 5, "cats", "cats", "NOUN", "NNS", "cat", True, "phrase_loose"),
        ("t", 6, "run", "run", "VERB", "VB", "run", True, "phrase_loose"), ("t", 7, "fastest", "fastest", "ADV", "RBS", "fast", True, "sentence"), ("t", 8, "–", "", "PUNCT", ":", "-", False, "sentence"),
    ]
    words = spark.createDataFrame(data, schema)
    assert dict(rows(placement.focal_words(words), "i", "why")) == {0: "number", 1: "first mention", 2: "negation", 3: "nuclear accent", 4: "contrast", 7: "superlative"}
    prominence = spark.createDataFrame([("t", i, float(i % 4)) for i in range(9)], "take_id string, i int, prominence double")
    windows = spark.createDataFrame([("t", 0, 4, 0.0, 2.0), ("t", 4, 8, 2.0, 4.0), ("t", 5, 6, 2.5, 3.0)], "take_id string, i0 int, i1 int, start_s double, end_s double")
    best = placement.best_windows(windows, prominence, placement.focal_words(words)).orderBy("rank").collect()
    assert [(r.i0, r.words, r.score) for r in best] == [(0, [1, 2, 3], 6.0), (4, [4, 7], 3.0)]
    schwa = spark.createDataFrame([("t", i, w, w, i * 1.0, i * 1.0 + 0.2, "") for i, w in enumerate(["the", "cat", "the", "apple", "of", "a", "the"])], WORDS)
    assert [r.i for r in placement.weak_vowels(schwa, F.lit(4.4), 2).orderBy("rank").collect()] == [4, 5] and placement.weak_vowels(schwa, F.lit(0.0)).count() == 3


def test_edges_and_snippets(spark):
    words = placed_words(spark, 5)
    regions = spark.createDataFrame(
        [("c", 0, "t", "modify", "SHOUT", 0.5, 1.4), ("c", 1, "t", "modify", "SHOUT", 0.55, 1.4), ("c", 2, "t", "delete", "WORD_SKIP", 0.55, 1.4), ("c", 3, "t", "insert", "FILLER", 0.7, 0.8)],
        "clip_id string, rid int, take_id string, kind string, flaw string, baseline_start_s double, baseline_end_s double",
    )
    assert rows(placement.edges_off_words(regions, words), "rid") == [(1,)]
    gate = spark.createDataFrame([("c", 0, 15.0), ("c", 1, 3.0), ("c", 1, 4.0), ("d", 0, 13.0), ("d", 1, 20.0)], "clip_id string, attempt int, click_db double")
    assert rows(placement.join_gate(gate).filter("best"), "clip_id", "attempt", "passed") == [("c", 1, True), ("d", 0, False)]


# ---------------------------------------------------------------- pages and reports


def test_pairs_and_small_parts(spark):
    manifest = spark.createDataFrame([("B01-CHAMP_C0__SHOUT_L4_s1",), ("B01-CHAMP_C0__SHOUT_L3_s1",), ("B02-CHAMP_C0__FADE_L4_s1",)], "clip_id string")
    regions = spark.createDataFrame([("B01-CHAMP_C0__SHOUT_L4_s1", 0, 1.0, 1.1, 2.0, 3.0)], "clip_id string, rid int, start_s double, end_s double, baseline_start_s double, baseline_end_s double")
    r = pages.pairs(manifest, regions).collect()
    assert [(x.flaw, x.number, round(x.end_s, 6), x.baseline_end_s, x.clean) for x in r] == [("SHOUT", 1, 1.3, 3.0, "B01-CHAMP_C0")]
    one = spark.createDataFrame([(3, 4, 13.0, {"a": "1", "evidence": "x"}), (0, 0, 20.0, {})], "a int, b int, click double, params map<string,string>")
    assert rows(one.select(pages.told_share(F.col("a"), F.col("b")).alias("s"), pages.join_verdict(F.col("click")).alias("v"), pages.parameters(F.col("params")).alias("p")), "s", "v", "p") == [("0 of 0 (n/a)", "likely audible click", "{}"), ("3 of 4 (75%)", "listen closely", '{"a":"1"}')]
    wave = pages.waveform(spark.createDataFrame([("c", [0.1, -0.5, 0.25, 0.2])], "clip_id string, samples array<float>"), 2)
    assert rows(wave, "bin", "low", "high") == [(0, -1.0, 0.2), (1, 0.4, 0.5)]
    frames = spark.createDataFrame([("c", i, None if i == 5 else i / 3) for i in range(11)], "clip_id string, frame_i int, f0_st double")
    assert rows(pages.every_nth(frames, "f0_st"), "i", "v") == [(0, 0.0), (1, None), (2, 3.33)]


REGIONS = "clip_id string, rid int, flaw string, category string, level int, start_s double, end_s double"


def test_reports(spark):
    truth = spark.createDataFrame([("a", 0, "SHOUT", "Volume", 3, 1.0, 2.0), ("a", 1, "FADE", "Volume", 2, 5.0, 6.0), ("b", 0, "UPTALK", "Intonation", 1, 1.0, 2.0)], REGIONS)
    found = spark.createDataFrame([("a", 0, "SHOUT", "Volume", 3, 1.1, 2.0), ("a", 1, "SLUR", "Clarity", 2, 5.0, 6.0), ("c", 0, "SHOUT", "Volume", 2, 0.0, 1.0)], REGIONS)
    clips = spark.createDataFrame([("a", 60.0), ("b", 60.0), ("c", 30.0)], "clip_id string, duration_s double")
    told = dict(rows(report.summary(truth, found, clips), "measure", "value"))
    assert abs(told["flaw_f1@0.5"] - 1 / 3) < 1e-9 and told["category_accuracy"] == 0.5 and told["false_flags_per_minute"] == 2.0 and abs(told["start_ms"] - 100) < 1e-6 and told["end_ms"] == 0
    assert abs(told["onset_f1"] - 1 / 3) < 1e-9
    head = dict(rows(report.headline(truth, found, clips, disabled=("SLUR",)), "measure", "value"))
    assert abs(head["flaw_f1@0.5"] - 0.5) < 1e-9
    passes = dict(rows(report.passed(report.summary(truth, report.oracle(truth), clips)), "measure", "passes"))
    assert passes["flaw_f1@0.5"] and passes["start_ms"] and passes["category_accuracy"] and report.nothing(truth).count() == 0
    scores = spark.createDataFrame([("X", k, 90.0 - k) for k in range(1, 6)] + [("Y", k, 50.0 + k) for k in range(1, 6)] + [("Z", 1, 1.0)], "flaw string, level int, overall double")
    dose = {r.flaw: (round(r.rho, 2), r.failing) for r in report.dose_response(scores, spark.createDataFrame([(100.0,)], "clean double")).collect()}
    assert dose["X"] == (-1.0, False) and dose["Y"][1] and "Z" not in dose
    one = report.acceptance(spark.createDataFrame([(2.0,), (1.0,)], "worst_shift double"), spark.createDataFrame([(1.0,), (4.0,)], "lost_elsewhere double"), 0.4).first()
    assert one.invariance_passes and not one.locality_passes and one.mean_loss == 2.5
    agree = report.score_agreement(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "clip string, overall double"), spark.createDataFrame([("a", 2), ("a", 4), ("b", 5), ("c", 9)], "clip string, score int")).first()
    assert agree.rho == 1.0 and agree.n == 3


# ---------------------------------------------------------------- models and prediction


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("model")
    clf = {"w": [1.0, -2.0], "b": 0.5, "mean": [0.0, 1.0], "std": [1.0, 1e-9]}
    (at / "model.json").write_text(json.dumps({
        "same": {"thresholds": {"shout_db": 5}, "isotonic": {"SHOUT": {"x": [1, 3], "y": [2, 4]}}, "reliability": {"SHOUT": 0.5}, "repeat_clf": clf},
        "free": {"thresholds": {"shout_db": 6.5}, "disabled": ["SLUR"], "reliability": {}},
    }))
    (at / "norms.json").write_text(json.dumps({"dur_model": {"coef": [0.1, 0.2], "features": ["a", "b"]}, "pause": {"sentence": {"median": 0.53}}, "final_rise": {"median": -0.3}}))
    (at / "rubric.json").write_text(json.dumps({"tau": 20, "bands": {"polished": 95, "strong": 80, "noticeable": 50}, "genre_weights": {"x": {"Volume": 1.0}}}))
    return at


def test_models(spark, files):
    m = model.load_model(spark, str(files / "model.json"), "same")
    assert m.thresholds["shout_db"] == 5 and m.thresholds["pace_fast"] == 1.12 and m.knots == (("SHOUT", 1.0, 2.0), ("SHOUT", 3.0, 4.0)) and m.repeats.features == ("change", "voiced")
    free = model.load_model(spark, str(files / "model.json"), "free")
    assert free.thresholds["shout_db"] == 6.5 and free.thresholds["lost_frac"] == 0.25 and free.disabled == ("SLUR",)
    assert model.load_model(spark, str(files / "model.json"), "cross").knots == m.knots  # as same, where a mode has none
    every = model.models(spark, str(files / "model.json"))
    assert rows(model.thresholds(every), "mode", "key", "value") == [("free", "shout_db", 6.5), ("same", "shout_db", 5.0)] and rows(model.disabled(every), "mode", "flaw") == [("free", "SLUR")]
    assert rows(model.knots(every), "flaw", "x", "y") == [("SHOUT", 1.0, 2.0), ("SHOUT", 3.0, 4.0)] and rows(model.reliabilities(every), "flaw", "reliability") == [("SHOUT", 0.5)]
    norms = model.load_norms(spark, str(files / "norms.json"))
    assert norms == detect.Norms(0.53, -0.3, -1.0, (0.1, 0.2))
    rubric = model.load_rubric(spark, str(files / "rubric.json"))
    assert rubric.scale == 20 and rubric.bands[0] == ("polished", 95.0) and rubric.areas == {"x": {"Volume": 1.0}} and rubric.exponent == 2.0


FOUND = "clip_id string, flaw string, start_s double, end_s double, d double, w0 int, w1 int, facts map<string, string>"


def test_predicted_labels(spark):
    """The golden score of the usual rubric: a lone bad pause in a minute of reading."""
    rubric = model.SPEECH
    found = spark.createDataFrame([("c", "PAUSE_BAD", 36.071, 37.045, 3.0, 4, 5, {"boundary": "phrase_tight"}), ("c", "UPTALK", 50.0, 51.0, 3.0, 9, 9, {})], FOUND)
    clips = spark.createDataFrame([("c", 60.0, "interpretive reading", 0.9, False, True), ("d", 60.0, None, 0.9, False, True)], "clip_id string, duration_s double, genre string, confidence double, rough boolean, fluency boolean")
    words = spark.createDataFrame([("c", i, f"w{i},") for i in range(12)], "clip_id string, i int, w string")
    m = model.Model("free", reliability={"PAUSE_BAD": 0.792})
    made = {r.clip_id: r for r in predict.predicted(found, clips, m, rubric, words).collect()}
    c, d = made["c"], made["d"]
    assert [r.flaw for r in c.what] == ["PAUSE_BAD"] and c.scores.categories["Pausing"] == round(100 * math.exp(-3.0 * 0.9 * 0.79 * 9 / 35), 1) and c.scores.band == "strong"
    assert c.what[0].params == {"boundary": "phrase_tight", "d": "3.0", "tip": retake.TIPS["PAUSE_BAD"]} and c.what[0].explanation == "A pause of 3.0 s breaks “w4 w5”." and c.what[0].points_lost > 8 and c.scores.reference_mode == "reference-free"
    assert d.what == [] and d.scores.overall == 100.0 and d.scores.band == "polished"
    rough = predict.predicted(found, clips.withColumn("rough", F.lit(True)), m, rubric).filter("clip_id = 'c'").first()
    assert rough.scores.overall > c.scores.overall
    assert len(predict.predicted(found, clips, m, rubric, experimental=True).filter("clip_id = 'c'").first().what) == 2
    of_clips = spark.createDataFrame([("c", 21.5, "good")], "clip_id string, snr_db double, badge string")
    whole = {r.clip_id: r for r in predict.predicted(found, clips, m, rubric, quality=of_clips, references=spark.createDataFrame([("c", "stitch:B01", 12)], "clip_id string, baseline_id string, common_words int")).collect()}
    assert (whole["c"].quality.badge, whole["c"].reference.baseline_id, whole["d"].quality, whole["d"].reference) == ("good", "stitch:B01", None, None)
    again = predict.rescored(predict.predicted(found, clips, m, rubric), clips, rubric).filter("clip_id = 'c'").first()
    assert again.overall == c.scores.overall


def test_ends_that_no_reference_covers_are_cut(spark):
    audio = spark.createDataFrame([("a", "t", 10, [0.5] * 100), ("b", "whole", 10, [0.5] * 100), ("c", "none", 10, [0.5] * 7)], "clip_id string, text_id string, sr int, samples array<float>")
    words = spark.createDataFrame([(t, i, float(i + 1)) for t in ("t", "whole") for i in range(10)], "text_id string, i int, end_s double")
    covered = spark.createDataFrame([("t", 4), ("whole", 9), ("none", -1)], "text_id string, covered_to int")
    assert {r.clip_id: len(r.samples) for r in predict.covered_audio(audio, words, covered).collect()} == {"a": 65, "b": 100, "c": 7}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan"), None), ("b", 1.5, "x")], "k string, v double, t string")
    model.write_csv(model.without_nan(df), str(tmp_path / "csv"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "csv")), "k", "v") == [("a", None), ("b", "1.5")]
    model.write_labels(model.without_nan(df), str(tmp_path / "json"))
    assert rows(spark.read.json(str(tmp_path / "json")), "k", "v") == [("a", None), ("b", 1.5)]
    (tmp_path / "x.bin").write_bytes(b"abc")
    r = model.checksums(spark, str(tmp_path), "x.bin").first()
    assert r.name == "x.bin" and r.sha256.startswith("ba7816bf") and len(r.id) == 16


# ---------------------------------------------------------------- sound

SR = 16000


def tone(seconds, hz=200, level=0.3):
    return level * np.sin(2 * np.pi * hz * np.arange(int(seconds * SR)) / SR)


def audio_of(spark, **clips):
    return spark.createDataFrame([(k, SR, [float(v) for v in x]) for k, x in clips.items()], "path string, sr int, samples array<float>")


def test_quality_and_conditions(spark):
    r = np.random.default_rng(0)
    quiet = 0.001 * r.normal(size=2 * SR)
    speech = np.concatenate([quiet[:SR], tone(1.0), quiet[SR : SR + SR // 2], tone(1.0), quiet[:SR]])
    loud = np.clip(8 * speech, -1, 1)
    q = {x.path: x for x in sound.quality(audio_of(spark, fine=speech, clipped=loud)).collect()}
    assert q["fine"].snr_db > 30 and q["fine"].clipped == 0 and q["clipped"].clipped > 0.2 and q["clipped"].badge == "poor" and 180 < q["fine"].bandwidth_hz < 260
    n = {x.path: x for x in sound.normalised(audio_of(spark, fine=speech)).collect()}["fine"]
    d = sound.frame_levels(np.asarray(n.samples), SR)
    assert abs(10 * np.log10(np.mean(10 ** (d[d > np.percentile(d, 95) - 25] / 10))) - sound.TARGET_DB) < 0.1
    c = sound.conditions(audio_of(spark, fine=speech)).first()
    assert -63 < c.floor_db < -57 and -64 < c.room_db < -57 and c.offset_drop_db > 30 and 150 < c.low_hz < 200
    edges = sound.silence_edges(audio_of(spark, fine=speech)).collect()
    assert [(round(e.start_s, 1), round(e.end_s, 1)) for e in edges] == [(2.0, 2.5)]


def test_joins(spark):
    clean = np.concatenate([0.0001 * np.random.default_rng(2).normal(size=SR // 4), tone(1.75)])
    broken = clean.copy()
    broken[SR:] = np.concatenate([clean[SR + 37 :], np.zeros(37)])
    as_clip = lambda x: spark.createDataFrame([("c", SR, [float(v) for v in x])], "clip_id string, sr int, samples array<float>")
    points = spark.createDataFrame([("c", 0, "start", 1.0, 1.0), ("c", 1, "start", 0.5, 0.5), ("c", 2, "start", 0.01, 0.01)], "clip_id string, rid int, edge string, t_before double, t_after double")
    found = {r.rid: r for r in sound.join_clicks(points, as_clip(clean), as_clip(broken)).collect()}
    assert set(found) == {0, 1} and found[0].click_db > 10 and found[1].click_db < 1e-6
    at = points.select("clip_id", "rid", "edge", F.col("t_after").alias("t"))
    f = {r.rid: r for r in sound.edge_features(at.filter("rid < 2"), as_clip(broken)).collect()}
    assert f[0].click_db > f[1].click_db and f[0].flux_peak > f[1].flux_peak and f[1].repetition > 0.99
    region = spark.createDataFrame([("c", 0, 0.2, 0.8, 0.2, 0.8), ("c", 1, 0.2, 0.8, 0.2, 1.8)], "clip_id string, rid int, start_s double, end_s double, baseline_start_s double, baseline_end_s double")
    assert [(r.rid, r.timbre_db) for r in sound.timbre_shift(region, as_clip(clean), as_clip(clean)).collect()] == [(0, 0.0)]
    assert sound.timbre_shift(region, as_clip(clean), as_clip(tone(2.0, 900))).first().timbre_db > 3


def test_leakage_audit(spark):
    r = np.random.default_rng(1)

    def some(n, shift, split, speaker):
        return [(split, speaker, "SHOUT", *[float(v) for v in r.normal(size=4) + [shift, 0, 0, 0]]) for _ in range(n)]

    schema = "split string, speaker string, flaw string, click_db double, floor_step_db double, flux_peak double, repetition double"
    edited = spark.createDataFrame(some(40, 3, "train", "A") + some(20, 3, "test", "B"), schema)
    natural = spark.createDataFrame(some(40, 0, "train", "A") + some(20, 0, "test", "B"), schema)
    told = leakage.windows(edited, natural)
    first = {x.scope: x for x in leakage.audit(leakage.by_split(told, trees=5)).collect()}
    assert first["ALL"].auc > 0.9 and not first["ALL"].passes and first["SHOUT"].n_pos == 20
    speakers = leakage.audit(leakage.by_speaker(told, trees=3))
    assert speakers.filter("scope = 'ALL'").first().n_pos == 60 and leakage.compared(leakage.audit(leakage.by_split(told, trees=3)), speakers).count() == 2
    edges = spark.createDataFrame([("c", 0, "start", 1.0, 1.5), ("c", 1, "start", 2.0, 2.5)], "clip_id string, rid int, edge string, t_before double, t_after double")
    of = spark.createDataFrame([("c", 0, "SHOUT", "t"), ("c", 1, "PAUSE_BAD", "t")], "clip_id string, rid int, flaw string, take_id string")
    points = leakage.paired_points(edges, of, spark.createDataFrame([("t", "start", 7.0)], "take_id string, edge string, t double"), spark.createDataFrame([("c", "start", 2.6), ("c", "end", 2.5)], "clip_id string, edge string, t double"))
    assert rows(points, "rid", "t_edit", "t_natural") == [(0, 1.5, 1.0), (1, 2.6, 7.0)]


# ---------------------------------------------------------------- stitched references

READ = "text_id string, i int, clean string, start_s double, end_s double, sent_end boolean"


def reading(text_id, sentences):
    out, t = [], 0.5
    for s in sentences:
        for k, w in enumerate(s.split()):
            out.append((text_id, len(out), w, t, t + 0.3, k == len(s.split()) - 1))
            t += 0.3
        t += 0.4
    return out


def test_stitched_references(spark):
    a, b, c, d = "please call stella now", "ask her to bring these things", "six spoons of fresh snow peas", "we also need a small plastic snake"
    words = spark.createDataFrame(reading("B01", [a, b, c, d]) + reading("B02", [b, a]) + reading("B03", [c, "ask her to bring the things", a, d]) + reading("B05", [a, b, c, d]), READ)
    speakers = ["B01", "B02", "B03", "B05"]
    sentences = stitch.sentences_of(words)
    pairs = stitch.sentence_pairs(sentences, speakers, avoid=["B05"]).cache()
    chosen = stitch.chosen_sentences(pairs.filter("text_id = 'B01'"), speakers)
    assert rows(chosen, "s", "other", "s2") == [(0, "B03", 2), (1, "B02", 0), (2, "B03", 0), (3, "B03", 3)]  # only a full match beats the leading voice
    durations = words.groupBy("text_id").agg((F.max("end_s") + 0.5).alias("duration_s"))
    pieces, made = stitch.stitched(chosen, sentences, words, durations)
    spoken = [r.clean for r in made.orderBy("i").collect()]
    assert spoken == f"{a} {b} {c} {d}".split() and all(x <= y for x, y in zip([r.start_s for r in made.orderBy("i").collect()], [r.start_s for r in made.orderBy("i").collect()][1:]))
    p = pieces.orderBy("s").collect()
    assert p[0].at_s == 0 and all(abs(y.at_s - (x.at_s + x.to_s - x.from_s)) < 1e-9 for x, y in zip(p, p[1:]))
    cover = stitch.coverage(chosen, sentences.filter("text_id = 'B01'")).first()
    assert cover.sources == ["B02", "B03"] and cover.n_sentences == 4 and cover.covered_to == words.filter("text_id = 'B01'").count() - 1
    assert rows(stitch.panel(pairs.filter("text_id = 'B01'"), speakers), "member") == [("B03",)]
    alone = stitch.chosen_sentences(pairs.filter("text_id = 'B01'"), speakers, primary="B02")
    assert rows(alone, "s", "other") == [(0, "B02"), (1, "B02")] and stitch.coverage(alone, sentences.filter("text_id = 'B01'")).first().covered_to == 9
    prefixes = stitch.common_prefix(words, speakers)
    assert {(r.text_id, r.other): r.n for r in prefixes.collect()}[("B01", "B05")] == 23
    assert rows(stitch.closest_text(prefixes.filter("text_id = 'B01'"), speakers, avoid=["B01"]), "other", "n") == [("B05", 23)]


# ---------------------------------------------------------------- calibration and retakes


def test_calibration(spark):
    rows_ = [(float(i % 7), 5.0, int(i % 7 > 3)) for i in range(70)]
    c = calibrate.classifier(spark.createDataFrame(rows_, "a double, b double, hit int"), ["a", "b"], "hit")
    assert c.weights[0] > 0 and c.weights[1] == 0.0
    p = spark.createDataFrame([(6.0, 5.0), (0.0, 5.0)], "a double, b double").select(c.probability().alias("p")).collect()
    assert p[0].p > 0.5 > p[1].p
    assert calibrate.descended(lambda t: -abs(t["x"] - 3) - abs(t["y"] - t["x"]), {"x": 0, "y": 9}, {"x": [1, 2, 3], "y": [1, 3, 5]}) == {"x": 3, "y": 3}
    assert abs(calibrate.usual_cost(spark.createDataFrame([(v / 10,) for v in range(5)], "path_cost double")) - 0.3) < 1e-9 and calibrate.usual_cost(spark.createDataFrame([(0.001,)], "path_cost double")) == 0.02
    base = spark.createDataFrame([("X", 10.0), ("X", 12.0), ("Y", 0.5), ("X", 8.0)], "flaw string, cost double")
    scored = lambda w: base.join(w, "flaw").withColumn("overall", 100 - F.col("cost") * F.col("weight"))
    got = calibrate.level_weights(scored, ["X", "Y", "Z"], spark)
    assert got["X"] == 4.0 and got["Y"] == 8.0 and got["Z"] == 1.0
    assert rows(calibrate.unusable(spark.createDataFrame([("A", 0.05), ("B", 0.5), (None, 0.01)], "flaw string, f1 double")), "flaw") == [("A",)]


def test_duration_model(spark):
    words = [("c", w, 0.0, math.exp(0.2 * len(w) + (0.3 if b == "sentence" else 0.0) - 2), b) for w, b in [("a", "phrase_tight"), ("cat", "sentence"), ("banana", "phrase_tight"), ("the", "phrase_loose"), ("elephants", "clause_punct"), ("dog", "sentence"), ("queue", "phrase_tight")] for _ in range(30)]
    df = spark.createDataFrame(words, "clip_id string, clean string, start_s double, end_s double, btype string")
    coef = calibrate.duration_model(df, ridge=1e-6)
    x = np.array([[r[f"x{k}"] for k in range(6)] for r in df.select(*[p.cast("double").alias(f"x{k}") for k, p in enumerate(detect.duration_parts())]).collect()])
    y = np.log([max(e, 0.03) for _, _, _, e, _ in words])
    assert np.allclose(x @ np.array(coef), y - np.median(y), atol=1e-3)


def test_retake_parts(spark):
    windows = spark.createDataFrame([("c", k) for k in range(20)], "clip_id string, w0 int")
    assert retake.first_windows(windows).agg(F.max("w0")).first()[0] == 13
    words = spark.createDataFrame([("c", 0, i, i in (2, 3), i * 0.1, i * 0.1 + 0.1) for i in range(6)], "clip_id string, rid int, i int, flagged boolean, start_s double, end_s double")
    levels = spark.createDataFrame([("c", 0, f, -10.0 if 20 <= f < 40 else -30.0) for f in range(60)], "clip_id string, rid int, frame_i int, level double")
    assert abs(retake.word_level(words, levels).first().spread - 20) < 1e-9
    assert retake.word_level(words.filter("i < 5"), levels).first().spread == 20 and retake.word_level(words.filter("i < 4"), levels).first().spread is None
    regions = spark.createDataFrame([("c", 0, "PAUSE_LOST", 3, 3), ("c", 1, "SHOUT", 5, 5), ("c", 2, "UPTALK", 1, 1)], "clip_id string, rid int, flaw string, w0 int, w1 int")
    spoken = spark.createDataFrame([("c", i, f"w{i}", i * 1.0, i + 0.6) for i in range(6)], "clip_id string, i int, w string, start_s double, end_s double")
    phrases = retake.first_pause(retake.phrase_of(regions, spoken), spoken).orderBy("rid").collect()
    assert [(p.a, p.b, p.text, round(p.first, 6), p.measure.key) for p in phrases] == [(0, 3, "w0 w1 w2 w3", 0.4, "pause_end"), (2, 5, "w2 w3 w4 w5", 1.0, "spread")]


# ---------------------------------------------------------------- baselines and people


def test_baseline_audit(spark):
    words = spark.createDataFrame([("t", i, w, w, "," if w == "call" else "", i * 1.0, i + 0.5) for i, w in enumerate("please call stella now and ask her very very well".split())], "take_id string, i int, w string, clean string, punct string, start_s double, end_s double")
    said = "please um call stellar now ask her her very very well".split()
    heard = spark.createDataFrame([("t", j, w, j * 0.9) for j, w in enumerate(said)], "take_id string, j int, w string, start_s double")
    pairs = [(0, 0), (None, 1), (1, 2), (2, 3), (3, 4), (4, None), (5, 5), (6, 6), (None, 7), (7, 8), (8, 9), (9, 10)]
    aligned = spark.createDataFrame([("t", k, i, j) for k, (i, j) in enumerate(pairs)], "take_id string, step int, ref_i int, hyp_j int")
    found = baselines.misreadings(words, heard, aligned)
    assert rows(found, "kind", "time_s", "reference", "heard") == [("extra words", 6.3, "", "her"), ("filler", 0.9, "", "um"), ("misread / ASR mismatch", 2.7, "stella", "stellar"), ("skipped word(s)", 4.0, "and", "")]
    assert rows(baselines.doubled(heard, words), "heard", "time_s") == [("her her", 5.4)]
    prompted = spark.createDataFrame([("t", "um", 1.2), ("t", "uh", 5.0), ("t", "no", 6.0)], "take_id string, w string, start_s double")
    assert rows(baselines.biased_fillers(prompted, found), "heard", "time_s") == [("uh", 5.0)]
    gaps = baselines.long_gaps(words)
    assert {r.kind for r in gaps.collect()} == {"long pause (minor)"} and gaps.count() == 8
    takes = spark.createDataFrame([("t", 10, 0.0, 30.0, False), ("u", 10, 0.0, 30.0, True), ("v", 10, 0.01, 30.0, True), ("w", 10, 0.0, 30.0, False)], "take_id string, n_words int, clipped double, snr_db double, spontaneous boolean")
    issues = found.unionByName(found.filter("kind = 'filler'").withColumn("take_id", F.lit("u")))
    assert rows(baselines.verdicts(takes, issues), "take_id", "status", "fillers", "disfluencies", "mismatch") == [("t", "FAIL", 1, 0, 0.2), ("u", "NATURAL", 1, 1, 0.0), ("v", "FAIL", 0, 0, 0.0), ("w", "PASS", 0, 0, 0.0)]
    back = spark.createDataFrame([("c", 0, j, w) for j, w in enumerate("call stella now".split())] + [("c", 1, j, w) for j, w in enumerate("call now".split())], "clip_id string, rid int, j int, w string")
    at = spark.createDataFrame([("c", 0, "t", 2), ("c", 1, "t", 2)], "clip_id string, rid int, take_id string, k int")
    assert rows(baselines.words_put_back(at, words, back), "rid", "gone") == [(0, "stella")]


def test_corpus_pieces(spark):
    names = spark.createDataFrame([("12_S0042_chunk_0.wav", " a  b", 3.0), ("12_S0042_chunk_1.wav", "c\n", 4.0), ("12_S0042_chunk_3.wav", "d", 4.0), ("odd.wav", "x", 1.0)], "path string, text string, duration_s double")
    pieces = baselines.recordings_of_name(names).filter("speaker_id is not null")
    assert rows(baselines.missing_chunks(pieces), "speaker_id") == [("S0042",)]
    taken = baselines.pieces_of(pieces, 6.0, 0.5)
    assert rows(taken, "number", "at_s") == [(0, 0.0), (1, 3.5)] and rows(baselines.texts_of(taken), "text", "duration_s") == [("a b c", 7.0)]
    frames = spark.createDataFrame([("p", i, 0.0 if 50 <= i < 150 else -60.0) for i in range(200)], "path string, frame_i int, level double")
    r = baselines.trimmed(frames).first()
    assert abs(r.from_s - 0.2) < 1e-9 and abs(r.to_s - 1.81) < 1e-9


def test_people(spark, tmp_path):
    mark = "array<struct<t_s: double, area: string>>"
    saved = spark.createDataFrame([("ann", "h1", [(2.34567, "Volume"), (1.0, "Pacing")], 7, " ok ", "2024-01-02"), ("ann", "h1", [], 3, None, "2024-01-01"), ("bob", "h9", [(1.0, "Colour")], 11, None, "2024-01-01")], f"rater string, clip string, marks {mark}, score_1_10 int, note string, timestamp string")
    clips = spark.createDataFrame([("h1",), ("h2",)], "clip string")
    assert rows(people.problems(saved, clips), "rater", "wrong") == [("bob", ["clip", "score", "area"])]
    kept = people.cleaned(saved.filter("rater = 'ann'")).first()
    assert [tuple(m) for m in kept.marks] == [(1.0, "Pacing"), (2.346, "Volume")] and kept.note == "ok" and kept.score_1_10 == 7
    (tmp_path / "labels_ann.json").write_text(json.dumps({"rater": "ann", "labels": {"h1": {"clip": "h1", "marks": [{"t_s": 1.5, "area": "Pacing"}], "score_1_10": 4}}}))
    read = people.labels(spark, str(tmp_path))
    assert rows(people.marks_of(read), "rater", "clip", "mark_id", "t_s", "area") == [("ann", "h1", 0, 1.5, "Pacing")]
    told = people.clips_for(clips, spark.createDataFrame([("Ann ",), ("ann",)], "name string"), read)
    assert sorted(r.place for r in told.collect()) == [1, 2] and {r.clip for r in told.filter("done").collect()} == {"h1"}
    flags = spark.createDataFrame([("f1",), ("f2",)], "flag string")
    verdicts = spark.createDataFrame([("ann", "f1", "agree", 1), ("ann", "f1", "unsure", 2), ("bob", "f2", "agree", 1)], "reviewer string, flag string, verdict string, timestamp int")
    assert rows(people.to_review(flags, verdicts, "ann"), "flag", "verdict") == [("f1", "unsure"), ("f2", None)]
    hidden = people.hidden_set(spark.createDataFrame([("a",), ("b",)], "clip_id string"), spark.createDataFrame([("c",)], "clip_id string"))
    assert sorted(r.name for r in hidden.collect()) == ["h01.flac", "h02.flac", "h03.flac"] and hidden.filter("hidden").count() == 1


# ---------------------------------------------------------------- places of flaws

TAGGED = (
    "take_id string, i int, w string, clean string, punct string, start_s double, end_s double, pos string, tag string, lemma string, content boolean, function boolean, reducible boolean, btype string, zipf double"
)
POS = {"the": "DET", "of": "ADP", "and": "CCONJ", "is": "AUX"}


def tagged_takes(spark):
    text = "the form of the house is old, and the farmers of the valley saw the light, and the horses ran. " * 3 + "the people of the small town is happy, and the bureaucrats of the town sang. from the forest came the sound of the bells, and the people is glad."
    words, t = [], 0.5
    for i, w in enumerate(text.split()):
        clean, punct = w.strip(",."), w[-1] if w[-1] in ",." else ""
        small = clean in POS
        kind = "sentence" if punct == "." else "clause_punct" if punct else "phrase_tight" if small else "phrase_loose"
        words.append(("t", i, w, clean, punct, t, t + 0.25, POS.get(clean, "NOUN"), "X", clean, not small, small, clean in ("the", "of", "and"), kind, 3.0 if clean in ("bureaucrats", "forest") else 5.0))
        t += 0.25 + (0.4 if punct else 0.02)
    frames = [("t", f, 4 * math.sin(f / (3 if f % 1000 < 500 else 30)), 0.0, -10.0 + (f % 7), True) for f in range(int(t * 100) + 50)]
    from tempora.plans import flaws

    return flaws.Takes(
        spark.createDataFrame(words, TAGGED), spark.createDataFrame([("t", 0.0, t + 1)], "take_id string, zone_start double, zone_end double"),
        spark.createDataFrame(frames, "clip_id string, frame_i int, f0_st double, inten double, hf double, voiced boolean"), spark.createDataFrame([("t", i, float(i % 5)) for i in range(len(words))], "take_id string, i int, prominence double"),
    ), words


@pytest.mark.parametrize("flaw", placement.FLAWS)
def test_places_of_every_flaw(spark, flaw):
    from tempora.plans import flaws

    t, words = tagged_takes(spark)
    places = sorted((r.start_s, r.end_s, r.w0, r.w1, r.why) for r in flaws.placed(t, flaw, 3).collect())
    assert 1 <= len(places) <= 3 and all(b[0] >= a[1] for a, b in zip(places, places[1:]))
    assert places == sorted((r.start_s, r.end_s, r.w0, r.w1, r.why) for r in flaws.placed(t, flaw, 3).collect())
    for start, end, w0, w1, why in places:
        first, last = words[w0], words[w1]
        if flaw in ("PACE_FAST", "PACE_SLOW", "MONOTONE", "SLUR", "EMPH_FLAT", "SHOUT"):
            low, high = flaws.LENGTHS[flaw]
            assert start == first[5] and end == last[6] and 0.7 * low - 1e-6 <= end - start <= 1.3 * high + 1e-6
        elif flaw in ("UPTALK", "FADE"):
            assert last[4] == "." and end == last[6] and w1 - w0 >= (2 if flaw == "UPTALK" else 1)
        elif flaw == "PAUSE_BAD":
            assert first[13] == "phrase_tight" and why.startswith("inside a tight phrase") and first[6] <= start <= last[5]
        elif flaw == "PAUSE_LOST":
            assert first[4] and first[6] <= start <= last[5]
        elif flaw == "REPEAT":
            assert words[w0 - 1][13] in flaws.OPENERS and first[11]
        elif flaw == "RARE_HESIT":
            assert first[3] in ("bureaucrats", "forest")
        elif flaw == "WORD_SKIP":
            assert first[7] in flaws.SKIPPED and not first[4]
        elif flaw == "WORD_SWAP":
            assert first[10] and "misread '" + first[3] in why
    told = flaws.labelled(flaws.placed(t, flaw, 1), 4).first()
    assert told.category == detect.CATEGORY[flaw] and told.level == 4


def test_numbers(spark):
    from tempora.functions import numbers

    df = spark.createDataFrame([([0.5, -0.5, 1.0, 0.0], float("inf"), "a", 1)], "x array<float>, v double, k string, n int")
    r = df.select(
        numbers.root_mean_square(F.col("x")).alias("rms"), numbers.stretch_of(F.col("x"), F.lit(0.1), F.lit(0.3), 10).alias("s"), numbers.fitted(F.col("x"), F.lit(6)).alias("f"), numbers.shown(F.col("v")).alias("v"),
        numbers.sample_of(F.lit(0.25), 10).alias("even"), numbers.request_key(F.col("k"), F.col("n")).alias("key"), numbers.root_mean_square(F.array().cast("array<float>")).alias("none"),
    ).first()
    assert abs(r.rms - (1.5 / 4) ** 0.5) < 1e-6 and r.s == [-0.5, 1.0] and r.f == [0.5, -0.5, 1.0, 0.0, 0.0, 0.0] and r.v is None and r.even == 2 and len(r.key) == 20 and r.none == 1e-9


def test_warping_joins_clips_and_not_frames(spark):
    """Frames without a path, beyond the reference, and between unsorted knots; only clips are dealt out."""
    path = spark.createDataFrame([("a", 4.0, 6), ("a", 2.0, 6), ("a", 0.0, 2), ("b", 50.0, 3), ("c", -2.0, 0)], "clip_id string, ref_frame double, par_frame int")
    own = spark.createDataFrame([(c, i) for c in "abcd" for i in (7, 2, 3, 4, 0)], "clip_id string, frame_i int")
    reference = spark.createDataFrame([(c, i, 10.0 * i) for c in "abd" for i in (3, 0, 1, 2)], "clip_id string, frame_i int, v double")
    got = pages.warped(path, reference, own, "v")
    want = {("a", 7): 30.0, ("a", 2): 0.0, ("a", 3): 10.0, ("a", 4): 20.0, ("a", 0): 0.0}
    assert {(r.clip_id, r.frame_i): r.v for r in got.collect()} == {(c, i): want.get((c, i)) for c in "abcd" for i in (7, 2, 3, 4, 0)}
    assert "frame_i" not in "".join(line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line)


def test_lines_are_dealt_out_before_they_are_grouped(spark, sf_dir):
    plan = queries_plans.filtered_events(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(\w+#\d+L?, \w+#\d+, \d+\), ENSURE_REQUIREMENTS[^\n]*\n[^\n]*HashAggregate\([^\n]*partial_min", plan)
