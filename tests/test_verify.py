"""Times through edits, measures of injected flaws and their dose, and matched conditions."""

import numpy as np
import pandas as pd
import pytest

from tempora.operators import sound
from tempora.plans import verify

SR = 16000


def as_clips(spark, clips):
    return spark.createDataFrame(pd.DataFrame({"clip_id": list(clips), "sr": SR, "samples": [np.asarray(x, np.float32).tolist() for x in clips.values()]}), "clip_id string, sr int, samples array<float>")


def tone(hz, seconds, gain=1.0):
    t = np.arange(int(seconds * SR)) / SR
    phase = 2 * np.pi * np.cumsum(np.broadcast_to(hz, t.shape)) / SR
    return gain * (0.5 * np.sin(phase) + 0.3 * np.sin(2 * phase) + 0.1 * np.sin(17 * phase))


def test_times_go_through_edits_and_back(spark):
    edits = spark.createDataFrame([("c", 10.0, 20.0, 5.0), ("c", 30.0, 30.0, 4.0), ("c", 40.0, 45.0, 0.0)], "clip_id string, a double, b double, n double")
    points = spark.createDataFrame([(c, t) for c in ("c", "d") for t in (0.0, 10.0, 15.0, 20.0, 29.0, 30.0, 42.0, 45.0, 60.0)], "clip_id string, t double")
    there = verify.to_new(points, edits)
    want = {0.0: 0.0, 10.0: 10.0, 15.0: 12.5, 20.0: 15.0, 29.0: 24.0, 30.0: 29.0, 42.0: 39.0, 45.0: 39.0, 60.0: 54.0}
    assert {(r.clip_id, r.t): r.new_t for r in there.collect()} == {**{("c", t): v for t, v in want.items()}, **{("d", t): t for t in want}}
    back = {(r.clip_id, r.t): r.old_t for r in verify.to_old(there, edits, at="new_t").collect()}
    assert all(v == (45.0 if k == ("c", 42.0) else k[1]) for k, v in back.items())


def test_measures_of_flaws_by_sound_and_by_times(spark):
    flat, moving = np.full(2 * SR, 160.0), 160 + 60 * np.sin(np.arange(2 * SR) / SR * 3)
    fading = np.linspace(0, -20, 2 * SR)
    lows = np.sin(2 * np.pi * 200 * np.arange(2 * SR) / SR)
    hiss = 0.1 * np.random.default_rng(1).normal(size=2 * SR)
    before = {"MONOTONE": tone(moving, 2), "SHOUT": tone(flat, 2), "FADE": tone(flat, 2), "SLUR": lows + hiss, "UPTALK": tone(flat, 2), "EMPH_FLAT": tone(moving, 2), "quiet": np.zeros(2 * SR)}
    after = {"MONOTONE": tone(flat, 2), "SHOUT": tone(flat, 2, 10 ** (6 / 20)), "FADE": tone(flat, 2) * 10 ** (fading / 20), "SLUR": lows + 0.5 * hiss,
             "UPTALK": tone(np.where(np.arange(2 * SR) > 1.7 * SR, 160 * 2 ** (4 / 12), 160.0), 2), "EMPH_FLAT": tone(flat, 2), "quiet": np.zeros(2 * SR)}
    rows = [(c, 0, "MONOTONE" if c == "quiet" else c, 3, 0.0, 2.0, 0.0, 2.0) for c in before]
    rows += [("t", k, f, 2, 1.0, 1.5, 1.0, 2.0) for k, f in enumerate(("PACE_FAST", "PAUSE_BAD", "PAUSE_LOST", "RARE_HESIT", "WORD_SKIP", "WORD_SWAP"))]
    regions = spark.createDataFrame(rows, "clip_id string, rid int, flaw string, level int, start_s double, end_s double, baseline_start_s double, baseline_end_s double")
    got = {(r.clip_id, r.flaw): (r.value, r.unit) for r in verify.measures(regions, as_clips(spark, before), as_clips(spark, after)).collect()}
    assert len(got) == len(rows) and got["quiet", "MONOTONE"][0] is None
    value = lambda f: got[f, f][0]
    assert value("SHOUT") == pytest.approx(6, abs=0.01) and 15 < value("FADE") < 20 and value("SLUR") == pytest.approx(6, abs=0.3)
    assert value("MONOTONE") > 4 and value("UPTALK") == pytest.approx(4, abs=0.2) and value("EMPH_FLAT") > 3
    by_time = {f: v for (c, f), (v, _) in got.items() if c == "t"}
    assert by_time == {"PACE_FAST": 2.0, "PAUSE_BAD": 0.5, "PAUSE_LOST": 0.5, "RARE_HESIT": -0.5, "WORD_SKIP": 1.0, "WORD_SWAP": 1.0} and got["t", "PAUSE_BAD"][1] == "inserted s"


def test_doses(spark):
    told = [("x", "SHOUT", k, float(k)) for k in range(1, 6)] + [("x", "SHOUT", 3, 3.5)] + [("x", "FADE", k, -2.0 * k) for k in (1, 3, 5)] + [("x", "FILLER", 1, v) for v in (0.5, 0.25)]
    told += [("y", "SHOUT", k, v) for k, v in zip(range(1, 6), (1.0, 3.0, 2.0, 4.0, 5.0))] + [("y", "FADE", 1, None), ("y", "SLUR", 9, 1.0)]
    df = spark.createDataFrame(told, "take_id string, flaw string, level int, value double")
    got = {(r.take_id, r.flaw): r for r in verify.doses(df, ["take_id"]).collect()}
    assert set(got) == {("x", "SHOUT"), ("x", "FADE"), ("x", "FILLER"), ("y", "SHOUT")}
    assert got["x", "SHOUT"].L3 == 3.25 and got["x", "SHOUT"].spearman == pytest.approx(1) and got["x", "SHOUT"].rises
    assert got["x", "FADE"].spearman == pytest.approx(-1) and got["x", "FADE"].monotonic and not got["x", "FADE"].rises and got["x", "FADE"].L2 is None
    assert got["x", "FILLER"].L1 == 0.75 and got["x", "FILLER"].spearman is None and not got["y", "SHOUT"].monotonic


def test_doses_work_their_effects_out_once(spark):
    told = [(t, "SHOUT", k, v) for t, values in (("x", (1.0, 3.0, 2.0)), (None, (1.0, 2.0, 3.0)), ("z", (0.0, -0.0, 1.0))) for k, v in enumerate(values, 1)]
    found = verify.doses(spark.createDataFrame(told, "take_id string, flaw string, level int, value double"), ["take_id"])
    assert {r.take_id: (round(r.spearman, 9), r.rises) for r in found.collect()} == {"x": (0.5, False), None: (1.0, True), "z": (0.866025404, True)}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # by effects, which differ in their last bits each time they are summed


def speech(seed, seconds=6.0):
    """Bursts of coloured noise with pauses."""
    r = np.random.default_rng(seed)
    x = r.normal(size=int(seconds * SR)) * 0.1
    on = (np.arange(len(x)) // int(0.35 * SR)) % 2 == 0
    return x * np.where(on, 1.0, 1e-3)


def test_conditions_of_a_recording_are_put_on_its_reference(spark):
    clean = speech(1)
    narrow = sound.band_limited(speech(2), SR, 0, 3000)
    noisy = speech(3) + 0.01 * np.random.default_rng(9).normal(size=6 * SR)
    room = sound.convolved(speech(4), sound.room_response(SR, 0.6))[: 6 * SR]
    own = {"same": speech(5), "narrow": narrow, "noisy": noisy, "room": room, "short": np.zeros(10)}
    reference = as_clips(spark, {c: clean for c in [*own, "without"]})
    made = sound.matched(reference, as_clips(spark, own))
    got = {r.clip_id: r for r in made.collect()}
    assert set(got) == {"same", "narrow", "noisy", "room"}
    assert (got["same"].band_to_hz, got["same"].noise_db, got["same"].room_s) == (None, None, None) and np.allclose(got["same"].samples, clean, atol=1e-6)
    assert got["narrow"].band_to_hz == pytest.approx(3060, abs=150) and got["noisy"].noise_db == pytest.approx(-40, abs=1) and got["room"].room_s in (0.45, 0.6, 0.8)
    after = {r.clip_id: r for r in sound.conditions(made.select("clip_id", "sr", "samples"), keep=("clip_id",)).collect()}
    wanted = {r.clip_id: r for r in sound.conditions(as_clips(spark, own), keep=("clip_id",)).filter("clip_id <> 'short'").collect()}
    for c in after:
        assert after[c].bandwidth_hz == pytest.approx(wanted[c].bandwidth_hz, rel=0.06) and abs(after[c].offset_drop_db - wanted[c].offset_drop_db) < 3
    assert abs(after["noisy"].floor_db - wanted["noisy"].floor_db) < 1


def test_a_local_slur_is_no_narrow_recording_and_blocks_do_not_show():
    x = speech(6, 20)
    slurred = x.copy()
    slurred[: 4 * SR] = sound.band_limited(x[: 4 * SR], SR, 0, 2000)
    assert sound.speech_bandwidth(slurred, SR) > 7500 > 2600 > sound.speech_bandwidth(sound.band_limited(x, SR, 0, 2500), SR)
    assert sound.speech_bandwidth(np.zeros(0), SR) == 0.0 == sound.speech_bandwidth(np.zeros(1), SR)
    a, h = np.random.default_rng(1).normal(size=1000), np.random.default_rng(2).normal(size=77)
    assert np.allclose(sound.convolved(a, h, 64), np.convolve(a, h)) and np.allclose(sound.convolved(a, h), np.convolve(a, h))
