"""Comparison with a reference, retakes, sentences."""

import math


from tempora.operators import compare
from tempora.plans import retake

PATH = "clip_id string, ref_frame int, par_frame int, cost double, path_cost double"


def path_with_pause(at=100, pause=50, n=300):
    rows, p = [], 0
    for r in range(n):
        for _ in range(pause if r == at else 1):
            rows.append(("c", r, p, 0.01, 0.02))
            p += 1
    return rows


COMPARED = "clip_id string, i int, w string, start_s double, end_s double, ps double, pe double, dur_r double, btype string, zipf_next double, gap_r double, rho double, cost double"
EVENTS = "clip_id string, kind string, t0 double, t1 double, mag double, r0 int, r1 int, signed double, k int, p0 double, p1 double, q0 double, q1 double"
FRAMES = "clip_id string, frame_i int, f0_st double, inten double, hf double, voiced boolean"


def test_a_pause_is_an_insertion(spark):
    path = spark.createDataFrame(path_with_pause(), PATH)
    track = compare.tempo_track(path)
    events = compare.lag_events(track)
    assert [e.kind for e in events.collect()] == ["ins"] and 0.4 <= events.first().mag <= 0.55 and 0.8 <= events.first().t0 <= 1.0
    words = spark.createDataFrame([("c", i, "w", i * 0.3, i * 0.3 + 0.3) for i in range(10)], "clip_id string, i int, w string, start_s double, end_s double")
    compared = compare.words_compared(words, track).orderBy("i").collect()
    assert abs(compared[0].ps) < 0.02 and abs(compared[9].pe - compared[9].end_s - 0.49) < 0.03
    assert all(abs(w.dur_p - 0.3) < 0.15 for w in compared) and abs(compared[0].kappa - 1) < 0.05 and abs(sum(w.dgap for w in compared) - events.first().mag) < 1e-9
    assert compare.gain(path).first().gain == 1.0
    # the inserted block is where the path is costly
    costly = spark.createDataFrame([(c, r, p, 0.9 if 100 <= p < 150 else cost, all_) for c, r, p, cost, all_ in path_with_pause()], PATH)
    placed = compare.placed_events(events, track, costly, words).first()
    assert placed.k == 2 and abs(placed.q0 - 1.0) < 0.04 and abs(placed.q1 - 1.5) < 0.04


def test_steep_stretches_and_jitter(spark):
    events = [("c", 100, 120, 0.3), ("c", 130, 150, -0.3), ("c", 160, 180, 0.3), ("c", 400, 420, 0.5), ("c", 440, 460, -0.1), ("d", 0, 10, 0.2), ("d", 20, 30, 0.2)]
    kept = compare.without_jitter(spark.createDataFrame(events, "clip_id string, r0 int, r1 int, mag double")).collect()
    assert sorted((e.clip_id, e.r0) for e in kept) == [("c", 160), ("c", 400), ("c", 440), ("d", 0), ("d", 20)]


def test_pauses_against_a_reference(spark):
    schema = "clip_id string, i int, w string, start_s double, end_s double, ps double, pe double, btype string"
    words = spark.createDataFrame([("c", i, "w", i * 1.0, i + 1.0, i * 1.0, i + 1.0, b) for i, b in enumerate(["phrase_tight", "sentence", "phrase_tight", "sentence"])], schema)
    quiet = "clip_id string, start_s double, end_s double"
    own = spark.createDataFrame([("c", 0.6, 1.5)], quiet)
    reference = spark.createDataFrame([("c", 1.7, 2.3)], quiet)
    found = {(r.flaw, r.w0) for r in compare.pauses(words, own, reference).collect()}
    assert found == {("PAUSE_BAD", 0), ("PAUSE_LOST", 1)}


def test_pace_and_swaps(spark):
    rows = [("c", i, i * 0.3, i * 0.3 + 0.3, 0.3, 0.3, 1.4 if 4 <= i < 10 else 1.0, 0.9 if i == 12 else 0.05) for i in range(16)]
    df = spark.createDataFrame(rows, "clip_id string, i int, ps double, pe double, dur_r double, dur_p double, rho double, cost double")
    assert [(r.flaw, r.w0, r.w1, r.d) for r in compare.pace(df).collect()] == [("PACE_FAST", 4, 9, 1.4)]
    gains = spark.createDataFrame([("c", 1.0)], "clip_id string, gain double")
    assert [(r.flaw, r.w0) for r in compare.swaps(df, gains).collect()] == [("WORD_SWAP", 12)]


def comparison(spark, frame=lambda t: {}, events=(), n=40):
    """A clip said as its reference, but for what ``frame`` changes and the events."""
    ends = ["sentence" if i % 10 == 9 else "before_coord" if i % 10 == 4 else "phrase_tight" for i in range(n)]
    words = [("c", i, "word", i * 0.4, i * 0.4 + 0.4, i * 0.4, i * 0.4 + 0.4, 0.4, ends[i], 2.0 if i == 30 else None, 0.0, 1.0, 0.05) for i in range(n)]

    def frames(change):
        made = []
        for f in range(n * 40):
            t = f * 0.01
            row = {"f0": 4 * math.sin(f / 7), "inten": 0.0, "hf": -10.0, **change(t)}
            made.append(("c", f, row["f0"], row["inten"], row["hf"], row["f0"] is not None))
        return spark.createDataFrame(made, FRAMES)

    table = spark.createDataFrame([("c", k, a, b, m, int(a * 100), int(b * 100), m, w, a, b, a, b) for k, a, b, m, w in events], EVENTS)
    return compare.Comparison(spark.createDataFrame(words, COMPARED), table, frames(frame), frames(lambda t: {}), spark.createDataFrame([("c", 1.0)], "clip_id string, gain double"))


def test_detectors_of_levels(spark):
    same = comparison(spark)
    assert compare.detected(same).count() == 0
    c = comparison(spark, lambda t: {"inten": 20.0} if 6.0 < t < 9 else {"f0": 0.1 * math.sin(t * 30)} if 10.0 < t < 15.6 else {"hf": -30.0} if 0.4 < t < 3.6 else {})
    found = {}
    for r in compare.detected(c).collect():
        found.setdefault(r.flaw, []).append(r)
    assert abs(found["SHOUT"][0].d - 20) < 1e-6 and abs(found["SLUR"][0].d - 20) < 1e-6 and found["MONOTONE"][0].d > 2
    c = comparison(spark, lambda t: {"inten": -9.0, "f0": 6.0 if t > 7.94 else 1.0} if 6.8 < t < 8.0 else {})
    found = {r.flaw: r for r in compare.detected(c).filter("w1 = 19").collect()}
    assert abs(found["FADE"].d - 9) < 1 and found["UPTALK"].d > 2


def test_meanings_of_events(spark):
    steady = lambda t: {"inten": -60.0, "f0": None} if 2.0 <= t < 2.3 else {"f0": None} if 3.6 <= t < 3.9 else {}
    events = [("ins", 2.0, 2.3, 0.3, 5), ("ins", 3.6, 3.9, 0.3, 9), ("ins", 5.0, 5.3, 0.3, 12), ("ins", 12.0, 12.4, 0.4, 30), ("del", 10.0, 10.8, 0.8, 25), ("ins", 8.0, 8.1, 0.1, 20)]
    c = comparison(spark, steady, events)
    found = sorted((r.flaw, r.w0, r.w1) for r in compare.from_events(c).collect())
    assert found == [("FILLER", 12, 13), ("PAUSE_BAD", 5, 6), ("RARE_HESIT", 31, 31), ("REPEAT", 10, 10), ("WORD_SKIP", 25, 26)]
    absolute = {r.flaw for r in compare.from_events(c, {**compare.DEFAULTS, "abs_pause": 1}).filter("w0 = 5").collect()}
    assert absolute == set()  # the silence is as long as a usual one


def test_stress_and_clauses(spark):
    loud = lambda t: {"inten": 9.0, "f0": 9.0 * math.sin(t * 20)} if 4.8 <= t < 5.2 or 5.6 <= t < 6.0 or 15.2 <= t < 15.6 else {}
    plain = comparison(spark)
    c = compare.Comparison(plain.words, plain.events, plain.own, comparison(spark, loud).own, plain.gains)
    found = compare.flat_stress(c).collect()
    assert [(r.w0, r.w1, r.facts["words"]) for r in found] == [(12, 14, "2")]
    wide = compare.expanded(compare.flat_stress(c), c.words).first()
    assert (wide.w0, wide.w1, round(wide.start_s, 9), round(wide.end_s, 9)) == (10, 14, 4.0, 6.0)


def test_edges_and_slow_stretches(spark):
    found = spark.createDataFrame(
        [("c", "FILLER", 0.0, 0.2, 1.0, 0, 0), ("c", "FILLER", 5.0, 5.2, 0.2, 1, 1), ("c", "PACE_SLOW", 5.1, 8.0, 2.0, 1, 5), ("c", "FILLER", 9.0, 9.2, 0.2, 8, 8)],
        "clip_id string, flaw string, start_s double, end_s double, d double, w0 int, w1 int",
    )
    clips = spark.createDataFrame([("c", 20.0)], "clip_id string, duration_s double")
    assert sorted((r.flaw, r.start_s) for r in compare.filtered(found, clips).collect()) == [("FILLER", 9.0), ("PACE_SLOW", 5.1)]


def test_words_give_way_to_silence(spark):
    times = "clip_id string, i int, start_s double, end_s double"
    words = spark.createDataFrame([("c", 0, 0.0, 1.0), ("c", 1, 1.0, 2.0), ("c", 2, 2.05, 3.0), ("d", 0, 0.0, 1.0)], times)
    quiet = spark.createDataFrame([("c", 1.2, 1.5), ("c", 1.85, 1.95), ("c", 2.8, 2.95), ("c", 0.99, 1.1)], "clip_id string, start_s double, end_s double")
    moved = sorted((r.clip_id, r.i, r.start_s, r.end_s) for r in compare.snapped(words, quiet).collect())
    # an early silence is the pause before the word, a late one ends it, short ones and those at an edge change nothing
    assert moved == [("c", 0, 0.0, 1.2), ("c", 1, 1.5, 2.0), ("c", 2, 2.05, 2.8), ("d", 0, 0.0, 1.0)]
    late = compare.snapped(spark.createDataFrame([("c", 0, 0.0, 1.0), ("c", 1, 1.05, 2.0)], times), spark.createDataFrame([("c", 0.7, 0.9)], "clip_id string, start_s double, end_s double"))
    assert sorted((r.i, r.start_s, r.end_s) for r in late.collect()) == [(0, 0.0, 0.7), (1, 0.9, 2.0)]
    frames = spark.createDataFrame([("c", f, 0.0, -50.0 if f < 10 or f > 80 else 0.0, 0.0, True) for f in range(100)], FRAMES)
    told = compare.snapped(spark.createDataFrame([("c", 0, 0.0, 1.0)], times), quiet.limit(0), frames).first()
    assert abs(told.ts - 0.1) < 1e-9 and abs(told.te - 0.81) < 1e-9


def test_retake_points_and_windows(spark):
    df = spark.createDataFrame([(4.0, 7.0, 6.0, 3.0, 5.0), (4.0, 7.0, 4.0, 3.0, 5.0), (4.0, 7.0, 9.0, 3.0, 5.0)], "points_lost double, first double, again double, low double, high double")
    assert [r.points_after for r in retake.points_after(df).collect()] == [2.0, 0.0, 4.0]
    words = spark.createDataFrame([("c", i, i == 9) for i in range(26)], "clip_id string, i int, flagged boolean")
    assert sorted((r.w0, r.w1) for r in retake.clean_windows(words).collect()) == [(0, 7), (10, 17), (18, 25)]


def test_phrase_measures(spark):
    frames = [("c", i, -60.0 if 100 <= i < 150 else 0.0, -1.0, float(i % 5), True) for i in range(300)]
    frames = spark.createDataFrame(frames, "clip_id string, frame_i int, inten double, hf double, f0_st double, voiced boolean")
    words = spark.createDataFrame([("c", w) for w in "um hello there".split()], "clip_id string, w string")
    m = retake.phrase_measures(words, frames).first()
    assert (m.fillers, m.syllables, round(m.pause_in, 2), m.pause_end, m.pitch) == (1, 4, 0.5, 0.0, 2.0) and abs(m.rate - 4 / 2.5) < 1e-9


def test_sentences(spark):
    df = spark.createDataFrame([("c", "SHOUT", 4.26, "hear me", 3.0), ("c", "FADE", 1.0, "so", 1.0)], "clip_id string, flaw string, d double, words_text string, points_lost double")
    assert df.transform(retake.explained).filter("flaw = 'SHOUT'").first().explanation == "You are 4.3 dB louder than usual in “hear me”."
    areas = spark.createDataFrame([("c", "level", 70.0), ("c", "pace", 90.0), ("d", "pace", 100.0)], "clip_id string, category string, area_score double")
    got = {r.clip_id: r.summary for r in retake.summary(df, areas).collect()}
    assert got == {"c": "2 flagged; most costly: SHOUT; weakest area: level.", "d": "Nothing was flagged."}
