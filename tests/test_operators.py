"""Operators on small fixtures with known results."""

import math
import random
import statistics
import struct
import wave

import numpy as np
import pyspark.sql.functions as F
import pytest

from tempora import queries
from tempora.functions import text
from tempora.operators import align, detect, edges, intervals, series
from tempora.plans import calibrate, catalog, evaluate, score
from tempora.sources import labels as sources
from tempora.streaming import live


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_prf(spark):
    df = spark.createDataFrame([(280, 457, 460), (28, 43, 42), (52, 199, 698), (0, 0, 0)], "tp int, t int, f int")
    p, r, f1 = evaluate.prf(F.col("tp"), F.col("t"), F.col("f"))
    got = [tuple(round(x, 3) for x in row) for row in df.select(p, r, f1).collect()]
    assert got == [(0.609, 0.613, 0.611), (0.667, 0.651, 0.659), (0.074, 0.261, 0.116), (0.0, 0.0, 0.0)]


@pytest.mark.parametrize(("series_", "want"), [
    ([100, 95.3, 95.3, 76.6, 87.7, 62.6], -0.928), ([100, 100, 100, 91.2, 71.1, 61.1], -0.941), ([100, 89.5, 81.6, 75.2, 66.7, 60.1], -1.0), ([100, 100, 71.8, 93.6, 87.4, 87.2], -0.638), ([1] * 6, None),
])
def test_spearman(spark, series_, want):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(series_)], "g string, x int, y double")
    rho = evaluate.spearman(df, ["g"], "x", "y").first().rho
    assert rho is None if want is None else round(rho, 3) == want


def test_spearman_of_values_whose_last_bits_differ_each_time_they_are_worked_out(spark):
    """As sums of doubles on a cluster do, whose parts are put together in the order in which they arrive."""
    rows = [(g, i, float(v)) for g, values in (("a", (5, 3, 4, 1, 2)), ("b", (1, 2, 3, 4, 5)), (None, (1, 3, 2))) for i, v in enumerate(values)]
    sums = spark.createDataFrame(rows, "g string, x int, v double").groupBy("g", "x").agg(F.sum("v").alias("v"))
    df = sums.withColumn("y", F.col("v") + F.reflect(F.lit("java.lang.Math"), F.lit("random")).cast("double") * 1e-9)
    got = {r.g: (r.n, round(r.rho, 9)) for r in evaluate.spearman(df, ["g"], "x", "y").collect()}
    assert got == {"a": (5, -0.8), "b": (5, 1.0), None: (3, 0.5)}


def test_spearman_of_ties_in_both(spark):
    import pandas as pd

    pairs = [(i * i % 7, i * i * i % 5 * 0.5) for i in range(40)] + [(3, -0.0), (3, 0.0)]
    df = spark.createDataFrame([("a", x, y) for x, y in pairs] + [("a", None, 1.0), ("a", 1, None)], "g string, x int, y double")
    r = evaluate.spearman(df, ["g"], "x", "y").first()
    assert r.n == 42 and r.rho == pytest.approx(pd.DataFrame(pairs).rank().corr().iloc[0, 1], abs=1e-12)


@pytest.mark.parametrize(("a", "b", "least", "want"), [((1, 2), (1.5, 2.5), 0, 1 / 3), ((5, 5), (5.1, 5.1), 0.3, 0.5), ((1, 2), (2, 3), 0, 0), ((0, 4), (1, 3), 0, 0.5)])
def test_iou(spark, a, b, least, want):
    lit = lambda x: F.lit(float(x))
    assert abs(spark.range(1).select(intervals.iou(lit(a[0]), lit(a[1]), lit(b[0]), lit(b[1]), least)).first()[0] - want) < 1e-9


def test_syllables_seeds_and_slugs(spark):
    words = ["stella", "come", "people", "the", "apple", "queue", "rhythm", "free"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    assert [r.n for r in df.orderBy("i").select(text.syllables(F.col("w")).alias("n")).collect()] == [2, 1, 2, 1, 2, 1, 1, 1]
    seeds = spark.range(1).select(*[text.seed_of(F.lit("B01-CHAMP"), F.lit(t)) for t in ("SHOUT", "PAUSE_BAD", "WORD_SKIP")]).first()
    assert tuple(seeds) == (4068, 3821, 5306)
    slugs = spark.createDataFrame([(" Ann  O'Neil ",), ("!!",)], "n string").select(text.slug(F.col("n"))).collect()
    assert [s[0] for s in slugs] == ["ann-o-neil", None]


def test_words_of_a_text(spark):
    df = spark.createDataFrame([(1, 'He said—"Stop!" then, 12 left.'), (2, None), (3, "")], "id int, text string")
    got = rows(text.words_of(df), "i", "w", "clean", "sent_end", "clause_end")
    assert got == [(0, "He", "he", False, False), (1, "said", "said", False, False), (2, '"Stop!"', "stop", True, True), (3, "then,", "then", False, True), (4, "left.", "left", True, True)]


def test_similarity_and_alignment(spark):
    assert align.similarity("form", "from") == 0.75 and round(align.similarity("thing", "things"), 4) == 0.9091
    ref = spark.createDataFrame([("c", i, w) for i, w in enumerate("please call stella now".split())], "clip_id string, i int, w string")
    hyp = spark.createDataFrame([("c", j, w) for j, w in enumerate("please well call stellas".split())] + [("only", 0, "x")], "clip_id string, j int, w string")
    got = [(r.clip_id, r.ref_i, r.hyp_j) for r in align.word_alignment(ref, hyp).collect()]
    assert got == [("c", 0, 0), ("c", None, 1), ("c", 1, 2), ("c", 2, 3), ("c", 3, None), ("only", None, 0)]


def test_warp_equals_the_plain_table():
    import numpy as np

    r = np.random.default_rng(3)
    for n, m in [(1, 1), (1, 5), (6, 1), (2, 2), (9, 14), (17, 8)]:
        a, b = r.normal(size=(n, 3)), r.normal(size=(m, 3))
        cost = 1 - (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
        total = np.full((n, m), np.inf)
        total[0, 0] = cost[0, 0]
        for i in range(n):
            for j in range(m):
                for di, dj, times, more in align.STEPS:
                    if i >= di and j >= dj:
                        total[i, j] = min(total[i, j], total[i - di, j - dj] + times * cost[i, j] + more)
        path, mean = align.warp(a, b)
        assert path[0][:2] == (0, 0) and path[-1][:2] == (n - 1, m - 1) and abs(mean - np.mean([c for *_, c in path])) < 1e-12
        steps = {(di, dj): (times, more) for di, dj, times, more in align.STEPS}
        spent = cost[0, 0] + sum(steps[y[0] - x[0], y[1] - x[1]][0] * y[2] + steps[y[0] - x[0], y[1] - x[1]][1] for x, y in zip(path, path[1:]))
        assert abs(spent - total[-1, -1]) < 1e-9


def test_warp_of_equal_series():
    import numpy as np

    a = np.eye(4)
    path, cost = align.warp(a, np.repeat(a, 2, axis=0))
    assert cost < 1e-9 and path[0][:2] == (0, 0) and path[-1][:2] == (3, 7)


def test_runs_and_sessions(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 1, None, 1, 0, 1])] + [("b", 0, 0)], "k string, i int, v int")
    assert rows(series.runs(df, ["k"], ["i"], F.col("v") == 1), "k", "run", "first_row", "last_row", "n") == [("a", 1, 0, 1, 2), ("a", 2, 3, 3, 1), ("a", 3, 5, 5, 1)]
    assert rows(series.sessions(df, ["k"], ["i"], F.col("v") == 0), "k", "i", "session") == [("a", 0, 1), ("a", 1, 1), ("a", 2, 1), ("a", 3, 1), ("a", 4, 2), ("a", 5, 2), ("b", 0, 1)]


def test_silences_round_the_limit(spark):
    frames, at = [], 0
    for n in (11, 12, 13):
        frames += [("c", "par", at + i, 0.0) for i in range(100)] + [("c", "par", at + 100 + i, -50.0) for i in range(n)]
        at += 100 + n
    found = series.silences(spark.createDataFrame(frames, "clip_id string, role string, frame_i int, inten double"), share=0.65)
    assert [round(e - s, 2) for s, e in rows(found, "start_s", "end_s")] == [0.12, 0.13]


def test_overlap_join_equals_all_pairs(spark):
    import random

    r = random.Random(1)
    data = [(i, r.choice("ab"), s := r.uniform(0, 50), s + r.choice([0.0, 0.1, 3.0, 20.0])) for i in range(80)]
    df = spark.createDataFrame(data, "id int, k string, start_s double, end_s double")
    got = {(a, b) for a, b in rows(intervals.overlap_join(df, df, ["k"], 2.0, margin=0.5), "id", "r_id")}
    assert got == {(a[0], b[0]) for a in data for b in data if a[1] == b[1] and min(a[3] + 0.5, b[3]) > max(a[2] - 0.5, b[2])}


def test_greedy_match_prefers_later_of_equals(spark):
    truth = spark.createDataFrame([("c", 0, "X", 0.0, 2.0), ("c", 1, "X", 0.0, 2.0)], "clip_id string, i int, flaw string, start_s double, end_s double")
    found = spark.createDataFrame([("c", 0, "X", 0.0, 2.0)], "clip_id string, j int, flaw string, start_s double, end_s double")
    assert rows(intervals.matched(truth, found, 0.5), "i", "j") == [(1, 0)]
    overall = {r.flaw: r.f1 for r in evaluate.grounding(truth, found, 0.5).collect()}
    assert abs(overall["X"] - 2 / 3) < 1e-9 and overall["X"] == overall[None]


def test_nearest_and_asof(spark):
    left = spark.createDataFrame([("a", 5.0), ("a", 0.5), ("b", 1.0)], "k string, t double")
    right = spark.createDataFrame([("a", 4.0, 1), ("a", 6.0, 2), ("a", 1.0, 3)], "k string, t double, id int")
    assert rows(intervals.nearest(left, right, ["k"], "t", ["id"]).fillna({"r_id": -1}), "k", "t", "r_id") == [("a", 0.5, 3), ("a", 5.0, 1), ("b", 1.0, -1)]
    assert rows(intervals.asof_before(left, right, ["k"], "t", ["id"]).fillna({"r_id": -1}), "k", "t", "r_id") == [("a", 0.5, -1), ("a", 5.0, 1), ("b", 1.0, -1)]


def test_arbitration_equals_all_pairs(spark):
    """Against the rule itself over all pairs of a clip, on many random clips."""
    import random

    r = random.Random(11)
    category = {"PACE_FAST": "a", "PACE_SLOW": "a", "PAUSE_BAD": "b", "FILLER": "c", "SLUR": "d", "EMPH_FLAT": "e", "SHOUT": "f", "FADE": "f"}
    trust = {"PACE_SLOW": 0.6, "PAUSE_BAD": 0.79, "FILLER": 0.58, "SLUR": 0.73, "FADE": 0.62}
    data = []
    for clip in range(60):
        for w in range(r.randint(1, 14)):
            flaw, start = r.choice(list(category)), r.choice([0.0, 1.0, r.uniform(0, 12)])
            data.append((f"c{clip}", flaw, category[flaw], start, start + r.choice([0.02, 0.5, r.uniform(0, 4)]), w))
    got = rows(intervals.arbitrated(spark.createDataFrame(data, "clip_id string, flaw string, category string, start_s double, end_s double, w0 int"), spark.createDataFrame(list(trust.items()), "flaw string, reliability double")), "clip_id", "w0")
    want = []
    for clip in {d[0] for d in data}:
        mine = sorted((d for d in data if d[0] == clip), key=lambda d: (d[3], d[1], d[4], d[5]))
        share = lambda p, q: max(0.0, min(p[4], q[4]) - max(p[3], q[3])) / max(0.05, min(p[4] - p[3], q[4] - q[3]))
        gone = set()
        for p in mine:
            gone |= set() if p in gone else {q for q in mine if q is not p and q[1] in intervals.SECONDARY.get(p[1], ()) and share(p, q) >= 0.3}
        left = [d for d in mine if d not in gone]
        gone = set()
        for k, p in enumerate(left):
            for q in left[k + 1 :]:
                lead = trust.get(p[1], 1.0) - trust.get(q[1], 1.0)
                if not gone & {p, q} and p[2] != q[2] and share(p, q) >= 0.5 and abs(lead) >= 0.05:
                    gone.add(q if lead > 0 else p)
        want += [(d[0], d[5]) for d in left if d not in gone]
    assert got == sorted(want) and len(want) < len(data)


def test_greedy_matching_equals_all_pairs_in_order(spark):
    import random

    r = random.Random(4)
    schema = "clip_id string, {} int, flaw string, start_s double, end_s double"

    def some(n):
        made = [(r.choice("ab"), k, r.choice("XY"), s := round(r.uniform(0, 30), 1), s + r.choice([0.0, 0.5, 3.0])) for k in range(n)]
        return made

    truth, found = some(70), some(70)
    got = rows(intervals.matched(spark.createDataFrame(truth, schema.format("i")), spark.createDataFrame(found, schema.format("j")), 0.2), "clip_id", "i", "j")

    def iou(a, b):
        wide = [(s, e) if e - s >= 0.3 else ((s + e) / 2 - 0.15, (s + e) / 2 + 0.15) for *_, s, e in (a, b)]
        both = max(0.0, min(wide[0][1], wide[1][1]) - max(wide[0][0], wide[1][0]))
        return both / (sum(e - s for s, e in wide) - both)

    pairs = sorted(((v, a[1], b[1], a[0]) for a in truth for b in found if a[0] == b[0] and a[2] == b[2] and (v := iou(a, b)) >= 0.2), reverse=True)
    used, want = set(), []
    for _, i, j, clip in pairs:
        if not {(clip, "i", i), (clip, "j", j)} & used:
            used |= {(clip, "i", i), (clip, "j", j)}
            want.append((clip, i, j))
    assert got == sorted(want)
    onsets = rows(intervals.matched_onsets(spark.createDataFrame(truth, schema.format("i")), spark.createDataFrame(found, schema.format("j")), 0.5), "clip_id", "i", "j")
    pairs = sorted((abs(a[3] - b[3]), a[1], b[1], a[0]) for a in truth for b in found if a[0] == b[0] and a[2] == b[2] and abs(a[3] - b[3]) <= 0.5)
    used, want = set(), []
    for _, i, j, clip in pairs:
        if not {(clip, "i", i), (clip, "j", j)} & used:
            used |= {(clip, "i", i), (clip, "j", j)}
            want.append((clip, i, j))
    assert onsets == sorted(want)


def test_vote(spark):
    v = spark.createDataFrame([("c", "p", "X", 0.0, 1.0, 1), ("c", "q", "X", 0.1, 1.0, 2), ("c", "p", "X", 5.0, 6.0, 3), ("d", "p", "X", 0.0, 1.0, 4)], "clip_id string, ref_id string, flaw string, start_s double, end_s double, id int")
    assert rows(intervals.voted(v, "p"), "id", "agreeing") == [(1, 2), (4, 1)]


READING = {"pausing": 0.20, "pace": 0.20, "pitch": 0.20, "fluency": 0.10, "clarity": 0.15, "level": 0.15}
RUBRIC = score.Rubric(areas={"interpretive_reading": READING}, event_flaws=("PAUSE_BAD", "FILLER"))


def score_of(spark, regions, rough=False, fluency=True, duration=60.0):
    schema = "clip_id string, rid int, flaw string, category string, start_s double, end_s double, severity double, confidence double, reliability double"
    clips = spark.createDataFrame([("c", duration, "unknown", rough, fluency)], "clip_id string, duration_s double, genre string, rough boolean, fluency boolean")
    return score.score(spark.createDataFrame(regions, schema), clips, RUBRIC)


def test_score_of_one_region(spark):
    region = ("c", 0, "PAUSE_BAD", "pausing", 36.071, 37.045, 3.0, 0.9, 0.792)
    area = round(100 * math.exp(-0.9 * 0.792 * 9 / 35), 1)
    clips, regions = score_of(spark, [region])
    c = clips.first()
    assert c.categories["pausing"] == area and c.worst_area_score == area
    assert c.overall == round(0.6 * (0.8 * 100 + 0.2 * area) + 0.4 * area, 1) and regions.first().points_lost == round(0.2 * (100 - area), 2)
    rough, _ = score_of(spark, [region], rough=True)
    assert rough.first().worst_area_score == 100.0 and rough.first().overall > c.overall
    none, _ = score_of(spark, [])
    assert none.first().overall == 100.0 and none.first().band == "polished"


def test_fluency_off_and_unsure_regions_cost_nothing(spark):
    regions = [("c", 0, "FILLER", "fluency", 20.0, 20.4, 3.0, 0.9, 0.6), ("c", 1, "SHOUT", "level", 10.0, 14.0, 4.0, 0.3, 0.6)]
    clips, told = score_of(spark, regions, fluency=False)
    assert clips.first().overall == 100.0 and [r.points_lost for r in told.collect()] == [0.0, 0.0]


def test_severity_on_knots(spark):
    knots = spark.createDataFrame([("X", 1.0, 2.0), ("X", 2.0, 3.0), ("X", 4.0, 5.0)], "flaw string, x double, y double")
    d = spark.createDataFrame([("X", v) for v in (0.5, 1.5, 3.0, 9.0)] + [("Y", 7.0)], "flaw string, d double")
    assert [r.severity for r in score.severity(d, knots).orderBy("flaw", "d").collect()] == [2.0, 2.5, 4.0, 5.0, 5.0]


def test_isotonic_and_logistic(spark):
    points = spark.createDataFrame([("X", float(i), y) for i, y in enumerate([1, 2, 2, 4, 3, 5])] + [("Y", 1.0, 1)], "flaw string, d double, level int")
    assert rows(calibrate.isotonic(points).filter("flaw = 'X'"), "x", "y") == [(0.0, 1.0), (1.0, 2.0), (2.0, 2.0), (3.0, 3.5), (4.0, 3.5), (5.0, 5.0)]
    data = spark.createDataFrame([(float(i), int(i > 5)) for i in range(20)], "x double, y int")
    assert calibrate.logistic(data, ["x"], "y").coefficients[0] > 0


WORDS = "clip_id string, i int, clean string, start_s double, end_s double, heard boolean, sim double, heard_w string, btype string"
FRAMES = "clip_id string, frame_i int, f0_st double, inten double, hf double, voiced boolean"
HEARD = "clip_id string, w string, start_s double, end_s double"


def clip_of(spark, n=40, slow=(), gap_after=None, skip=(), swap=(), prompted=(), inserted=(), frame=lambda t: {}, norms=None):
    """A clip of words of 0.3 s in sentences of ten, with silences of 0.3 s between sentences."""
    words, quiet, t = [], [], 0.6
    for i in range(n):
        d = 0.3 * (3 if i in slow else 1) * (1.05 if i % 2 else 0.95)
        last = i % 10 == 9
        words.append(("c", i, "word", t, t + d, i not in skip, 0.3 if i in swap else 1.0, "worse" if i in swap else "word", "sentence" if last else "phrase_tight"))
        t += d
        if last or i == gap_after:
            quiet.append((t, t := t + (1.2 if i == gap_after else 0.3)))
    end, made = t + 0.6, []
    for f in range(int(end / 0.01)):
        s = f * 0.01
        silent = any(a <= s < b for a, b in quiet)
        row = {"f0": None if silent else 4 * math.sin(f / 7), "inten": -50.0 if silent or s < 0.6 or s > t else 0.0, "hf": -10.0, **frame(s)}
        made.append(("c", f, row["f0"], row["inten"], row["hf"], row["f0"] is not None))
    heard = [("c", w[7], w[3], w[4]) for w in words if w[5]]
    table = lambda data, schema: spark.createDataFrame(data, schema)
    return detect.Clips(
        table(words, WORDS), table(made, FRAMES), table([("c", end)], "clip_id string, duration_s double"), table(heard, HEARD), table([("c", *p) for p in prompted], HEARD),
        table([("c", *p) for p in inserted], HEARD + ", after int"), norms or detect.Norms(),
    ), words


def test_detectors_of_times(spark):
    c, words = clip_of(spark, slow=range(12, 20), gap_after=4, skip=(25, 26), swap=(33,))
    found = {r.flaw: r for r in detect.detected(c, {"pace_win": 1}).orderBy("start_s").collect()}
    assert {"PACE_SLOW", "PAUSE_BAD", "WORD_SKIP", "WORD_SWAP"} <= set(found) and "PACE_FAST" not in found and "PAUSE_LOST" not in found
    assert (found["PAUSE_BAD"].w0, found["PAUSE_BAD"].w1) == (4, 5) and abs(found["PAUSE_BAD"].d - 1.2) < 0.03 and found["PAUSE_BAD"].facts["boundary"] == "phrase_tight"
    assert (found["WORD_SKIP"].w0, found["WORD_SKIP"].w1, found["WORD_SKIP"].facts["missing"]) == (25, 26, "word word")
    assert found["WORD_SWAP"].w0 == 33 and found["WORD_SWAP"].facts == {"heard": "worse"}
    assert abs(found["PACE_SLOW"].d - 3) < 0.4 and found["PACE_SLOW"].w0 <= 12 and found["PACE_SLOW"].w1 >= 19
    lost, _ = clip_of(spark, norms=detect.Norms(sentence_pause=2.0))
    assert [r.w0 for r in detect.detected(lost, flaws=("PAUSE_LOST",)).orderBy("w0").collect()] == [9, 19, 29]
    few, _ = clip_of(spark, n=6)
    assert detect.detected(few).filter("flaw in ('PACE_FAST', 'PACE_SLOW', 'SHOUT')").count() == 0
    kept = detect.usable(detect.detected(c), c.clips, disabled=("WORD_SWAP",), least_s=100.0, text_given=True)
    assert {r.flaw for r in kept.collect()} <= {"PAUSE_BAD", "WORD_SKIP", "FILLER", "UPTALK"}


def test_detectors_of_levels(spark):
    c, words = clip_of(spark, frame=lambda s: {"inten": 20.0} if 6.6 < s < 9 else {"f0": 0.1 * math.sin(s * 30)} if 1.0 < s < 4.6 else {"hf": -30.0} if 9.8 < s < 12.4 else {})
    found = {}
    for r in detect.detected(c).collect():
        found.setdefault(r.flaw, []).append(r)
    assert abs(found["SHOUT"][0].d - 20) < 1e-6 and found["SHOUT"][0].start_s < 9 < found["SHOUT"][0].end_s + 0.1
    assert found["MONOTONE"][0].start_s < 1.2 and found["MONOTONE"][0].d > 3
    assert abs(found["SLUR"][0].d - 20) < 1e-6
    ends = [w for w in words if w[8] == "sentence"]
    c, _ = clip_of(spark, frame=lambda s: {"inten": -9.0, "f0": 6.0 if s > ends[1][4] - 0.06 else 1.0} if ends[1][4] - 1.3 < s < ends[1][4] - 0.005 else {})
    found = {r.flaw: r for r in detect.detected(c, flaws=("FADE", "UPTALK")).filter("w1 = 19").collect()}
    assert abs(found["FADE"].d - 8) < 0.6 and found["UPTALK"].d == 8.0 and found["UPTALK"].facts["rise_st"] == "5.0"


def test_fillers_and_repeats(spark):
    hum = lambda s: {"f0": 2.0, "inten": -1.0} if 4.15 < s < 4.75 else {}  # noqa: E731  in the long silence
    c, words = clip_of(spark, gap_after=9, prompted=[("um", 5.0, 5.3), ("um", 5.01, 5.25), ("word", 6.0, 6.2), ("uh", 7.0, 7.05)], inserted=[("wor", 8.0, 8.2, 20), ("zebra", 9.0, 9.2, 22)], frame=hum)
    found = detect.detected(c, flaws=("FILLER", "REPEAT")).orderBy("start_s").collect()
    told = {(r.flaw, r.facts.get("heard")) for r in found}
    assert ("FILLER", "um") in told and ("REPEAT", "wor") in told and ("REPEAT", "zebra") not in told
    assert len([r for r in found if r.facts.get("heard") == "um"]) == 1
    voiced = [r for r in found if r.facts.get("heard") in ("held vowel", "voiced hum / drawl") and 4 < r.start_s < 5]
    assert len(voiced) == 1 and abs(voiced[0].d - 0.6) < 0.05 and voiced[0].w0 == 9


def test_word_features_and_flat_stretches(spark):
    frames = spark.createDataFrame([("c", "par", i, 5.0 if i < 40 else float(i), 1.0, 0.5, True) for i in range(80)], "clip_id string, role string, frame_i int, f0_st double, inten double, hf double, voiced boolean")
    words = spark.createDataFrame([("c", 0, 0.0, 0.4), ("c", 1, 0.4, 0.8)], "clip_id string, i int, start_s double, end_s double")
    f = series.word_features(words, frames).orderBy("i").collect()
    assert f[0].f0_range == 0 and f[1].f0_range == 39 and f[1].prominence > f[0].prominence
    assert [(round(s, 2), round(e, 2)) for s, e in rows(series.flat_stretches(frames), "start_s", "end_s")] == [(0.0, 0.4)]
    # a stretch too short to count is passed over whole, unvoiced gaps of two frames are bridged and longer ones are not
    pitch = [0.0] * 10 + [9.0] * 3 + [None] * 2 + [9.5] * 12 + [None] * 3 + [9.5] * 12 + [11.6] * 20
    frames = spark.createDataFrame([("c", i, p, float(i % 2), float(i % 3)) for i, p in enumerate(pitch)], "clip_id string, frame_i int, f0_st double, inten double, hf double")
    got = series.flat_stretches(frames, least_s=0.12).orderBy("start_s").collect()
    assert [(round(r.start_s, 2), round(r.end_s, 2), round(r.range_st, 2)) for r in got] == [(0.1, 0.27, 0.5), (0.3, 0.42, 0.0), (0.42, 0.62, 0.0)]
    level, high = [float(i % 2) for i in range(10, 27)], [float(i % 3) for i in range(10, 27)]
    mean = sum(level) / 17
    assert abs(got[0].level_sd - (sum((v - mean) ** 2 for v in level) / 17) ** 0.5) < 1e-9
    assert abs(got[0].change - sum(abs(a - b) for a, b in zip(high, high[1:])) / 16) < 1e-9


def test_hysteresis(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 3.0, 9.0, 4.0, None, 3.0, 4.0, 1.0, 8.0])], "k string, i int, v double")
    assert rows(series.hysteresis(df, ["k"], ["i"], "v", 5.0, 2.0), "first_row", "last_row", "peak") == [(1, 3, 9.0), (8, 8, 8.0)]


def test_manifest_and_gates(spark, tmp_path):
    label = spark.createDataFrame([("a", [("X", "p", 2), ("W", "p", 3)]), ("b", [])], "clip_id string, what array<struct<flaw: string, category: string, level: int>>")
    assert rows(catalog.manifest(label), "clip_id", "flaw_codes", "categories", "max_level", "n_regions") == [("a", "W|X", "p", 3, 2), ("b", "", "", 0, 0)]
    table = spark.createDataFrame([(1, "old"), (2, "old")], "id int, v string")
    assert rows(catalog.upserted(table, spark.createDataFrame([(2, "new"), (3, "new")], "id int, v string"), ["id"]), "id", "v") == [(1, "old"), (2, "new"), (3, "new")]
    path = tmp_path / "a.json"
    path.write_text('{"clip_id": "a", "duration_s": 3.5, "what": [{"flaw": "X", "category": "p", "level": 9, "start_s": 1, "end_s": 2}]}')
    read = sources.labels(spark, str(path))
    assert rows(sources.regions(read), "clip_id", "rid", "flaw", "start_s") == [("a", 0, "X", 1.0)]
    assert sources.rule_breaks(read, ["X"], ["p"]).first().broken == ["level"]


def test_wav_frames(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(b"".join(struct.pack("<h", int(12000 * math.sin(2 * math.pi * 200 * i / 16000))) for i in range(8000)))
    audio = sources.wav(spark, str(tmp_path))
    assert audio.select(F.size("samples")).first()[0] == 8000
    f = sources.frames(audio).filter("voiced").collect()
    assert len(f) > 30 and all(abs(r.f0_st - 12) < 0.4 for r in f)


def test_streams_equal_batch(spark, tmp_path):
    data = [("a", float(i), v) for i, v in enumerate([1.0, 9.0, 9.0, 1.0, 9.0])] + [("a", 100.0, 9.0), ("a", 101.0, 0.0), ("b", 1.0, 5.0)]
    spark.createDataFrame(data, "key string, t double, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, t double, value double").parquet(str(tmp_path / "in"))
    q = live.live_runs(stream, 6.0, 10.0).writeStream.format("memory").queryName("runs").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert rows(spark.table("runs"), "start", "end", "n") == [(1.0, 2.0, 2), (4.0, 4.0, 1), (100.0, 100.0, 1)]


def test_long_alignments_equal_short_ones(monkeypatch):
    import random

    from tempora.operators import align

    r = random.Random(7)
    words = ["a", "the", "then", "thing", "things", "form", "from", "people", "queue"]
    for n, m in ((1, 1), (1, 9), (9, 1), (2, 30), (40, 33), (0, 4), (4, 0), (0, 0)):
        a, b = ([r.choice(words) for _ in range(k)] for k in (n, m))
        whole = align._steps(a, b)
        monkeypatch.setattr(align, "WHOLE", 0)
        assert align._steps(a, b) == whole
        monkeypatch.undo()


def test_quantiles_are_those_of_sql_to_the_last_bit(spark):
    """A level of exactly twice a floor is below it or not by the floor's last bit."""
    import duckdb

    r = random.Random(8)
    rows = [(clip, round(r.random() * 20, 2)) for clip in range(60) for _ in range(r.randint(1, 90))] + [(3, None)]
    df = spark.createDataFrame(rows, "clip_id int, level double").repartition(5)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (clip_id INT, level DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    assert sorted(map(tuple, edges.floors(df).collect())) == con.execute("SELECT DISTINCT clip_id, quantile_cont(level, 0.05) OVER (PARTITION BY clip_id) FROM t ORDER BY 1").fetchall()
    shares = {"a": 0.25, "b": 0.75, "c": 1.0}
    want = con.execute("SELECT quantile_cont(level, 0.25), quantile_cont(level, 0.75), max(level) FROM t").fetchall()
    assert [tuple(x) for x in series.quantiles(df, [], shares, "level").collect()] == want


def test_a_whole_tables_quartiles_do_not_meet_in_one_task(spark, tmp_path):
    """Without keys, equal values are counted and no aggregate collects all values."""
    spark.range(1000).select((F.col("id") % 10).alias("l_suppkey"), F.col("id").cast("double").alias("l_extendedprice")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = queries.iqr_ratio_groups(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("percentile(l_extendedprice") == 2  # of a supplier, none of the table
    assert sorted((r.l_suppkey, r.n, round(r.ratio, 9)) for r in got.collect()) == [(k, 100, round(495 / 499.5, 9)) for k in range(10)]


def test_flat_stretches_add_up_from_the_last_frame(spark):
    """means of steps that end halfway between two decimals turn on the last bit, which has to be the same however rows are dealt out."""
    dice = random.Random(3)
    clips = {f"c{c}": [(round(dice.uniform(0, 100), 2), round(dice.uniform(0, 100), 2) % 7, dice.random() > 0.2) for _ in range(60)] for c in range(80)}
    data = [(c, i, 1.0 if i == 0 or v else None, level, high) for c, f in clips.items() for i, (level, high, v) in enumerate(f)]
    dice.shuffle(data)
    frames = spark.createDataFrame(data, "clip_id string, frame_i int, f0_st double, inten double, hf double").repartition(7)
    got = series.flat_stretches(frames, least_s=0.03).collect()
    assert len(got) > 80
    for r in got:
        first, last = round(r["start_s"] * 100), round(r["end_s"] * 100) - 1
        steps, total = [abs(clips[r["clip_id"]][i][1] - clips[r["clip_id"]][i - 1][1]) for i in range(last, first, -1)], 0.0
        for x in steps:
            total += x
        assert r["change"] == total / len(steps)
        levels = [clips[r["clip_id"]][i][0] for i in range(first, last + 1)]
        assert abs(r["level_sd"] - statistics.pstdev(levels)) < 1e-9 and r["range_st"] == 0.0


def test_words_are_measured_many_at_once(monkeypatch):
    """F8: pairs of words of all texts of a batch are measured together, with SequenceMatcher's own ratios, long words and shared columns included."""
    dice = random.Random(8)
    letters = ["ab", "abcde", "éèab中文", "qrstuvwxyz"]
    words = sorted({"".join(dice.choice(dice.choice(letters)) for _ in range(dice.choice([1, 2, 3, 5, 8, 13, 40, 64, 65, 210]))) for _ in range(300)})
    known, every = align._Vocabulary(words), np.arange(len(words))
    a, b = (x.ravel() for x in np.meshgrid(every, every))
    want = np.array([align.similarity(words[i], words[j]) for i, j in zip(a[::7], b[::7])])
    assert (known.ratios(a[::7], b[::7]) == want).all()
    may = set(zip(*map(np.ndarray.tolist, known.may_be_similar(every, every))))
    assert all((i, j) in may for i, j, x in zip(a[::7].tolist(), b[::7].tolist(), want) if x > align.SIMILAR)
    # an empty text and short tables among others, scored in groups or alone
    texts = [[dice.choice(words[:40]) for _ in range(dice.choice([0, 1, 5, 30]))] for _ in range(60)]
    alone = [align._steps(*p) for p in zip(texts, texts[1:])]
    assert list(align._paths(zip(texts, texts[1:]))) == alone
    asked = []
    measured = align._Vocabulary.ratios
    monkeypatch.setattr(align._Vocabulary, "ratios", lambda self, x, y: asked.append(len(x)) or measured(self, x, y))
    assert len(list(align._paths([(words[:30], words[10:40])] * 20))) == 20 and len(asked) == 1
