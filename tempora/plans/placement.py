"""Where a benchmark's flaws go: jobs, splits, windows, boundaries, reservations, labels, times after edits.

Plans over tables of takes and words; the sound itself is made elsewhere.
Random choices are hashes of a seed and the row, so they need no state.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from tempora.functions.text import seed_of
from tempora.operators import series
from tempora.operators.compare import CLAUSE_ENDS
from tempora.operators.detect import CATEGORY

# The flaws in order, the combinations, the conditions and the baselines held out.
FLAWS = tuple("PACE_FAST PACE_SLOW PAUSE_BAD PAUSE_LOST MONOTONE UPTALK EMPH_FLAT FADE SHOUT FILLER REPEAT RARE_HESIT SLUR WORD_SKIP WORD_SWAP".split())
COMBINATIONS = (("PACE_FAST", "FADE"), ("PAUSE_BAD", "MONOTONE"), ("FILLER", "UPTALK", "SLUR"), ("EMPH_FLAT", "PACE_SLOW", "SHOUT"), ("REPEAT", "RARE_HESIT", "WORD_SWAP"))
CONDITIONS = ("N20", "N10", "RVB", "PHN", "MP3", "GAIN")
SPLITS = {"test": ("B05", "B08"), "dev": ("B03",), "extra": ("B09", "B10")}
COMBINED_LEVEL, MOST_REGIONS = 3, 3
# What a level of a flaw does, level 1 first.
LEVELS = {
    "PACE_FAST": (1.10, 1.20, 1.35, 1.50, 1.75), "PACE_SLOW": (0.90, 0.80, 0.70, 0.60, 0.50), "PAUSE_BAD": (0.3, 0.6, 1.0, 1.6, 2.5), "PAUSE_LOST": (0.20, 0.40, 0.60, 0.80, 1.00),
    "MONOTONE": (0.8, 0.6, 0.4, 0.2, 0.0), "UPTALK": (1, 2, 4, 6, 8), "EMPH_FLAT": (0.25, 0.40, 0.60, 0.80, 1.00), "FADE": (-3, -6, -10, -15, -20), "SHOUT": (2, 4, 6, 9, 12),
    "FILLER": (1, 2, 3, 5, 8), "RARE_HESIT": (0.2, 0.4, 0.7, 1.0, 1.5), "SLUR": (-3, -6, -9, -12, -16), "WORD_SKIP": (1, 2, 3, 5, 8), "WORD_SWAP": (1, 2, 3, 5, 8),
}
# Words that carry a contrast or a negation.
NEGATIONS = "not never no nobody nothing none neither nor cannot".split()
CONTRASTS = "but only even just still yet however although instead rather except".split()
# Age groups of one source as bands.
AGE_GROUPS = {"18-30": "18-25", "30-45": "26-45", "45-60": "46-65", "60+": "65+"}


def one_of(values: Mapping[str, object], key: Column, default: Column | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, default)


# ---------------------------------------------------------------- takes and jobs


def split_of(baseline: Column) -> Column:
    return reduce(lambda rest, s: F.when(baseline.isin(*SPLITS[s]), s).otherwise(rest), ("extra", "dev", "test"), F.lit("train"))


def age_band(age: Column) -> Column:
    """The band of a number of years, or of a group's name."""
    years = age.cast("string").try_cast("double")
    return F.when(years <= 25, "18-25").when(years <= 45, "26-45").when(years <= 65, "46-65").when(years > 65, "65+").otherwise(one_of(AGE_GROUPS, age.cast("string")))


def clip_id(take: Column, condition: Column, tag: Column, level: Column) -> Column:
    """``take_condition``, and for a flawed clip ``__tag_Llevel_sseed``."""
    clean = F.concat_ws("_", take, F.coalesce(condition, F.lit("C0")))
    return F.when(tag.isNull(), clean).otherwise(F.format_string("%s__%s_L%d_s%04d", clean, tag, level.cast("long"), seed_of(take, tag)))


def _job(tag: Column, flaws: Column, level: Column, condition: Column, pure: bool = False, seed_tag: Column | None = None, together: Column | None = None) -> Column:
    return F.struct(
        tag.alias("tag"), flaws.alias("flaws"), level.cast("int").alias("level"), condition.cast("string").alias("condition"), F.lit(pure).alias("pure"),
        F.coalesce(seed_tag, tag).alias("seed_tag") if seed_tag is not None else tag.alias("seed_tag"), (together if together is not None else F.lit(None).cast("array<string>")).alias("multi_set"),
    )


def _jobs(takes: DataFrame, jobs: list[Column]) -> DataFrame:
    made = takes.select("take_id", F.posexplode(F.array(*jobs)).alias("place", "job")).select("take_id", "place", "job.*")
    return made.withColumn("clip_id", clip_id(F.col("take_id"), F.col("condition"), F.col("tag"), F.col("level")))


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def flaw_grid(takes: DataFrame, levels: Sequence[int], combined: bool = True, condition: str | None = None) -> DataFrame:
    """A job for each take, flaw and level, and for each combination: ``takes(take_id)``."""
    where = F.lit(condition).cast("string")
    jobs = [_job(F.lit(f), _texts([f]), F.lit(n), where) for f in FLAWS for n in levels]
    if combined:
        jobs += [_job(F.lit(f"MULTI{k}"), _texts(c), F.lit(COMBINED_LEVEL), where, together=_texts(c)) for k, c in enumerate(COMBINATIONS, 1)]
    return _jobs(takes, jobs)


def pure_grid(takes: DataFrame) -> DataFrame:
    """The same flaws with a single cue each, at the places of the others."""
    return _jobs(takes, [_job(F.lit(f"PURE_{f}"), _texts([f]), F.lit(n), F.lit(None), True, F.lit(f)) for f in FLAWS for n in range(1, 6)])


def condition_jobs(takes: DataFrame) -> DataFrame:
    """The clean take under each condition."""
    return _jobs(takes, [_job(F.lit(None).cast("string"), _texts([]).cast("array<string>"), F.lit(None), F.lit(c)) for c in CONDITIONS])


def champions(baselines: DataFrame) -> DataFrame:
    return baselines.select(F.concat("baseline_id", F.lit("-CHAMP")).alias("take_id"))


def distinct_jobs(*jobs: DataFrame) -> DataFrame:
    """All jobs, of those of one clip the first."""
    every = reduce(DataFrame.unionByName, [j.withColumn("list", F.lit(k)) for k, j in enumerate(jobs)])
    first = Window.partitionBy("clip_id").orderBy("list", "place")
    return every.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k", "list", "place")


def not_done(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs whose clip is not there yet."""
    return jobs.join(done.select("clip_id"), "clip_id", "left_anti")


def who_and_where(takes: DataFrame) -> DataFrame:
    """``takes(take_id, age_band, accent, gender, origin, register, status, condition)`` with the label's ``who`` and ``where``."""
    who = F.struct(
        F.element_at(F.split("take_id", "-"), 2).alias("speaker_id"), "age_band", "accent", "gender", F.lit("typical").alias("fluency_profile"),
        (F.col("status") == "placeholder_tts").alias("synthetic_voice"), "origin", "register",
    )
    return takes.withColumn("who", who).withColumn("where", F.struct(F.lit("C0").alias("base_condition"), F.col("condition").alias("added_condition")))


def region_count(*seed: Column) -> Column:
    """A number of regions from 1 to the most, from a hash."""
    return (1 + F.pmod(F.xxhash64(*seed), F.lit(MOST_REGIONS))).cast("int")


# ---------------------------------------------------------------- places


def word_windows(words: DataFrame, zones: DataFrame, low_s: float, high_s: float, prefer_clauses: bool = True) -> DataFrame:
    """``(take_id, i0, i1, start_s, end_s)``: stretches of words of ``low_s`` to ``high_s`` within a take's zone.

    Where three or more of a take's stretches go from one stop to another, only
    these.  ``words(take_id, i, start_s, end_s, punct)``, ``zones(take_id,
    zone_start, zone_end)``.  A first word meets last words in its own and the
    next bucket of time only.
    """
    w = Window.partitionBy("take_id").orderBy("i")
    inside = words.join(zones, "take_id").withColumn("opens", F.coalesce(F.length(F.lag("punct").over(w)) > 0, F.lit(True)))
    firsts = inside.filter("start_s >= zone_start").select("take_id", F.col("i").alias("i0"), "start_s", "opens", F.explode(F.expr(f"sequence(cast(floor(start_s / {high_s}) as int), cast(floor(start_s / {high_s}) as int) + 1)")).alias("bucket"))
    lasts = inside.filter("end_s <= zone_end").select("take_id", F.col("i").alias("i1"), "end_s", (F.length("punct") > 0).alias("closes"), F.floor(F.col("end_s") / high_s).cast("int").alias("bucket"))
    length = F.col("end_s") - F.col("start_s")
    found = firsts.join(lasts, ["take_id", "bucket"]).filter((F.col("i1") >= F.col("i0")) & (length >= low_s) & (length <= high_s))
    if prefer_clauses:
        nice = F.col("opens") & F.col("closes")
        found = found.withColumn("_nice", F.count_if(nice).over(Window.partitionBy("take_id")) >= 3).filter(~F.col("_nice") | nice)
    return found.select("take_id", "i0", "i1", "start_s", "end_s")


def claimed(places: DataFrame, order: Sequence[Column], most: Column | int | None = None, margin_s: float = 0.2) -> DataFrame:
    """Places of a take that are free when their turn comes in ``order``: none within ``margin_s`` of one taken before, ``most`` in all.

    What is taken decides what is free, so a take's places are gone through in
    order.
    """
    limit = F.lit(2**31 - 1) if most is None else F.lit(most) if isinstance(most, int) else most
    names, told = places.columns, places.withColumn("_most", limit.cast("int"))

    def take(rows: Iterator[dict]) -> Iterator[dict]:
        held: list[tuple[float, float]] = []
        for r in rows:
            if len(held) < r["_most"] and all(r["end_s"] + margin_s <= a or r["start_s"] - margin_s >= b for a, b in held):
                held.append((r["start_s"], r["end_s"]))
                yield {c: r[c] for c in names}

    return series.folded(told, ["take_id"], list(order), take, places.schema)


def picked_windows(words: DataFrame, zones: DataFrame, n: int, low_s: float, high_s: float, seed: int = 0, prefer_clauses: bool = True) -> DataFrame:
    """``n`` free windows of each take in a hashed order; a take without any looks among somewhat shorter and longer ones."""
    usual = word_windows(words, zones, low_s, high_s, prefer_clauses)
    others = word_windows(words, zones, low_s * 0.6, high_s * 1.3, False).join(usual.select("take_id").distinct(), "take_id", "left_anti")
    return claimed(usual.unionByName(others), [F.xxhash64(F.lit(seed), "i0", "i1"), F.col("i0"), F.col("i1")], n)


def word_boundaries(words: DataFrame, zones: DataFrame) -> DataFrame:
    """``(take_id, k, t0, t1)``: boundaries after the third word and before the last two within a take's zone, with the times around them."""
    w = Window.partitionBy("take_id")
    after = words.withColumns({"t1": F.lead("start_s").over(w.orderBy("i")), "n": F.count(F.lit(1)).over(w)}).join(zones, "take_id")
    kept = after.filter("i >= 2 and i <= n - 4 and end_s >= zone_start and t1 <= zone_end")
    return kept.select("take_id", F.col("i").alias("k"), F.col("end_s").alias("t0"), "t1")


def edges_off_words(regions: DataFrame, words: DataFrame, tolerance_s: float = 0.021, skip_s: float = 0.06) -> DataFrame:
    """Changed or removed regions an edge of which is not at a word's edge, as ``(clip_id, rid, start_gap, end_gap)``; lost pauses are left out."""
    from tempora.operators import intervals

    asked = regions.filter(F.col("kind").isin("modify", "delete") & (F.col("flaw") != "PAUSE_LOST"))
    edges = words.select("take_id", F.col("start_s").alias("t"), F.lit(0).alias("e")).union(words.select("take_id", "end_s", F.lit(0)))
    out = asked.withColumn("limit", F.when(F.col("flaw") == "WORD_SKIP", skip_s).otherwise(tolerance_s))
    for at, name in (("baseline_start_s", "start_gap"), ("baseline_end_s", "end_gap")):
        out = intervals.nearest(out.withColumn("t", F.col(at)), edges, ["take_id"], "t", ["e"]).withColumnRenamed("gap", name).drop("t", "r_t", "r_e")
    return out.filter("start_gap is null or end_gap is null or start_gap >= limit or end_gap >= limit").select("clip_id", "rid", "start_gap", "end_gap")


# ---------------------------------------------------------------- words that matter


def focal_words(words: DataFrame) -> DataFrame:
    """``(take_id, i, why)`` of words that carry meaning.

    ``words(take_id, i, w, clean, pos, tag, lemma, content, btype)``: numbers,
    negations, contrasts, superlatives, a noun's first mention, the last
    content word of a phrase; the first of these that holds.
    """
    noun = F.col("pos").isin("NOUN", "PROPN")
    mention = F.row_number().over(Window.partitionBy("take_id", noun, "lemma").orderBy("i"))
    last = F.max("i").over(Window.partitionBy("take_id"))
    told = words.withColumns({"_mention": mention, "_last": last})
    digit = F.col("w").rlike("[0-9]")
    why = (
        F.when((F.length("clean") == 0) & ~digit, F.lit(None))
        .when((F.col("pos") == "NUM") | digit, "number")
        .when(F.col("clean").isin(NEGATIONS) | F.col("clean").endswith("n't"), "negation")
        .when(F.col("clean").isin(CONTRASTS), "contrast")
        .when(F.col("tag").isin("JJS", "RBS") | (F.col("clean").endswith("est") & F.col("pos").isin("ADJ", "ADV")), "superlative")
        .when(noun & (F.col("_mention") == 1), "first mention")
        .when(F.col("content") & ((F.col("i") == F.col("_last")) | F.col("btype").isin(*CLAUSE_ENDS)), "nuclear accent")
    )
    return told.withColumn("why", why).filter("why is not null").select("take_id", "i", "why")


def best_windows(windows: DataFrame, prominence: DataFrame, focal: DataFrame, per_window: int = 3, seed: int = 0) -> DataFrame:
    """``windows`` with their ``per_window`` most prominent focal words and a rank: the sum of these prominences, shaken by up to a half."""
    strong = prominence.join(focal, ["take_id", "i"]).select("take_id", F.col("i").alias("j"), "prominence")
    met = windows.withColumn("j", F.explode(F.sequence("i0", "i1"))).join(strong, ["take_id", "j"])
    keys = ["take_id", "i0", "i1", "start_s", "end_s"]
    ranked = met.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("prominence"), "j")))
    shaken = 0.5 * F.pmod(F.xxhash64(F.lit(seed), "i0", "i1"), F.lit(1000)) / 1000
    told = ranked.groupBy(*keys).agg(F.sum(F.greatest("prominence", F.lit(0.0))).alias("score"), F.sort_array(F.collect_list(F.when(F.col("_k") <= per_window, F.col("j")))).alias("words"))
    order = Window.partitionBy("take_id").orderBy(F.desc(F.col("score") + shaken), "i0", "i1")
    return told.withColumn("rank", F.row_number().over(order))


def weak_vowels(words: DataFrame, at_s: Column, most: int = 14) -> DataFrame:
    """The ``most`` words nearest to a time whose vowel is a schwa: short a, of, the before a consonant, without a stop after them."""
    w = Window.partitionBy("take_id").orderBy("i")
    later = F.substring(F.lead("clean").over(w), 1, 1)
    short = (F.length("punct") == 0) & (F.col("end_s") - F.col("start_s")).between(0.05, 0.30)
    fits = F.col("clean").isin("a", "of") | ((F.col("clean") == "the") & (F.length(later) > 0) & ~later.isin("a", "e", "i", "o", "u"))
    near = words.withColumn("_fits", F.coalesce(short & fits, F.lit(False))).filter("_fits").withColumn("gap", F.abs(F.col("start_s") - at_s))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("take_id").orderBy("gap", "i")))
    return ranked.filter(F.col("rank") <= most).select("take_id", "i", "gap", "rank")


# ---------------------------------------------------------------- labels


def with_category(regions: DataFrame) -> DataFrame:
    return regions.withColumn("category", one_of(CATEGORY, F.col("flaw")))


def level_value(flaw: Column, level: Column) -> Column:
    """What a flaw's level does, null where the flaw has no such level."""
    table = F.create_map(*[x for f, values in LEVELS.items() for x in (F.lit(f), F.array(*[F.lit(float(v)) for v in values]))])
    return F.try_element_at(F.try_element_at(table, flaw), level.cast("int"))


def context(words: Column, k0: Column, k1: Column | None = None, width: int = 3, mark: str = "⟦…⟧") -> Column:
    """A snippet of an array of words: around the boundary after ``k0`` (from 0), or around the words ``k0`` to ``k1`` in brackets."""
    if k1 is None:
        left = F.slice(words, F.greatest(F.lit(1), k0 - width + 2), F.least(k0 + 1, F.lit(width)))
        right = F.slice(words, k0 + 2, F.lit(width))
        return F.trim(F.concat_ws(" ", F.array_join(left, " "), F.lit(mark), F.array_join(right, " ")))
    left = F.slice(words, F.greatest(F.lit(1), k0 - width + 1), F.least(k0, F.lit(width)))
    middle = F.concat(F.lit("["), F.array_join(F.slice(words, k0 + 1, k1 - k0 + 1), " "), F.lit("]"))
    return F.trim(F.concat(F.array_join(left, " "), F.lit(" "), middle, F.lit(" "), F.array_join(F.slice(words, k1 + 2, F.lit(width)), " ")))


# How a boundary is told.
BOUNDARIES = {
    "sentence": "after the full stop following '%1$s'", "clause_punct": "at the comma after '%1$s'", "before_coord": "before the conjunction '%2$s'",
    "before_subord": "before the clause opener '%2$s'", "before_relative": "before the relative word '%2$s'", "after_discourse": "after the discourse marker '%1$s'",
    "phrase_tight": "inside a tight phrase, between '%1$s' and '%2$s'", "phrase_loose": "between phrases, '%1$s' | '%2$s'",
}


def described(btype: Column, before: Column, after: Column) -> Column:
    """A boundary in words; an unknown kind is told as it is."""
    return reduce(lambda rest, b: F.when(btype == b, F.format_string(BOUNDARIES[b], before, after)).otherwise(rest), BOUNDARIES, btype)


def retimed(edits: DataFrame, sr: int, fade: int = 0) -> DataFrame:
    """``edits(clip_id, a, b, n)``: samples a to b replaced by n new ones, with the times of both in the old and the new sound.

    A running sum of what the edits before it added says how far one is moved;
    each join takes ``fade`` samples off both sides.
    """
    w = Window.partitionBy("clip_id").orderBy("a", "b")
    added = F.coalesce(F.sum(F.col("n") - (F.col("b") - F.col("a"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joins = F.coalesce(F.sum(1 + (F.col("n") > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.greatest(F.lit(0), F.col("a") + added - fade * joins - F.when(F.col("n") > 0, fade).otherwise(fade // 2))
    end = F.when(F.col("n") > 0, F.col("a") + added - fade * joins - fade + F.col("n") - fade).otherwise(start)
    return edits.withColumns({
        "start_s": start / sr, "end_s": end / sr, "baseline_start_s": F.col("a") / sr, "baseline_end_s": F.col("b") / sr,
    })


def join_gate(clicks: DataFrame, most_db: float = 12.0, usual_db: float = 6.0, share: float = 0.05) -> DataFrame:
    """Per clip and attempt whether its joins are inaudible: ``clicks(clip_id, attempt, click_db)``; and which attempt is the best."""
    told = clicks.groupBy("clip_id", "attempt").agg(
        F.max("click_db").alias("max_click_db"), F.count(F.lit(1)).alias("n_joins"), F.avg((F.col("click_db") > usual_db).cast("double")).alias("share_above")
    ).withColumn("passed", (F.col("share_above") <= share) & (F.col("max_click_db") <= most_db))
    order = Window.partitionBy("clip_id").orderBy(F.desc("passed"), F.when(F.col("passed"), F.col("attempt")), "share_above", "max_click_db", "attempt")
    return told.withColumn("best", F.row_number().over(order) == 1)
