"""Tables of the pages: catalogue, clips of a take, filters, review, pairs, checks, spec coverage."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

# The flaws of the listening pairs in order, and the steps of the ratings.
PAIR_FLAWS = ("FADE", "SHOUT", "PACE_SLOW", "PAUSE_BAD", "FILLER", "PACE_FAST", "WORD_SKIP", "SLUR")
FELT = {"too weak": -1, "right": 0, "too strong": 1}
#: Clips whose tracks are warped at once.
CLIPS = 100


def counted(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def clip_kind(manifest: DataFrame) -> Column:
    """clean, condition, multi or flaw; empty strings and nulls are alike."""
    empty = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) == 0
    return F.when(empty("flaw_codes") & empty("added_condition"), "clean").when(empty("flaw_codes"), "condition").when(~empty("multi_set"), "multi").otherwise("flaw")


def condition_counts(manifest: DataFrame) -> DataFrame:
    named = F.when(F.length(F.coalesce("added_condition", F.lit(""))) > 0, F.col("added_condition")).otherwise("clean")
    return counted(manifest.select(named.alias("condition")), "condition")


def tiles(manifest: DataFrame) -> DataFrame:
    """One row: clips, hours, baselines."""
    return manifest.agg(F.count(F.lit(1)).alias("clips"), F.round(F.sum("duration_s") / 3600, 2).alias("hours"), F.countDistinct("baseline_id").alias("baselines"))


def speakers(manifest: DataFrame) -> DataFrame:
    """A row a baseline with what its first clip says of it."""
    about = ["gender", "age_band", "origin", "register", "split"]
    first = F.min_by(F.struct(*about), "clip_id").alias("about")
    return manifest.groupBy("baseline_id").agg(first, F.count(F.lit(1)).alias("clips")).select("baseline_id", "about.*", "clips")


def single_flaw_grid(manifest: DataFrame, flaws: Sequence[str]) -> DataFrame:
    """Clips of one flaw without a condition, by flaw and level from 1 to 5; every flaw has a row."""
    plain = manifest.filter((F.coalesce("added_condition", F.lit("")) == "") & (F.coalesce("multi_set", F.lit("")) == ""))
    counts = plain.groupBy(F.col("flaw_codes").alias("flaw")).pivot("max_level", [1, 2, 3, 4, 5]).count()
    every = manifest.sparkSession.createDataFrame([(f,) for f in flaws], "flaw string")
    return every.join(counts, "flaw", "left").fillna(0)


def join_checks(labels: DataFrame) -> DataFrame:
    """One row over ``labels(join_check struct<passed, n_joins, share_above_6db>)``: checked clips, share passed, share of joins that are audible."""
    j = labels.filter("join_check is not null").select("join_check.*")
    audible = F.sum(F.col("share_above_6db") * F.col("n_joins")) / F.greatest(F.sum("n_joins"), F.lit(1))
    return j.agg(F.count(F.lit(1)).alias("checked"), F.round(F.avg(F.col("passed").cast("double")), 3).alias("passed"), F.round(audible, 4).alias("audible"))


def searched(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows with ``text`` anywhere in the columns, whatever its case."""
    return df.filter(F.lower(F.concat_ws(" ", *columns)).contains(text.lower()))


def chosen(df: DataFrame, wanted: Mapping[str, Sequence]) -> DataFrame:
    """Rows whose columns are among the wanted values; a column with no wanted value is not looked at."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]).isin(*kv[1])) if kv[1] else d, wanted.items(), df)


def review_pool(clips: DataFrame, rated: DataFrame, take: str, flaw: str, level: int, unreviewed_only: bool = False) -> DataFrame:
    """A take's clips of one flaw without a condition, by level; of reviewed ones only the chosen level's where unreviewed ones are wanted."""
    pool = clips.filter((F.col("take_id") == take) & (F.col("flaw") == flaw) & (F.coalesce("added_condition", F.lit("")) == ""))
    if unreviewed_only:
        new = pool.join(rated.select("clip_id").distinct(), "clip_id", "left_anti")
        pool = new.unionByName(pool.filter(F.col("level") == level)).distinct()
    return pool.orderBy("level")


def pairs(manifest: DataFrame, regions: DataFrame, take: str = "B01-CHAMP", level: int = 4) -> DataFrame:
    """For each flaw of the listening pairs a clean clip and one with the flaw, and the stretches to hear (0.3 s of the clean one at least)."""
    wanted = manifest.sparkSession.createDataFrame([(k, f) for k, f in enumerate(PAIR_FLAWS)], "number int, flaw string")
    tag = F.regexp_extract("clip_id", rf"^{take}_C0__([A-Z_]+)_L{level}_", 1)
    clips = manifest.withColumn("flaw", tag).filter("flaw <> ''").groupBy("flaw").agg(F.min("clip_id").alias("clip_id"))
    heard = regions.filter("rid = 0").select("clip_id", "start_s", F.greatest("end_s", F.col("start_s") + 0.3).alias("end_s"), "baseline_start_s", F.greatest("baseline_end_s", F.col("baseline_start_s") + 0.3).alias("baseline_end_s"))
    return wanted.join(clips, "flaw").join(heard, "clip_id").withColumn("clean", F.lit(f"{take}_C0"))


def truth(regions: DataFrame, clip: str) -> DataFrame:
    return regions.filter(F.col("clip_id") == clip).select("flaw", "level", "start_s", "end_s", F.coalesce("why", F.lit("")).alias("why"))


def flagged_words(words: DataFrame, regions: DataFrame) -> DataFrame:
    """``words(clip_id, i)`` with the first region that holds them, null where none does."""
    spread = regions.select("clip_id", "rid", F.explode(F.sequence("word_start", "word_end")).alias("i"))
    return words.join(spread.groupBy("clip_id", "i").agg(F.min("rid").alias("flag")), ["clip_id", "i"], "left")


def evidence(regions: DataFrame, key: str) -> DataFrame:
    """Per flaw the numbers of one kind of evidence in ``params`` (a map of strings)."""
    value = F.try_element_at("params", F.lit(key)).cast("double")
    told = regions.select("flaw", value.alias("v")).filter("v is not null")
    return told.groupBy("flaw").agg(F.count(F.lit(1)).alias("n"), F.median("v").alias("median"), F.min("v").alias("least"), F.max("v").alias("most"))


def parameters(params: Column, without: Sequence[str] = ("evidence",)) -> Column:
    """A map of parameters as JSON, less those that are told elsewhere."""
    return F.to_json(F.map_filter(params, lambda k, v: ~k.isin(*without)))


def spec_checks(baselines: DataFrame, ages: Sequence[str], registers: Sequence[str], genres: int = 4, each: int = 2) -> DataFrame:
    """``(check, holds)`` of a table of baselines: variety of gender, accent, age, genre and register, and whether all are recordings."""
    per_genre = baselines.groupBy("genre").count()
    even = per_genre.agg((F.min("count") == each) & (F.max("count") == each) & (F.count(F.lit(1)) == genres)).first()[0]
    one = baselines.agg(
        (F.countDistinct("gender") >= 2).alias("two genders"),
        ((F.countDistinct("accent") >= 2) & (F.count_if(F.col("accent").rlike("Indian|Tamil")) >= 1)).alias("two accents, one Indian"),
        F.forall(F.array(*[F.lit(a) for a in ages]), lambda a: F.array_contains(F.collect_set("age_band"), a)).alias("every age band"),
        F.forall(F.array(*[F.lit(r) for r in registers]), lambda r: F.array_contains(F.collect_set("register"), r)).alias("wanted registers"),
        (F.min(F.col("status").startswith("real").cast("int")) == 1).alias("all recorded"),
    ).withColumn("genres even", F.lit(bool(even)))
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in one.columns]), F.array(*[F.col(f"`{c}`") for c in one.columns]))).alias("check", "holds"))


def level_ladder(ratings: DataFrame) -> DataFrame:
    """Per flaw and level how it felt, from -1 (too weak) to 1 (too strong): ``ratings(flaw, level, level_feel)``."""
    felt = F.try_element_at(F.create_map(*[F.lit(x) for kv in FELT.items() for x in kv]), F.col("level_feel"))
    return ratings.groupBy("flaw", "level").agg(F.avg(felt).alias("felt"), F.count(felt).alias("n"))


def join_verdict(click_db: Column) -> Column:
    return F.when(click_db < 12, "smooth").when(click_db < 18, "listen closely").otherwise("likely audible click")


def told_share(a: Column, b: Column) -> Column:
    """``a of b (p%)``."""
    share = F.when(b > 0, F.format_string("%.0f%%", 100 * a / b)).otherwise("n/a")
    return F.concat(a.cast("string"), F.lit(" of "), b.cast("string"), F.lit(" ("), share, F.lit(")"))


def every_nth(frames: DataFrame, value: str, step: int = 5, digits: int = 2) -> DataFrame:
    """Each ``step``-th frame's value, rounded; null where unvoiced."""
    return frames.filter(F.col("frame_i") % step == 0).select("clip_id", (F.col("frame_i") / step).cast("int").alias("i"), F.round(value, digits).alias("v"))


def waveform(samples: DataFrame, bins: int = 1400) -> DataFrame:
    """Lowest and highest sample of each of ``bins`` equal stretches, by the loudest sample: ``samples(clip_id, samples array<float>)``."""
    peak = F.coalesce(F.nullif(F.greatest(F.abs(F.array_max("samples")), F.abs(F.array_min("samples"))), F.lit(0.0)), F.lit(1.0))
    width = F.floor(F.size("samples") / bins).cast("int")
    cut = samples.withColumns({"peak": peak, "width": width}).filter("width > 0").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    part = F.slice("samples", F.col("bin") * F.col("width") + 1, F.col("width"))
    return cut.select("clip_id", "bin", F.round(F.array_min(part) / F.col("peak"), 3).alias("low"), F.round(F.array_max(part) / F.col("peak"), 3).alias("high"))


def speaking_rates(words: DataFrame, digits: int | None = 2) -> DataFrame:
    """Syllables a second of each word, and three quarters to four thirds of the clip's median as the usual band: ``words(clip_id, i, syllables, start_s, end_s)``."""
    shown = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    rate = words.withColumn("rate", shown(F.col("syllables") / F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.05))))
    band = rate.groupBy("clip_id").agg(shown(0.75 * F.median("rate")).alias("low"), shown(1.33 * F.median("rate")).alias("high"))
    return rate.join(band, "clip_id")


def warped(path: DataFrame, reference: DataFrame, own: DataFrame, value: str) -> DataFrame:
    """The reference's ``value`` at each participant frame: reference frames are interpolated between the path's (mean of equal ones) and rounded."""
    frames = own.groupBy("clip_id").agg(F.collect_list("frame_i").alias("frames"))  # a clip's frames
    values = reference.groupBy("clip_id").agg(F.collect_list(F.struct("frame_i", F.col(value).cast("double").alias("v"))).alias("values"))  # likewise
    tracks = frames.join(values, "clip_id", "left").select("clip_id", "frames", F.col("values.frame_i").alias("at"), F.col("values.v").alias("v"))
    return warped_tracks(path, tracks)


def warped_tracks(path: DataFrame, tracks: DataFrame) -> DataFrame:
    """``warped`` for ``tracks(clip_id, frames, at, v)``, a row a clip: its own frames, and frames of the reference with their values.

    Clips meet their path by their id alone, and a batch of clips is worked
    out at once: frames are keyed by clip and number, so places are found by
    one search in the order of the keys.
    """
    knots = path.groupBy("clip_id", "par_frame").agg(F.avg("ref_frame").alias("r")).filter("r is not null")
    of_clip = knots.groupBy("clip_id").agg(F.collect_list(F.struct("par_frame", "r")).alias("k"))  # at most a clip's frames
    both = tracks.join(of_clip, "clip_id", "left").select("clip_id", "frames", "at", "v", F.col("k.par_frame").alias("f"), F.col("k.r").alias("r"))
    schema = StructType([tracks.schema["clip_id"], StructField("frame_i", tracks.schema["frames"].dataType.elementType), StructField("v", DoubleType())])
    made = to_arrow_schema(schema)

    def flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
        """The row of each element, and the elements."""
        return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)), lists.flatten()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, CLIPS) for whole in batches for i in range(0, whole.num_rows, CLIPS)):
            (clip, frames), (of_at, at), (_, v), (of_f, f), (_, r) = (flat(b[c]) for c in ("frames", "at", "v", "f", "r"))
            number = [x.cast(pa.int64()).to_numpy(zero_copy_only=False) for x in (frames, at, f)]
            low = min((int(x.min()) for x in number if len(x)), default=0) - 1
            width = max((int(x.max()) for x in number if len(x)), default=0) - low + 2
            own, of_reference, known = (k * width + (x - low) for k, x in zip((clip, of_at, of_f), number))
            asked = np.full(len(own), np.nan)
            if len(known):
                order = np.argsort(known, kind="stable")
                known, means = known[order], r.to_numpy(zero_copy_only=False)[order]
                after = np.searchsorted(known, own)
                before = np.searchsorted(known, own, side="right") - 1
                top = len(known) - 1
                a, z = np.clip(before, 0, top), np.clip(after, 0, top)
                has_a, has_z = (before >= 0) & (known[a] // width == clip), (after <= top) & (known[z] // width == clip)
                a, z = np.where(has_a, a, z), np.where(has_z, z, a)
                span = known[z] - known[a]
                there = means[a] + (means[z] - means[a]) * (own - known[a]) / np.maximum(span, 1)
                asked = np.where(has_a | has_z, np.rint(np.where(span > 0, there, means[a])), np.nan)
            found = np.full(len(own), -1)
            if len(of_reference):
                order = np.argsort(of_reference, kind="stable")
                inside = (asked > low) & (asked < low + width - 1)
                key = np.where(inside, clip * width + np.where(inside, asked - low, 0).astype(np.int64), -1)
                place = np.clip(np.searchsorted(of_reference[order], key), 0, len(order) - 1)
                found = np.where(of_reference[order][place] == key, order[place], -1)
            told = v.take(pa.array(np.where(found < 0, 0, found), mask=found < 0))
            yield pa.RecordBatch.from_arrays([b["clip_id"].take(pa.array(clip)), frames, told.cast(pa.float64())], schema=made)

    return both.mapInArrow(run, schema)
