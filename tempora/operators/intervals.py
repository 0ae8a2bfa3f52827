"""Intervals: overlap, likeness, nearest and as-of joins, one-to-one matching, consensus, arbitration.

Range joins are equi-joins on the key and a time bucket: an interval is dealt
to the buckets it touches and a pair is taken in the first bucket both touch,
so the work follows the overlaps and no key's pairs are all formed.  Three
measures of overlap are kept apart: ``iou`` with widening for evaluation,
without for consensus, and overlap by the shorter one for arbitration.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from tempora.operators import series

WIDEST = 0.30


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Strict: touching intervals do not overlap."""
    return F.least(a1, b1) > F.greatest(a0, b0)


def widened(start: Column, end: Column, least: float = WIDEST) -> tuple[Column, Column]:
    """An interval shorter than ``least`` grows to it about its middle."""
    short, middle = end - start < least, (start + end) / 2
    return F.when(short, middle - least / 2).otherwise(start), F.when(short, middle + least / 2).otherwise(end)


def iou(a0: Column, a1: Column, b0: Column, b1: Column, least: float = 0.0) -> Column:
    if least:
        (a0, a1), (b0, b1) = widened(a0, a1, least), widened(b0, b1, least)
    both = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    whole = (a1 - a0) + (b1 - b0) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def share_of_shorter(a0: Column, a1: Column, b0: Column, b1: Column, floor: float = 0.05) -> Column:
    both = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return both / F.greatest(F.lit(floor), F.least(a1 - a0, b1 - b0))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], width: float, margin: float = 0.0, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Pairs of equal keys whose intervals overlap (strictly, the left one widened by ``margin`` on both sides).

    The columns of ``left`` keep their names and those of ``right`` get ``r_``.
    ``width`` is the bucket: about the length of a usual interval.
    """

    def dealt(df: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
        first, last = F.floor(low / width).cast("long"), F.floor(high / width).cast("long")
        return df.withColumn(f"_{name}0", first).withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, last))))

    a = dealt(left, F.col(start) - margin, F.col(end) + margin, "a")
    b = right.select(*[F.col(k) for k in keys], *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    b = dealt(b, F.col(f"r_{start}"), F.col(f"r_{end}"), "b")
    pairs = a.join(b, [*keys, "_bucket"]).filter(F.col("_bucket") == F.greatest("_a0", "_b0"))
    pairs = pairs.filter(overlaps(F.col(start) - margin, F.col(end) + margin, F.col(f"r_{start}"), F.col(f"r_{end}")))
    return pairs.drop("_bucket", "_a0", "_b0")


def without_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], own: Sequence[str], width: float, margin: float = 0.0, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Rows of ``left`` (told apart by ``keys`` and ``own``) that overlap nothing in ``right``."""
    met = overlap_join(left, right, keys, width, margin, start, end).select(*keys, *own).distinct()
    return left.join(met, [*keys, *own], "left_anti")


def _merged(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, carry: Sequence[str]) -> DataFrame:
    """Both sides in one table by time, so neighbours are found by one sort per key instead of a range join."""
    mine = left.select("*", F.lit(True).alias("_left"), *[F.lit(None).cast(t).alias(f"r_{c}") for c, t in right.select(at, *carry).dtypes])
    theirs = right.select(*[F.col(k) for k in keys], F.col(at), F.lit(False).alias("_left"), *[F.col(c).alias(f"r_{c}") for c in (at, *carry)])
    return mine.unionByName(theirs, allowMissingColumns=True)


def asof_before(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, carry: Sequence[str]) -> DataFrame:
    """Each left row with the last right row at or before it (of equal times the largest ``carry``); null where none is."""
    both = _merged(left, right, keys, at, carry)
    order = [F.col(at), F.col("_left"), *[F.col(f"r_{c}") for c in carry]]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(~F.col("_left"), F.struct(*[f"r_{c}" for c in (at, *carry)])), ignorenulls=True).over(w)
    return both.withColumn("_r", last).filter("_left").select(*left.columns, *[F.col(f"_r.r_{c}").alias(f"r_{c}") for c in (at, *carry)])


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, carry: Sequence[str], most: float | None = None) -> DataFrame:
    """Each left row with the right row nearest in time; the earlier of two equally near, then the smallest ``carry``."""
    both = _merged(left, right, keys, at, carry)
    theirs = F.when(~F.col("_left"), F.struct(*[f"r_{c}" for c in (at, *carry)]))
    up = Window.partitionBy(*keys).orderBy(F.col(at), F.col("_left"), *[F.desc(f"r_{c}") for c in carry])
    down = Window.partitionBy(*keys).orderBy(F.col(at), F.desc("_left"), *[F.asc(f"r_{c}") for c in carry])
    before = F.last(theirs, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(theirs, ignorenulls=True).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = both.withColumn("_before", before).withColumn("_after", after).filter("_left")
    gap_before, gap_after = F.col(at) - F.col(f"_before.r_{at}"), F.col(f"_after.r_{at}") - F.col(at)
    one = F.when(gap_after.isNull() | (gap_before <= gap_after), F.col("_before")).otherwise(F.col("_after"))
    found = found.withColumn("_one", one).withColumn("gap", F.abs(F.col(at) - F.col(f"_one.r_{at}")))
    if most is not None:
        found = found.withColumn("_one", F.when(F.col("gap") <= most, F.col("_one"))).withColumn("gap", F.when(F.col("gap") <= most, F.col("gap")))
    return found.select(*left.columns, *[F.col(f"_one.r_{c}").alias(f"r_{c}") for c in (at, *carry)], "gap")


def islands(df: DataFrame, keys: Sequence[str], start: str = "start_s", end: str = "end_s") -> DataFrame:
    """``df`` with ``island``: rows of a key that no row of another island overlaps (strictly)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("_opens", F.coalesce(F.col(start) >= reach, F.lit(True)).cast("long"))
    return opened.withColumn("island", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_opens")


def one_to_one(pairs: DataFrame, keys: Sequence[str], i: str, j: str, best_first: Sequence[Column], low: Column, high: Column) -> DataFrame:
    """Greedy matching of candidate ``pairs``: the best of all pairs of a key, then the best of what is left, and so on.

    ``best_first`` must order the pairs of a key totally.  ``low`` and ``high``
    are a stretch that a pair shares with all pairs of its rows, so pairs of
    different islands of stretches do not compete and are taken apart.
    """
    dealt = islands(pairs.withColumn("_from", low).withColumn("_to", high), keys, "_from", "_to")
    alone = F.count(F.lit(1)).over(Window.partitionBy(*keys, "island")) == 1
    dealt, names = dealt.withColumn("_alone", alone), pairs.columns

    def take(rows: Iterator[dict]) -> Iterator[dict]:
        used_i, used_j = set(), set()
        for row in rows:
            if row[i] not in used_i and row[j] not in used_j:
                used_i.add(row[i])
                used_j.add(row[j])
                yield {c: row[c] for c in names}

    contested = series.folded(dealt.filter("not _alone").drop("_alone", "_from", "_to"), [*keys, "island"], best_first, take, pairs.schema)
    return dealt.filter("_alone").select(names).unionByName(contested)


def matched(truth: DataFrame, found: DataFrame, threshold: float, keys: Sequence[str] = ("clip_id",), same: Sequence[str] = ("flaw",), width: float = 5.0) -> DataFrame:
    """One-to-one matches of ``truth(i)`` and ``found(j)`` regions with IoU of at least ``threshold``; equal ones go to larger i, j."""
    right = found.withColumnRenamed("i", "j") if "i" in found.columns else found

    def wide(df: DataFrame) -> DataFrame:
        low, high = widened(F.col("start_s"), F.col("end_s"), WIDEST)
        return df.withColumn("_ws", low).withColumn("_we", high)

    pairs = overlap_join(wide(truth), wide(right), [*keys, *same], width, start="_ws", end="_we")
    good = pairs.withColumn("iou", iou(F.col("_ws"), F.col("_we"), F.col("r__ws"), F.col("r__we"))).filter(F.col("iou") >= threshold).withColumnRenamed("r_j", "j")
    low, high = F.least("_ws", "r__ws"), F.greatest("_we", "r__we")
    good = good.withColumn("_low", low).withColumn("_high", high).drop("_ws", "_we", "r__ws", "r__we")
    return one_to_one(good, keys, "i", "j", [F.desc("iou"), F.desc("i"), F.desc("j")], F.col("_low"), F.col("_high")).drop("_low", "_high")


def matched_onsets(truth: DataFrame, found: DataFrame, collar: float = 0.25, keys: Sequence[str] = ("clip_id",), same: Sequence[str] = ("flaw",)) -> DataFrame:
    """One-to-one matches of starts at most ``collar`` apart, nearest first; equal ones go to smaller i, j."""
    point = truth.withColumn("_s", F.col("start_s") - collar).withColumn("_e", F.col("start_s") + collar + 1e-9)
    other = found.select(*keys, *same, F.col("j"), F.col("start_s").alias("other"), F.col("start_s").alias("_s"), (F.col("start_s") + 1e-9).alias("_e"))
    pairs = overlap_join(point, other, [*keys, *same], max(4 * collar, 1e-3), start="_s", end="_e")
    good = pairs.withColumn("gap", F.abs(F.col("start_s") - F.col("r_other"))).filter(F.col("gap") <= collar)
    good = good.select(*keys, *same, "i", F.col("r_j").alias("j"), "gap", "start_s", F.col("r_other").alias("r_start_s"))
    low, high = F.least("start_s", "r_start_s") - collar, F.greatest("start_s", "r_start_s") + collar
    return one_to_one(good, keys, "i", "j", [F.asc("gap"), F.asc("i"), F.asc("j")], low, high)


def voted(candidates: DataFrame, primary: str, need: int = 2, least_iou: float = 0.3, width: float = 5.0) -> DataFrame:
    """Candidates of the ``primary`` reference that enough references of the clip support.

    ``candidates(clip_id, ref_id, flaw, start_s, end_s, id)``.  A reference
    supports one of the same flaw with enough IoU; a clip with one reference
    passes through.  ``agreeing`` counts references, the primary included.
    """
    refs = candidates.groupBy("clip_id").agg(F.countDistinct("ref_id").alias("n_refs"))
    own, others = candidates.filter(F.col("ref_id") == primary), candidates.filter(F.col("ref_id") != primary)
    pairs = overlap_join(own, others, ["clip_id", "flaw"], width)
    good = pairs.filter(iou(F.col("start_s"), F.col("end_s"), F.col("r_start_s"), F.col("r_end_s")) >= least_iou)
    support = good.groupBy("clip_id", "id").agg(F.countDistinct("r_ref_id").alias("supporting"))
    told = own.join(support, ["clip_id", "id"], "left").join(refs, "clip_id")
    told = told.withColumn("agreeing", F.coalesce("supporting", F.lit(0)) + 1)
    return told.filter(F.col("agreeing") >= F.least(F.lit(need), F.col("n_refs"))).drop("supporting", "n_refs")


# Symptoms that a primary flaw accounts for.
SECONDARY = {
    "PACE_FAST": ["PAUSE_BAD", "PAUSE_LOST", "FILLER", "RARE_HESIT", "EMPH_FLAT", "SLUR", "UPTALK"],
    "PACE_SLOW": ["PAUSE_BAD", "PAUSE_LOST", "FILLER", "RARE_HESIT", "EMPH_FLAT", "SLUR", "UPTALK"],
    "SHOUT": ["EMPH_FLAT", "SLUR", "MONOTONE"],
    "FADE": ["EMPH_FLAT", "SLUR", "UPTALK", "WORD_SWAP"],
    "SLUR": ["EMPH_FLAT"],
    "MONOTONE": ["EMPH_FLAT"],
    "WORD_SKIP": ["PACE_FAST", "PAUSE_LOST", "EMPH_FLAT"],
    "WORD_SWAP": ["EMPH_FLAT", "SLUR"],
}


def arbitrated(candidates: DataFrame, reliability: DataFrame, secondary: dict[str, list[str]] | None = None, least_overlap: float = 0.5, near: float = 0.05, symptom_overlap: float = 0.3) -> DataFrame:
    """Candidates after both passes of arbitration, in the total order start, flaw, end, word.

    First a symptom that overlaps its primary goes (a primary that went itself
    no longer counts); then of two overlapping ones of different categories the
    less reliable goes unless both are about as reliable; flaws without a
    reliability count as sure.  What goes decides what stays, but only among
    intervals that overlap, so each island of them is settled on its own, and
    an island's work follows its overlaps.
    """
    table = SECONDARY if secondary is None else secondary
    told = candidates.join(reliability.select("flaw", "reliability"), "flaw", "left").fillna({"reliability": 1.0}).select(*candidates.columns, "reliability")
    names = list(candidates.columns)

    def settle(rows: Iterator[dict]) -> Iterator[dict]:
        held = list(rows)
        meets: list[list[tuple[int, float]]] = [[] for _ in held]
        open_: list[int] = []
        for b, row in enumerate(held):
            open_ = [a for a in open_ if held[a]["end_s"] > row["start_s"]]
            for a in open_:
                other = held[a]
                shared = min(other["end_s"], row["end_s"]) - row["start_s"]
                share = max(0.0, shared) / max(0.05, min(other["end_s"] - other["start_s"], row["end_s"] - row["start_s"]))
                meets[a].append((b, share))
                meets[b].append((a, share))
            open_.append(b)
        symptom: set[int] = set()
        for k, row in enumerate(held):
            if k not in symptom:
                symptom |= {m for m, share in meets[k] if share >= symptom_overlap and held[m]["flaw"] in table.get(row["flaw"], ())}
        beaten: set[int] = set()
        left = ((a, b) for a in range(len(held)) for b, share in sorted(meets[a]) if b > a and share >= least_overlap)
        for a, b in left:
            if symptom & {a, b} or beaten & {a, b} or held[a]["category"] == held[b]["category"]:
                continue
            lead = held[a]["reliability"] - held[b]["reliability"]
            if abs(lead) >= near:
                beaten.add(b if lead > 0 else a)
        yield from ({c: row[c] for c in names} for k, row in enumerate(held) if k not in symptom and k not in beaten)

    return series.folded(islands(told, ["clip_id"]), ["clip_id", "island"], ["start_s", "flaw", "end_s", "w0"], settle, candidates.schema)
