"""Manifest, audit and dashboard tables."""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window


def joined_set(values: Column) -> Column:
    """The distinct values in order, joined by bars."""
    return F.array_join(F.array_sort(F.array_distinct(values)), "|")


def manifest(labels: DataFrame) -> DataFrame:
    """Labels with ``what array<struct<flaw, category, level, ...>>`` as flat rows."""
    flaws, categories, levels = (F.col(f"what.{n}") for n in ("flaw", "category", "level"))
    return labels.select(
        *[c for c in labels.columns if c != "what"], joined_set(flaws).alias("flaw_codes"), joined_set(categories).alias("categories"),
        F.coalesce(F.array_max(levels), F.lit(0)).alias("max_level"), F.size("what").alias("n_regions"),
    )


def kind_of_clip(flaw_codes: Column, condition: Column) -> Column:
    many, some = flaw_codes.contains("|"), F.length(flaw_codes) > 0
    return F.when(many, "multi").when(some, "flaw").when(F.length(F.coalesce(condition, F.lit(""))) > 0, "condition").otherwise("clean")


def by_take(clips: DataFrame) -> DataFrame:
    """A row for each take with its clips in order; a take's clips are few."""
    kind = kind_of_clip(F.col("flaw_codes"), F.col("added_condition"))
    return clips.groupBy("take_id").agg(
        F.min("speaker_id").alias("speaker_id"), F.array_sort(F.collect_list(F.struct("clip_id", kind.alias("kind"), "max_level"))).alias("clips")
    )


def grid(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).count().fillna(0)


def weighted_share(df: DataFrame, keys: Sequence[str], share: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(share) * F.col(weight)) / F.sum(weight)).alias("share"), F.sum(weight).alias("weight"))


def placement(df: DataFrame, group: str, places: Sequence[str]) -> DataFrame:
    """Counts per group and first known place, with the share of the group."""
    place = F.coalesce(*[F.when(F.length(F.col(p)) > 0, F.col(p)) for p in places])
    counts = df.groupBy(group, place.alias("placed_at")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def domain_missing(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """The values of a (small) domain that the column lacks."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    return wanted.join(df.select(column).distinct(), column, "left_anti")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key: what an upsert of all rows leaves."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def upserted(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows)


def stable_order(*parts: Column) -> Column:
    """A pseudo-random but stable sort key."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def weighted_order(uniform: Column, weight: Column) -> Column:
    """Descending by this is weighted sampling without replacement; null for weight 0."""
    return F.when(weight > 0, F.pow(uniform, 1 / weight))


def pilot_gate(ratings: DataFrame, least_share: float = 0.8, least_levels: int = 3) -> DataFrame:
    """Per flaw: share of ratings that are not robotic, whether felt levels rise with levels, verdict.

    ``ratings(flaw, level, realism, level_feel)``, unrated rows with null realism.
    """
    felt = ratings.filter("level_feel is not null").groupBy("flaw", "level").agg(F.avg("level_feel").alias("felt"))
    before = F.lag("felt").over(Window.partitionBy("flaw").orderBy("level"))
    steps = felt.withColumn("rises", before.isNull() | (F.col("felt") > before))
    rising = steps.groupBy("flaw").agg((F.min("rises") & (F.count(F.lit(1)) >= least_levels)).alias("rising"))
    shares = ratings.groupBy("flaw").agg(F.count("realism").alias("rated"), F.count(F.lit(1)).alias("total"), F.avg((F.col("realism") != "robotic").cast("double")).alias("natural"))
    told = shares.join(rising, "flaw", "left").fillna({"rising": False})
    verdict = F.when(F.col("rated") < F.col("total"), "incomplete").when((F.col("natural") >= least_share) & F.col("rising"), "PASS").otherwise("FAIL")
    return told.withColumn("verdict", verdict)


def pause_norms(pauses: DataFrame, kind: str, value: str) -> DataFrame:
    """Per kind: median, scaled median deviation, 5th and 95th percentile, number."""
    centres = pauses.groupBy(kind).agg(F.median(value).alias("median"))
    far = F.abs(F.col(value) - F.col("median"))
    joined = pauses.join(centres, kind)
    return joined.groupBy(kind).agg(
        F.max("median").alias("median"), (1.4826 * F.median(far)).alias("mad"), F.percentile(value, F.lit(0.05)).alias("p05"),
        F.percentile(value, F.lit(0.95)).alias("p95"), F.count(value).alias("n"),
    )
