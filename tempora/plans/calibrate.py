"""Calibration: isotonic maps, logistic classifiers, thresholds, weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
import pyspark.sql.functions as F
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession

from tempora.operators import intervals
from tempora.operators.detect import Classifier, duration_parts

KNOTS = "flaw string, x double, y double"


def isotonic(points: DataFrame, least: int = 6) -> DataFrame:
    """Rising step map of ``points(flaw, d, level)`` per flaw as knots; flaws with few points or one d have none.

    Equal d are pooled by Spark before a flaw's distinct values meet in a task.
    """
    pooled = points.groupBy("flaw", "d").agg(F.avg(F.col("level").cast("double")).alias("y"), F.count(F.lit(1)).alias("n"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("d")
        blocks: list[list[float]] = []  # mean, weight, first x, last x
        if group["n"].sum() >= least and len(group) > 1:
            for x, y, n in zip(group["d"], group["y"], group["n"]):
                blocks.append([y, n, x, x])
                while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                    b, a = blocks.pop(), blocks.pop()
                    w = a[1] + b[1]
                    blocks.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2], b[3]])
        knots = [(group["flaw"].iloc[0], x, b[0]) for b in blocks for x in dict.fromkeys((b[2], b[3]))]
        return pd.DataFrame(knots, columns=["flaw", "x", "y"])

    return pooled.groupBy("flaw").applyInPandas(fit, KNOTS)


def logistic(rows: DataFrame, features: Sequence[str], label: str) -> LogisticRegressionModel:
    """Class-balanced logistic regression on standardised features."""
    n, positive = (float(x or 0) for x in rows.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("double"))).first())
    balanced = rows.withColumn("_w", F.when(F.col(label) == 1, n / max(1.0, 2 * positive)).otherwise(n / max(1.0, 2 * (n - positive))))
    vectors = VectorAssembler(inputCols=list(features), outputCol="_x").transform(balanced)
    return LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", standardization=True).fit(vectors.withColumn(label, F.col(label).cast("double")))


def best_threshold(scored: DataFrame, grid: Sequence[float], value: str = "d", truth: str = "hit", total: str = "n_truth") -> DataFrame:
    """Per flaw the threshold of the grid with the best F1; of equal ones the smallest.

    ``scored(flaw, d, hit, n_truth)``: each candidate, whether it matches, and
    the flaw's number of true regions.  All thresholds are counted in one pass.
    """
    tried = scored.withColumn("threshold", F.explode(F.array(*[F.lit(float(g)) for g in grid]))).filter(F.col(value) >= F.col("threshold"))
    counts = tried.groupBy("flaw", "threshold").agg(F.sum(F.col(truth).cast("int")).alias("tp"), F.count(F.lit(1)).alias("found"), F.max(total).alias("total"))
    f1 = counts.withColumn("f1", 2 * F.col("tp") / (F.col("found") + F.col("total")))
    return f1.groupBy("flaw").agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("b")).select("flaw", (-F.col("b.t")).alias("threshold"), "b.f1")


def reliability(matches: DataFrame, floor: float = 0.1) -> DataFrame:
    """Per flaw its precision, at least ``floor``: ``matches(flaw, hit)``."""
    return matches.groupBy("flaw").agg(F.round(F.greatest(F.lit(floor), F.avg(F.col("hit").cast("double"))), 3).alias("reliability"))


def weight_of_least_squares(pairs: DataFrame, group: str, made: str, wanted: str, low: float = 0.4, high: float = 2.0) -> DataFrame:
    """Per group the factor that takes ``made`` nearest to ``wanted``, within bounds."""
    factor = F.sum(F.col(made) * F.col(wanted)) / F.sum(F.col(made) * F.col(made))
    return pairs.groupBy(group).agg(F.greatest(F.lit(low), F.least(F.lit(high), factor)).alias("weight"))


def classifier(rows: DataFrame, features: Sequence[str], label: str) -> Classifier:
    """The logistic fit of ``rows`` as weights over standardised features; a feature without spread has weight 0."""
    stats = rows.agg(*[f(c).alias(f"{n}{k}") for k, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    means, sds = [float(stats[f"m{k}"] or 0.0) for k in range(len(features))], [float(stats[f"s{k}"] or 0.0) for k in range(len(features))]
    used = [k for k, s in enumerate(sds) if s > 1e-8]
    scaled = rows.select(label, *[((F.col(features[k]) - means[k]) / sds[k]).alias(f"f{k}") for k in used])
    fit = logistic(scaled, [f"f{k}" for k in used], label)
    found = dict(zip(used, fit.coefficients))
    return Classifier(tuple(features), tuple(float(found.get(k, 0.0)) for k in range(len(features))), float(fit.intercept), tuple(means), tuple(sds))


def marked_insertions(candidates: DataFrame, fillers: DataFrame, least: float = 0.4, width: float = 1.0) -> DataFrame:
    """``candidates(clip_id, start_s, end_s, ...)`` with ``hit``: IoU of ``least`` or more with a true filler, both of 0.3 s at least from their start."""
    long = lambda df: df.withColumn("_end", F.greatest("end_s", F.col("start_s") + 0.3))
    pairs = intervals.overlap_join(long(candidates), long(fillers.select("clip_id", "start_s", "end_s")), ["clip_id"], width, end="_end")
    both = F.least("_end", "r__end") - F.greatest("start_s", "r_start_s")
    hull = F.greatest("_end", "r__end") - F.least("start_s", "r_start_s")
    hits = pairs.filter(both / hull >= least).select("clip_id", "start_s", "end_s").distinct().withColumn("hit", F.lit(1))
    return candidates.join(hits, ["clip_id", "start_s", "end_s"], "left").fillna({"hit": 0})


def usual_cost(costs: DataFrame, floor: float = 0.02) -> float:
    """How well a normal clip matches its reference: the upper quartile of ``costs(path_cost)``, at least ``floor``."""
    return max(floor, float(costs.agg(F.percentile("path_cost", F.lit(0.75))).first()[0] or 0.0))


def descended(score: Callable[[dict[str, float]], float], start: dict[str, float], grid: dict[str, Sequence[float]], rounds: int = 2) -> dict[str, float]:
    """Thresholds after ``rounds`` of trying each key's values with all others held: the first of the best values stays.

    ``score`` runs a job over all clips for each trial; the driver holds
    nothing but thresholds.
    """
    held = dict(start)
    for _ in range(rounds):
        for key, values in grid.items():
            best = None
            for v in values:
                got = score({**held, key: v})
                if best is None or got > best[0] + 1e-9:
                    best = (got, v)
            held[key] = best[1] if best else held[key]
    return held


def unusable(grounding: DataFrame, least_f1: float = 0.10) -> DataFrame:
    """Flaws whose detector does not reach ``least_f1`` (``grounding(flaw, f1)``)."""
    return grounding.filter(F.col("flaw").isNotNull() & (F.col("f1") < least_f1)).select("flaw")


def level_weights(scored: Callable[[DataFrame], DataFrame], flaws: Sequence[str], spark: SparkSession, target: float = 60.0, low: float = 0.2, cap: float = 8.0, steps: int = 20) -> dict[str, float]:
    """The weight of each flaw that takes the mean score of its hardest clips to ``target``, by halving all flaws' ranges at once.

    ``scored(weights(flaw, weight))`` gives ``(flaw, overall)`` of these clips.
    A flaw that cannot get down to the target has the cap, one without clips 1.
    """

    def means(weights: dict[str, float]) -> dict[str, float]:
        table = spark.createDataFrame([(f, float(w)) for f, w in weights.items()], "flaw string, weight double")
        return {r.flaw: r.mean for r in scored(table).groupBy("flaw").agg(F.avg("overall").alias("mean")).collect()}

    at_cap = means({f: cap for f in flaws})
    fixed = {f: 1.0 if f not in at_cap else cap for f in flaws if f not in at_cap or at_cap[f] > target}
    span = {f: (low, cap) for f in flaws if f not in fixed}
    for _ in range(steps if span else 0):
        middle = {f: (a + b) / 2 for f, (a, b) in span.items()}
        got = means(middle)
        span = {f: (middle[f], b) if got[f] > target else (a, middle[f]) for f, (a, b) in span.items()}
    return fixed | {f: round((a + b) / 2, 2) for f, (a, b) in span.items()}


def usual_among(measures: DataFrame, kind: str, value: str) -> DataFrame:
    """Per kind of a measure over clean speakers: median, scaled median deviation, 5th and 95th percentile, number."""
    from tempora.plans.catalog import pause_norms

    return pause_norms(measures.filter(F.col(value).isNotNull()), kind, value)


def duration_model(words: DataFrame, ridge: float = 1.0) -> tuple[float, ...]:
    """Coefficients of a word's log duration by ridge regression, centred on each clip's median.

    ``words(clip_id, clean, start_s, end_s, btype)``.  The sums of products are
    one aggregation; a system of six equations is left for the driver.
    """
    import numpy as np

    told = words.withColumn("y", F.log(F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.03))))
    told = told.join(told.groupBy("clip_id").agg(F.median("y").alias("usual")), "clip_id").withColumn("y", F.col("y") - F.col("usual"))
    parts = duration_parts()
    names = [f"x{k}" for k in range(len(parts))]
    told = told.select("y", *[p.cast("double").alias(n) for n, p in zip(names, parts)])
    sums = told.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in names for b in [*names, "y"]]).first()
    x = np.array([[sums[f"{a}_{b}"] or 0.0 for b in names] for a in names])
    return tuple(float(c) for c in np.linalg.solve(x + ridge * np.eye(len(names)), [sums[f"{a}_y"] or 0.0 for a in names]))
