"""Whether a benchmark's edits can be told by their joins: boosted trees on window features, held out by split or by speaker."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

from tempora.operators import intervals
from tempora.operators.sound import WINDOW_FEATURES
from tempora.plans import evaluate

# Flaws that are silences themselves, and what passes.
SILENT_FLAWS = ("PAUSE_BAD", "RARE_HESIT")
PASS_AUC = 0.60


def audited(manifest: DataFrame, split: str) -> DataFrame:
    """Flawed clips of a split without a condition."""
    return manifest.filter((F.col("split") == split) & (F.coalesce("added_condition", F.lit("")) == "") & (F.length(F.coalesce("flaw_codes", F.lit(""))) > 0))


def paired_points(edges: DataFrame, regions: DataFrame, natural: DataFrame, own_silences: DataFrame, most_s: float = 0.35) -> DataFrame:
    """``(clip_id, rid, edge, flaw, t_edit, t_natural)``: every edge and the place in the clean recording it is held against.

    That is the same place, but for silences a natural silence's edge of the
    same kind (chosen by a hash), and their own edge is moved to the nearest
    silence's.  ``natural(take_id, edge, t)``, ``own_silences(clip_id, edge,
    t)``; ``regions(clip_id, rid, flaw, take_id)``.
    """
    told = edges.join(regions.select("clip_id", "rid", "flaw", "take_id"), ["clip_id", "rid"])
    plain = told.filter(~F.col("flaw").isin(*SILENT_FLAWS)).select("clip_id", "rid", "edge", "flaw", F.col("t_after").alias("t_edit"), F.col("t_before").alias("t_natural"))
    silent = told.filter(F.col("flaw").isin(*SILENT_FLAWS))
    lists = natural.groupBy("take_id", "edge").agg(F.array_sort(F.collect_list("t")).alias("ts"))  # a take's silences
    chosen = silent.join(lists, ["take_id", "edge"]).withColumn("t_natural", F.element_at("ts", (F.pmod(F.xxhash64("clip_id", "rid", "edge"), F.size("ts")) + 1).cast("int")))
    moved = intervals.nearest(chosen.withColumn("t", F.col("t_after")), own_silences.select("clip_id", "edge", "t", F.lit(0).alias("e")), ["clip_id", "edge"], "t", ["e"], most=most_s)
    return plain.unionByName(moved.select("clip_id", "rid", "edge", "flaw", F.coalesce("r_t", "t_after").alias("t_edit"), "t_natural"))


def windows(edited: DataFrame, natural: DataFrame) -> DataFrame:
    """Feature rows of both classes with ``edit`` 1 and 0; a missing feature is 0."""
    both = edited.withColumn("edit", F.lit(1)).unionByName(natural.withColumn("edit", F.lit(0)))
    return both.fillna(0.0, list(WINDOW_FEATURES))


def _scored(fit_on: DataFrame, asked: DataFrame, trees: int, seed: int) -> DataFrame:
    vectors = VectorAssembler(inputCols=list(WINDOW_FEATURES), outputCol="_x")
    model = GBTClassifier(featuresCol="_x", labelCol="edit", maxIter=trees, maxDepth=3, seed=seed).fit(vectors.transform(fit_on))
    told = model.transform(vectors.transform(asked))
    return told.withColumn("likelihood", vector_to_array("probability")[1]).select(*asked.columns, "likelihood")


def by_split(rows: DataFrame, trees: int = 150, seed: int = 0) -> DataFrame:
    """``rows(split, flaw, edit, ...)``: fitted on ``train``, told of ``test``."""
    return _scored(rows.filter("split = 'train'"), rows.filter("split = 'test'"), trees, seed)


def by_speaker(rows: DataFrame, trees: int = 150, seed: int = 0) -> DataFrame:
    """Each speaker's rows told by a model of the others' (a model a speaker; speakers are few)."""
    out = None
    for r in rows.select("speaker").distinct().orderBy("speaker").collect():
        one = _scored(rows.filter(F.col("speaker") != r.speaker), rows.filter(F.col("speaker") == r.speaker), trees, seed)
        out = one if out is None else out.unionByName(one)
    return out


def audit(told: DataFrame, least: int = 4) -> DataFrame:
    """``(scope, n_pos, n_neg, auc, passes)`` over all rows and for flaws with ``least`` rows of both classes."""
    every = told.withColumn("positive", F.col("edit") == 1)
    scopes = every.withColumn("scope", F.explode(F.array(F.lit("ALL"), F.col("flaw"))))
    found = evaluate.auc(scopes, ["scope"], "positive", "likelihood").filter((F.col("scope") == "ALL") | ((F.col("n_pos") >= least) & (F.col("n_neg") >= least)))
    return found.withColumn("passes", F.col("auc") <= PASS_AUC)


def compared(split: DataFrame, speakers: DataFrame) -> DataFrame:
    """Both audits side by side by scope."""
    return split.select("scope", F.col("auc").alias("auc_split")).join(speakers.select("scope", F.col("auc").alias("auc_speaker")), "scope", "full")
