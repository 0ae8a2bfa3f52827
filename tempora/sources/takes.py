"""Where recordings and their companions lie: paths by id, baselines with their state, verdicts, what could not be placed, and takes as files.

Folders are listed by Spark's own file sources, so any store that it reads will
do; a missing folder is an empty one.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession

VERDICTS = "clip_id string, flaw string, level int, realism string, audible string, comment string, reviewer string, timestamp string"


def _or_empty(spark: SparkSession, read, schema: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(name, path)`` of a folder's files, without reading them; names are without their last suffix."""
    files = lambda: spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return _or_empty(spark, files, "path string").select(_stem(F.col("path")).alias("name"), "path")


def clip_paths(clips: DataFrame, variants: DataFrame, takes: DataFrame) -> DataFrame:
    """``clips(clip_id, ..)`` with the ``path`` of their recording: the variant's, or else the take's; null where there is neither."""
    of = lambda files, to: files.select(F.col("name").alias("clip_id"), F.col("path").alias(to))
    both = clips.join(of(variants, "_variant"), "clip_id", "left").join(of(takes, "_take"), "clip_id", "left")
    return both.withColumn("path", F.coalesce("_variant", "_take")).drop("_variant", "_take")


def reference_paths(wanted: DataFrame, takes: DataFrame, custom: DataFrame | None = None, stitched: DataFrame | None = None) -> DataFrame:
    """``wanted(ref_id, ..)`` with the ``path`` of the reference's recording.

    A reading that a user supplied (``custom(ref_id, path)``) comes first, then one
    stitched out of other speakers' sentences (ids that begin with ``cross:``),
    then the baseline's own take.
    """
    out = wanted.join(takes.select(F.regexp_extract("name", "^(.+)-CHAMP_C0$", 1).alias("ref_id"), F.col("path").alias("_own")), "ref_id", "left")
    for table, name in ((custom, "_custom"), (stitched, "_stitched")):
        out = out.withColumn(name, F.lit(None).cast("string")) if table is None else out.join(table.select("ref_id", F.col("path").alias(name)), "ref_id", "left")
    chosen = F.coalesce("_custom", F.when(F.col("ref_id").startswith("cross:"), F.col("_stitched")).otherwise(F.col("_own")))
    return out.withColumn("path", chosen).drop("_own", "_custom", "_stitched")


def baselines_with_state(baselines: DataFrame, sources: DataFrame, audits: DataFrame) -> DataFrame:
    """``baselines(id, ..)`` with ``status`` (of ``sources(id, status)``, else unbuilt) and ``audit`` (of ``audits(id, status)``, else not run)."""
    told = baselines.join(sources.select("id", F.col("status").alias("_s")), "id", "left").join(audits.select("id", F.col("status").alias("_a")), "id", "left")
    return told.withColumns({"status": F.coalesce("_s", F.lit("unbuilt")), "audit": F.coalesce("_a", F.lit("not run"))}).drop("_s", "_a")


def source_states(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, status)`` of the files ``<folder>/<id>/source.json``."""
    read = lambda: spark.read.schema("status string").option("multiLine", True).json(f"{folder}/*/source.json").select("status", F.input_file_name().alias("path"))
    return _or_empty(spark, read, "status string, path string").select(F.regexp_extract("path", "([^/]+)/source.json$", 1).alias("id"), "status")


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Reviewers' verdicts; none where no file is there yet."""
    return _or_empty(spark, lambda: spark.read.schema(VERDICTS).option("header", True).option("emptyValue", "").csv(path), VERDICTS)


def not_applicable(jobs: DataFrame, places: DataFrame) -> DataFrame:
    """``(take_id, flaw, message)`` of the flaws of ``jobs(take_id, flaw)`` that no place was found for in ``places(take_id, flaw)``: told, not dropped."""
    missing = jobs.select("take_id", "flaw").distinct().join(places.select("take_id", "flaw").distinct(), ["take_id", "flaw"], "left_anti")
    return missing.withColumn("message", F.format_string("%s: no place for %s", "take_id", "flaw"))


def write_takes(takes: DataFrame, folder: str) -> DataFrame:
    """``(take_id, path)`` of the files written for ``takes(baseline_id, take_id, sr, duration_s, align_source, text, words, source)``.

    A take's alignment goes to ``takes/<take>_C0.align.json`` with words numbered
    and times to a tenth of a millisecond, its text to
    ``baselines/<id>/reference.txt`` and what is known of it to
    ``baselines/<id>/source.json``.  Files have fixed names, so a task that runs
    again writes the same.
    """

    def put(at: str, content: str) -> str:
        fs, path = pafs.FileSystem.from_uri(at)
        fs.create_dir(posixpath.dirname(path), recursive=True)
        with fs.open_output_stream(path, compression=None) as f:
            f.write(content.encode())
        return at

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for row in batch.to_dict("records"):
                words = [{"i": i, **{k: round(v, 4) if k.endswith("_s") else v for k, v in w.items() if k != "i"}} for i, w in enumerate(row["words"])]
                label = {"take_id": row["take_id"], "sr": int(row["sr"]), "duration_s": round(float(row["duration_s"]), 4), "align_source": row["align_source"], "words": words}
                own = f"{folder}/baselines/{row['baseline_id']}"
                done.append((row["take_id"], put(f"{folder}/takes/{row['take_id']}_C0.align.json", json.dumps(label))))
                done.append((row["take_id"], put(f"{own}/reference.txt", row["text"] + "\n")))
                done.append((row["take_id"], put(f"{own}/source.json", json.dumps({**row["source"], "take_id": row["take_id"]}))))
            yield pd.DataFrame(done, columns=["take_id", "path"])

    named = takes.withColumns({"words": F.to_json("words"), "source": F.to_json("source")})

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from write(b.assign(words=b["words"].map(json.loads), source=b["source"].map(json.loads)) for b in batches)

    return named.mapInPandas(parsed, "take_id string, path string")
