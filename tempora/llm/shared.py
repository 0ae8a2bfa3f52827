"""Shared folder, written tables and whole files for the operators of this package."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors reach.

    It lies in ``spark.checkpoint.dir``.  Where that is unset, a temporary folder
    is made and set as the checkpoint folder on one machine (tests), and a
    cluster is refused, as its machines share no temporary folder.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return posixpath.join(base, f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage with a copy that outlives any executor.  Zstandard
    needs no off-heap buffers, which pile up over many small tables.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.shared_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read again; others are left alone."""
    for df in tables:
        path = getattr(df, "shared_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def of_attempt(path: str) -> str:
    """``path`` with the number of the running task attempt in its name.

    A task that runs again, or a speculative copy, writes a file of its own.
    Readers find files by a table's rows, and only one attempt's rows get into
    a table, so what others leave behind is never read.
    """
    folder, name = posixpath.split(path)
    stem, dot, kind = name.partition(".")
    context = TaskContext.get()
    return posixpath.join(folder, f"{stem}-{context.taskAttemptId() if context else 0}{dot}{kind}")


@contextmanager
def new_file(uri: str):
    """A new binary file, which is removed again where its writer fails."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    try:
        with fs.open_output_stream(path, compression=None) as out:
            yield out
    except BaseException:
        fs.delete_file(path)
        raise


@contextmanager
def old_file(uri: str):
    """A binary file for reading from anywhere within it."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        yield f


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, or with underscores until no column has that name (names ignore case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
