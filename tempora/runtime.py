"""Sending this package to executors that do not have it installed, and a folder that all of them reach."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

#: Rows of one Arrow batch. A row is a whole document here, so Spark's default of 10,000 would be tens of megabytes.
BATCH_ROWS = 1000

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to all executors of the session's application, once.

    As ``spark-submit --py-files`` does: the driver serves one small archive.
    The session's Arrow batches are made small, unless it has its own setting.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tempora-"), "tempora.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(top):
            for name in sorted(n for n in names if n.endswith(".py")):
                file = os.path.join(folder, name)
                archive.write(file, os.path.relpath(file, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``; where that is unset, in a temporary one on one machine, and a cluster is refused."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(base)
    base = base if "://" in base or base.startswith("file:") else f"file://{base}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
