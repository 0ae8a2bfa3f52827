"""Live analysis: sessions, window statistics and runs over a stream.  An addition; batch results are the measure."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Closed sessions of each key: start, end, number; rows later than ``late`` are left out by the watermark."""
    windowed = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    return windowed.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def live_levels(events: DataFrame, at: str, value: str, kind: str, width: str = "10 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sliding-window mean and maximum of each kind."""
    windowed = events.withWatermark(at, late).groupBy(F.window(at, width, slide).alias("w"), F.col(kind)).agg(F.avg(value).alias("mean"), F.max(value).alias("most"), F.count(F.lit(1)).alias("n"))
    return windowed.select(kind, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "most", "n")


RUNS = "key string, start double, end double, n long, most double"
STATE = "start double, last double, n long, most double"


def live_runs(rows: DataFrame, threshold: float, gap_s: float) -> DataFrame:
    """Runs of ``rows(key, t, value)`` above a threshold, each told when it is closed by a lower value or a gap.

    A key's state is one open run.  Rows of a batch are taken in order of
    time; a row older than the open run's end extends nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, n, most = state.get if state.exists else (0.0, 0.0, 0, 0.0)
        out = []
        for t, v in sorted((t, v) for b in batches for t, v in zip(b["t"], b["value"])):
            if n and (v <= threshold or t - last > gap_s):
                out.append((key[0], start, last, n, most))
                n = 0
            if v > threshold and not (n and t < last):
                start, last, n, most = (start, t, n + 1, max(most, v)) if n else (t, t, 1, v)
        state.update((start, last, n, most))
        yield pd.DataFrame(out, columns=["key", "start", "end", "n", "most"])

    return rows.groupBy("key").applyInPandasWithState(step, RUNS, STATE, "append", GroupStateTimeout.NoTimeout)
