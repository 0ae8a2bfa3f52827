"""Functions by name in SQL: table functions and scalar ones, registered from two tables of names.

After ``register(spark)``, ``SELECT * FROM runs_above(TABLE(t) PARTITION BY k
ORDER BY o, value => 'x', above => 5.0)`` gives what ``series.runs`` gives for
``x > 5``.  A table function gets the rows of a partition in order, one after
the other, and holds no more of them than it says; its columns follow those of
its table, which ``analyze`` is told.  Scalar functions are SQL expressions, so
Catalyst sees through them.  ``predicted`` takes a predictor by name, of which
PREDICTORS has those that test the harness; others can be added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, Row, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tempora.operators.spectral import best_path
from tempora.plans import report


def _table(argument: AnalyzeArgument) -> StructType:
    if not argument.isTable:
        raise ValueError("the first argument is a table: TABLE(name) PARTITION BY .. ORDER BY ..")
    return argument.dataType


def _column(schema: StructType, argument: AnalyzeArgument) -> str:
    if argument.value not in schema.names:
        raise ValueError(f"no column {argument.value} among {', '.join(schema.names)}")
    return argument.value


class RunsAbove:
    """Maximal runs of rows of which ``value`` is above a bound: ``(key, first_row, last_row, n, most)``, rows counted from 0; holds one run."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, value: AnalyzeArgument, above: AnalyzeArgument, least: AnalyzeArgument | None = None) -> AnalyzeResult:
        schema = _table(rows)
        kind = schema[_column(schema, key)]
        _column(schema, value)
        numbers = [StructField(n, LongType()) for n in ("first_row", "last_row", "n")]
        return AnalyzeResult(StructType([StructField(kind.name, kind.dataType), *numbers, StructField("most", DoubleType())]))

    def __init__(self):
        self.row, self.run, self.key, self.least = -1, None, None, 1

    def eval(self, rows: Row, key: str, value: str, above: float, least: int = 1) -> Iterator[tuple]:
        self.row, self.key, self.least = self.row + 1, rows[key], least
        x = rows[value]
        if x is not None and x > above:
            first, most = self.run or (self.row, x)
            self.run = first, max(most, x)
        else:
            yield from self._ended(self.row - 1)

    def _ended(self, last: int) -> Iterator[tuple]:
        if self.run and last - self.run[0] + 1 >= self.least:
            yield self.key, self.run[0], last, last - self.run[0] + 1, float(self.run[1])
        self.run = None

    def terminate(self) -> Iterator[tuple]:
        yield from self._ended(self.row)


class BestPath:
    """Of the candidates of each step the one on the best path, as ``spectral.best_paths`` chooses; holds a partition's numbers and chosen rows' names."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, step: AnalyzeArgument, value: AnalyzeArgument, strength: AnalyzeArgument, name: AnalyzeArgument, jump: AnalyzeArgument) -> AnalyzeResult:
        schema = _table(rows)
        for c in (step, value, strength):
            _column(schema, c)
        return AnalyzeResult(StructType([schema[_column(schema, name)]]))

    def __init__(self):
        self.steps, self.values, self.strengths, self.names, self.jump = [], [], [], [], 0.0

    def eval(self, rows: Row, step: str, value: str, strength: str, name: str, jump: float) -> None:
        self.steps.append(rows[step])
        self.values.append(rows[value])
        self.strengths.append(rows[strength])
        self.names.append(rows[name])
        self.jump = float(jump)

    def terminate(self) -> Iterator[tuple]:
        if not self.steps:
            return
        order = sorted(range(len(self.steps)), key=lambda i: (self.steps[i], self.values[i], self.names[i]))
        starts = np.array([k for k, i in enumerate(order) if k == 0 or self.steps[i] != self.steps[order[k - 1]]])
        sizes = np.diff(np.append(starts, len(order)))
        at = np.repeat(np.arange(len(starts)), sizes), np.arange(len(order)) - np.repeat(starts, sizes)
        values, strengths = np.ones((len(starts), sizes.max())), np.full((len(starts), sizes.max()), -np.inf)
        values[at], strengths[at] = [self.values[i] for i in order], [self.strengths[i] for i in order]
        for k in starts + best_path(values, strengths, self.jump):
            yield (self.names[order[k]],)


#: Table functions by name.
TABLE_FUNCTIONS: dict[str, type] = {"runs_above": RunsAbove, "best_path": BestPath}

#: Scalar functions by name: their arguments, what they return, and the expression.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "decibels": ("amplitude DOUBLE", "DOUBLE", "20 * log10(greatest(amplitude, 1e-9D))"),
    "amplitude": ("decibels DOUBLE", "DOUBLE", "power(10D, decibels / 20)"),
    "semitones": ("hz DOUBLE, re_hz DOUBLE", "DOUBLE", "CASE WHEN hz > 0 AND re_hz > 0 THEN 12 * log2(hz / re_hz) END"),
    "overlap_s": ("a0 DOUBLE, a1 DOUBLE, b0 DOUBLE, b1 DOUBLE", "DOUBLE", "greatest(0D, least(a1, b1) - greatest(a0, b0))"),
    "tempo_change": ("old_s DOUBLE, new_s DOUBLE", "DOUBLE", "old_s / greatest(new_s, 1e-6D)"),
}

#: Predictors by name: from the true regions to what is predicted.
PREDICTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"oracle": report.oracle, "null": report.nothing}


def register(spark: SparkSession) -> None:
    """All functions of the tables above, for this session."""
    for name, made in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(made))
    for name, (arguments, kind, expression) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {expression}")


def predicted(regions: DataFrame, name: str) -> DataFrame:
    """What the predictor of that name makes of regions."""
    if name not in PREDICTORS:
        raise ValueError(f"no predictor {name} among {', '.join(sorted(PREDICTORS))}")
    return PREDICTORS[name](regions)
