"""Functions by name in SQL against the functions of DataFrames."""

import pyspark.sql.functions as F
import pytest

from tempora.functions import named, numbers
from tempora.operators import series, spectral


def test_table_functions_give_what_the_functions_give(spark):
    named.register(spark)
    rows = [(k, o, float((k * 7 + o * o) % 11) if (k + o) % 9 else None) for k in range(4) for o in range(30)]
    t = spark.createDataFrame(rows, "k int, o int, x double").repartition(3)
    t.createOrReplaceTempView("t")
    got = spark.sql("SELECT * FROM runs_above(TABLE(t) PARTITION BY k ORDER BY o, key => 'k', value => 'x', above => 4.0, least => 2)")
    want = series.runs(t, ["k"], ["o"], F.col("x") > 4.0, [F.max("x").alias("most")], least=2).select("k", "first_row", "last_row", "n", "most")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() > 5
    c = spark.createDataFrame([(k, o // 3, float(1 + (k + o * 5) % 13), (o * 3 % 7) / 7, f"{k}-{o}") for k in range(3) for o in range(20)], "k int, step int, v double, s double, name string")
    c.createOrReplaceTempView("c")
    got = spark.sql("SELECT * FROM best_path(TABLE(c) PARTITION BY k ORDER BY step, step => 'step', value => 'v', strength => 's', name => 'name', jump => 0.4)")
    want = spectral.best_paths(c, ["k"], "step", "v", "s", "name", jump=0.4).select("name")
    assert sorted(got.collect()) == sorted(want.collect())
    assert spark.sql("SELECT * FROM runs_above(TABLE(SELECT * FROM t WHERE k > 99) PARTITION BY k ORDER BY o, key => 'k', value => 'x', above => 4.0)").count() == 0
    with pytest.raises(Exception, match="no column y among k, o, x"):
        spark.sql("SELECT * FROM runs_above(TABLE(t) PARTITION BY k ORDER BY o, key => 'k', value => 'y', above => 4.0)").collect()


def test_scalar_functions_give_what_the_expressions_give(spark):
    named.register(spark)
    t = spark.createDataFrame([(x,) for x in (0.0, 1e-12, 0.5, 2.0, -3.0)], "x double")
    t.createOrReplaceTempView("amplitudes")
    got = spark.sql("SELECT decibels(x) AS db, amplitude(x) AS a FROM amplitudes").collect()
    want = t.select(numbers.decibels(F.col("x")).alias("db"), numbers.amplitude(F.col("x")).alias("a")).collect()
    assert all(g.db == pytest.approx(w.db) and g.a == pytest.approx(w.a) for g, w in zip(got, want))
    r = spark.sql("SELECT semitones(200, 100) AS up, semitones(0, 100) AS none, overlap_s(0, 2, 1, 5) AS o, overlap_s(0, 1, 2, 3) AS apart, tempo_change(2, 1) AS twice").first()
    assert (r.up, r.none, r.o, r.apart, r.twice) == (12.0, None, 1.0, 0.0, 2.0)


def test_predictors_by_name(spark):
    regions = spark.createDataFrame([("c", 0, "FADE", 4), ("c", 1, "SHOUT", None)], "clip_id string, rid int, flaw string, level int")
    assert [r.severity for r in named.predicted(regions, "oracle").orderBy("rid").collect()] == [4.0, 3.0] and named.predicted(regions, "null").count() == 0
    with pytest.raises(ValueError, match="no predictor best among null, oracle"):
        named.predicted(regions, "best")
