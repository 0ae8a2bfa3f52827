"""Queries over the driver's tables, one for each kind of operator, and the SQL that says the same.

Events stand for a series: a user's events in order of time are its rows, an
event with its value in seconds is an interval, a type is a label.  Every
query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tempora.functions import text
from tempora.operators import align, intervals, series
from tempora.plans import calibrate, catalog, evaluate, retake, score
from tempora.sources import labels as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
USER, ORDER = ["user_id"], ["ts", "event_id"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed(events: DataFrame) -> DataFrame:
    """Events with ``t``: seconds since 2024-01-01."""
    return events.withColumn("t", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 1e6)


T = "(epoch_us(ts) - 1704067200000000) / 1e6"
SPANS = f"spans AS (SELECT event_id, user_id, event_type, {T} AS s, {T} + value * 60 AS e FROM events)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of ``value`` minutes."""
    e = timed(table(spark, sf_dir, "events"))
    return e.select("event_id", "user_id", "event_type", F.col("t").alias("start_s"), (F.col("t") + F.col("value") * 60).alias("end_s"))


# ---------------------------------------------------------------- series


@query("""
WITH p AS (SELECT user_id, quantile_cont(value, 0.5) AS m FROM events GROUP BY user_id),
f AS (SELECT e.*, value > m AS hot, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events e JOIN p USING (user_id)),
g AS (SELECT *, r - sum(hot::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM f),
h AS (SELECT user_id, min(r) AS first_row, max(r) AS last_row, count(*) AS n, max(value) AS peak FROM g WHERE hot GROUP BY user_id, island)
SELECT user_id, first_row, last_row, n, peak, row_number() OVER (PARTITION BY user_id ORDER BY first_row) AS run FROM h WHERE n >= 2""")
def runs_above_threshold(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    e = e.join(e.groupBy("user_id").agg(F.median("value").alias("m")), "user_id")
    return series.runs(e, USER, ORDER, F.col("value") > F.col("m"), [F.max("value").alias("peak")], least=2)


@query("""
WITH c AS (SELECT user_id, median(value) AS centre FROM events GROUP BY 1),
s AS (SELECT user_id, any_value(centre) AS centre, 1.4826 * median(abs(value - centre)) AS spread FROM events JOIN c USING (user_id) GROUP BY 1)
SELECT event_id, user_id, (value - centre) / greatest(spread, 0.05) AS z FROM events JOIN s USING (user_id) WHERE abs((value - centre) / greatest(spread, 0.05)) >= 3""")
def robust_outliers(spark, sf_dir):
    scored = series.robust_scores(table(spark, sf_dir, "events"), USER, "value", floor=0.05)
    return scored.filter(F.abs("z") >= 3).select("event_id", "user_id", "z")


@query("""SELECT event_id, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM events""")
def sliding_median_smooth(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", series.median_around("value", USER, ORDER, 1, 1).alias("smooth"))


@query("""SELECT event_id, CASE WHEN count(*) OVER w = 7 THEN avg(value) OVER w END AS smooth FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def sliding_mean_centered(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", series.mean_around("value", USER, ORDER, 3).alias("smooth"))


@query("""
WITH r AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n, first(value) OVER w AS f,
  last(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, (sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(0, 3 - k) * f + greatest(0, 2 - (n - k)) * l) / 5 AS smooth FROM r""")
def edge_padded_mean(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", series.mean_edge_padded("value", USER, ORDER, 2).alias("smooth"))


@query("""SELECT event_id, quantile_cont(value, 0.8) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS level FROM events""")
def forward_window_p80(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", series.percentile_ahead("value", USER, ORDER, 6, 0.8).alias("level"))


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, avg(value) AS top_mean FROM r WHERE k <= greatest(1, floor(n * 0.3)) GROUP BY user_id""")
def top30_mean(spark, sf_dir):
    return series.mean_of_largest(table(spark, sf_dir, "events"), USER, "value", 0.3)


@query("""
WITH a AS (SELECT quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS whole FROM lineitem),
s AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS own, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, n, CASE WHEN n >= 11 THEN own / whole END AS ratio FROM s, a""")
def iqr_ratio_groups(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    whole = series.quantiles(lines, [], {"q1": 0.25, "q3": 0.75}, "l_extendedprice").select((F.col("q3") - F.col("q1")).alias("whole"))
    own = lines.groupBy("l_suppkey").agg(series.quartile_range("l_extendedprice", 11).alias("own"), F.count(F.lit(1)).alias("n"))
    return own.crossJoin(F.broadcast(whole)).select("l_suppkey", "n", (F.col("own") / F.col("whole")).alias("ratio"))  # whole is one row


@query("""SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS most FROM events""")
def cumulative_max_map(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", series.largest_so_far("value", USER, ORDER).alias("most"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT a.event_id, a.value - median(b.value) AS contrast FROM r a JOIN r b ON a.user_id = b.user_id AND b.k BETWEEN a.k - 4 AND a.k + 4 AND b.k <> a.k GROUP BY a.event_id, a.value""")
def local_contrast(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") - series.centre_of_neighbours("value", USER, ORDER, 4)).alias("contrast"))
    return e.filter("contrast is not null")


@query("""
WITH o AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS opens FROM events),
n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM o)
SELECT user_id, session::BIGINT AS session, count(*) AS n, sum(value) AS total FROM n GROUP BY ALL""")
def sessionise(spark, sf_dir):
    e = timed(table(spark, sf_dir, "events"))
    gap = F.col("t") - F.lag("t").over(series._in_order(USER, ORDER))
    return series.sessions(e, USER, ORDER, gap > 1800).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("""
WITH RECURSIVE f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CASE WHEN value > 5 THEN ln(value) END AS f0, value AS inten, value % 7 AS hf FROM events),
v AS (SELECT user_id, i, f0, CASE WHEN i - lag(i) OVER (PARTITION BY user_id ORDER BY i) <= 3 THEN 0 ELSE 1 END AS opens FROM f WHERE f0 IS NOT NULL),
p AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY i) AS piece FROM v),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, piece ORDER BY i) AS k FROM p),
walk AS (SELECT user_id, piece, k, i, i AS first, f0 AS low, f0 AS high FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.piece, o.k, o.i, CASE WHEN greatest(high, f0) - least(low, f0) < 1.5 THEN first ELSE o.i END,
    CASE WHEN greatest(high, f0) - least(low, f0) < 1.5 THEN least(low, f0) ELSE f0 END, CASE WHEN greatest(high, f0) - least(low, f0) < 1.5 THEN greatest(high, f0) ELSE f0 END
  FROM walk w JOIN o ON o.user_id = w.user_id AND o.piece = w.piece AND o.k = w.k + 1),
s AS (SELECT user_id, first, max(i) AS last, max(high) - min(low) AS range_st FROM walk GROUP BY 1, 2 HAVING max(i) - first + 1 >= 3),
d AS (SELECT *, abs(hf - lag(hf) OVER (PARTITION BY user_id ORDER BY i)) AS step FROM f)
SELECT s.user_id::VARCHAR AS clip_id, first * 0.01::DOUBLE AS start_s, (last + 1) * 0.01::DOUBLE AS end_s, any_value(range_st) AS range_st, stddev_pop(inten) AS level_sd, coalesce(avg(step) FILTER (i > first), 0) AS change
FROM s JOIN d ON d.user_id = s.user_id AND d.i BETWEEN first AND last GROUP BY s.user_id, first, last""")
def flat_value_stretches(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("frame_i", F.row_number().over(series._in_order(USER, ORDER)) - 1)
    voiced = F.when(F.col("value") > 5, F.log("value"))
    frames = e.select(F.col("user_id").cast("string").alias("clip_id"), "frame_i", voiced.alias("f0_st"), F.col("value").alias("inten"), (F.col("value") % 7).alias("hf"))
    return series.flat_stretches(frames, range_st=1.5, least_s=0.03)


@query("""
WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
r AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS island FROM n WHERE value > 25)
SELECT user_id, min(i) AS first_row, max(i) AS last_row, max(value) AS peak FROM r GROUP BY user_id, island HAVING max(value) > 60""")
def hysteresis_runs(spark, sf_dir):
    return series.hysteresis(table(spark, sf_dir, "events"), USER, ORDER, "value", start=60.0, stay=25.0)


# ---------------------------------------------------------------- intervals


@query(f"""
WITH {SPANS} SELECT a.event_id, b.event_id AS other_id, greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) / ((a.e - a.s) + (b.e - b.s) - (least(a.e, b.e) - greatest(a.s, b.s))) AS iou
FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.event_id < b.event_id AND least(a.e, b.e) > greatest(a.s, b.s)""")
def interval_iou(spark, sf_dir):
    s = spans(spark, sf_dir)
    pairs = intervals.overlap_join(s, s, USER, 3600.0).filter("event_id < r_event_id")
    return pairs.select("event_id", F.col("r_event_id").alias("other_id"), intervals.iou(F.col("start_s"), F.col("end_s"), F.col("r_start_s"), F.col("r_end_s")).alias("iou"))


@query(f"""
WITH {SPANS} SELECT a.event_id FROM spans a WHERE a.event_type = 'error' AND NOT EXISTS
(SELECT 1 FROM spans b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND least(a.e + 60, b.e) > greatest(a.s - 60, b.s))""")
def anti_overlap(spark, sf_dir):
    s = spans(spark, sf_dir)
    return intervals.without_overlap(s.filter("event_type = 'error'"), s.filter("event_type = 'purchase'"), USER, ["event_id"], 3600.0, margin=60.0).select("event_id")


@query(f"""
WITH t AS (SELECT event_id, user_id, event_type, {T} AS t FROM events),
c AS (SELECT a.event_id, b.event_id AS nearest_id, abs(a.t - b.t) AS gap, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.t, b.event_id) AS k
  FROM t a JOIN t b ON a.user_id = b.user_id AND b.event_type = 'purchase' WHERE a.event_type = 'error')
SELECT event_id, nearest_id, gap FROM c WHERE k = 1""")
def nearest_event(spark, sf_dir):
    e = timed(table(spark, sf_dir, "events")).select("user_id", "event_id", "event_type", "t")
    found = intervals.nearest(e.filter("event_type = 'error'"), e.filter("event_type = 'purchase'"), USER, "t", ["event_id"])
    return found.filter("r_event_id is not null").select("event_id", F.col("r_event_id").alias("nearest_id"), "gap")


@query(f"""
WITH t AS (SELECT event_id, user_id, event_type, {T} AS t FROM events),
c AS (SELECT a.event_id, b.event_id AS last_id, row_number() OVER (PARTITION BY a.event_id ORDER BY b.t DESC, b.event_id DESC) AS k
  FROM t a LEFT JOIN t b ON a.user_id = b.user_id AND b.event_type = 'view' AND b.t <= a.t WHERE a.event_type = 'purchase')
SELECT event_id, last_id FROM c WHERE k = 1""")
def asof_last_before(spark, sf_dir):
    e = timed(table(spark, sf_dir, "events")).select("user_id", "event_id", "event_type", "t")
    found = intervals.asof_before(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), USER, "t", ["event_id"])
    return found.select("event_id", F.col("r_event_id").alias("last_id"))


def _as_regions(s: DataFrame, kind: str, number: str) -> DataFrame:
    return s.filter(F.col("event_type") == kind).select(F.col("user_id").alias("clip_id"), F.col("event_id").alias(number), F.lit("any").alias("flaw"), "start_s", "end_s")


def _taken(pairs: str) -> str:
    """Pairs of ``pairs(user_id, m, i, j)`` (m from 1 in order) whose rows no earlier taken pair has."""
    return f"""
walk AS (SELECT user_id, 0::BIGINT AS m, []::BIGINT[] AS is_, []::BIGINT[] AS js, false AS taken, 0::BIGINT AS i, 0::BIGINT AS j FROM (SELECT DISTINCT user_id FROM {pairs})
  UNION ALL SELECT p.user_id, p.m, CASE WHEN ok THEN list_append(is_, p.i) ELSE is_ END, CASE WHEN ok THEN list_append(js, p.j) ELSE js END, ok, p.i, p.j
  FROM (SELECT w.is_, w.js, p.*, NOT list_contains(w.is_, p.i) AND NOT list_contains(w.js, p.j) AS ok FROM walk w JOIN {pairs} p ON p.user_id = w.user_id AND p.m = w.m + 1) p)"""


@query(f"""
WITH RECURSIVE {SPANS}, w AS (SELECT event_id, user_id, event_type, CASE WHEN e - s < 0.3 THEN (s + e) / 2 - 0.15 ELSE s END AS s, CASE WHEN e - s < 0.3 THEN (s + e) / 2 + 0.15 ELSE e END AS e FROM spans),
c AS (SELECT a.user_id, a.event_id AS i, b.event_id AS j, (least(a.e, b.e) - greatest(a.s, b.s)) / ((a.e - a.s) + (b.e - b.s) - (least(a.e, b.e) - greatest(a.s, b.s))) AS iou
  FROM w a JOIN w b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND least(a.e, b.e) > greatest(a.s, b.s)),
pairs AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY iou DESC, i DESC, j DESC) AS m FROM c WHERE iou >= 0.3),{_taken("pairs")},
n AS (SELECT (SELECT count(*) FROM walk WHERE taken) AS tp, count(*) FILTER (event_type = 'view') AS n_truth, count(*) FILTER (event_type = 'click') AS n_found FROM events)
SELECT flaw, tp, n_truth, n_found, tp / n_found AS precision, tp / n_truth AS recall, 2.0 * tp / (n_found + n_truth) AS f1 FROM n, (VALUES ('any'), (NULL)) v(flaw)""")
def greedy_match_f1(spark, sf_dir):
    s = spans(spark, sf_dir)
    return evaluate.grounding(_as_regions(s, "view", "i"), _as_regions(s, "click", "j"), 0.3, width=3600.0)


@query(f"""
WITH t AS (SELECT event_id, user_id, event_type, {T} AS t FROM events)
SELECT a.user_id, count(*) AS n FROM t a JOIN t b ON a.user_id = b.user_id AND abs(a.t - b.t) <= 3600 WHERE a.event_type = 'view' AND b.event_type = 'click' GROUP BY a.user_id""")
def onset_collar_counts(spark, sf_dir):
    e = timed(table(spark, sf_dir, "events"))
    a = e.filter("event_type = 'view'").select("user_id", "t", (F.col("t") - 3600).alias("start_s"), (F.col("t") + 3600.001).alias("end_s"))
    b = e.filter("event_type = 'click'").select("user_id", F.col("t").alias("u"), F.col("t").alias("start_s"), (F.col("t") + 0.001).alias("end_s"))
    near = intervals.overlap_join(a, b, USER, 7200.0).filter(F.abs(F.col("t") - F.col("r_u")) <= 3600)
    return near.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH RECURSIVE t AS (SELECT event_id, user_id, event_type, {T} AS t FROM events),
c AS (SELECT a.user_id, a.event_id AS i, b.event_id AS j, abs(a.t - b.t) AS gap FROM t a JOIN t b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND abs(a.t - b.t) <= 1800),
pairs AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap, i, j) AS m FROM c),{_taken("pairs")}
SELECT walk.user_id AS clip_id, count(*) AS n, max(gap) AS widest FROM walk JOIN pairs USING (user_id, m) WHERE taken GROUP BY 1""")
def onset_matches(spark, sf_dir):
    s = spans(spark, sf_dir)
    found = intervals.matched_onsets(_as_regions(s, "view", "i"), _as_regions(s, "click", "j"), collar=1800.0)
    return found.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("widest"))


@query(f"""
WITH {SPANS}, o AS (SELECT a.event_id, count(DISTINCT b.event_type) + 1 AS agreeing FROM spans a LEFT JOIN spans b ON a.user_id = b.user_id AND b.event_type <> 'view'
  AND least(a.e, b.e) > greatest(a.s, b.s) AND (least(a.e, b.e) - greatest(a.s, b.s)) / ((a.e - a.s) + (b.e - b.s) - (least(a.e, b.e) - greatest(a.s, b.s))) >= 0.1
  WHERE a.event_type = 'view' GROUP BY a.event_id),
r AS (SELECT user_id, count(DISTINCT event_type) AS n_refs FROM events GROUP BY 1)
SELECT event_id, agreeing FROM o JOIN events USING (event_id) JOIN r USING (user_id) WHERE agreeing >= least(2, n_refs)""")
def consensus_vote(spark, sf_dir):
    s = spans(spark, sf_dir).select(F.col("user_id").alias("clip_id"), F.col("event_type").alias("ref_id"), F.lit("any").alias("flaw"), "start_s", "end_s", F.col("event_id").alias("id"))
    return intervals.voted(s, "view", need=2, least_iou=0.1, width=3600.0).select(F.col("id").alias("event_id"), "agreeing")


KINDS = ["FILLER", "PACE_SLOW", "PAUSE_BAD", "SLUR", "WORD_SWAP"]


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as detections: a flaw by the event's number, a category by its flaw."""
    flaw = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    s = spans(spark, sf_dir)
    return s.select(F.col("user_id").cast("string").alias("clip_id"), flaw.alias("flaw"), F.col("event_type").alias("category"), "start_s", "end_s", F.col("event_id").cast("int").alias("w0"))


TRUST = {"FILLER": 0.58, "PACE_SLOW": 0.6, "PAUSE_BAD": 0.79, "SLUR": 0.73}
SYMPTOMS = ", ".join(f"('{p}', '{s}')" for p in KINDS for s in intervals.SECONDARY.get(p, ()) if s in KINDS)


@query(f"""
WITH RECURSIVE {SPANS}, c AS (SELECT event_id, user_id, event_type, s, e, list_extract({KINDS}, (event_id % 5 + 1)::INT) AS flaw FROM spans),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, flaw, e, event_id) AS k, CASE flaw {" ".join(f"WHEN '{f}' THEN {r}" for f, r in TRUST.items())} ELSE 1.0 END AS trust FROM c),
near AS (SELECT a.user_id, a.k AS a, b.k AS b, a.flaw AS fa, b.flaw AS fb, a.event_type <> b.event_type AS differ, a.trust - b.trust AS lead,
  (least(a.e, b.e) - greatest(a.s, b.s)) / greatest(0.05, least(a.e - a.s, b.e - b.s)) AS share FROM o a JOIN o b ON a.user_id = b.user_id AND a.k <> b.k AND least(a.e, b.e) > greatest(a.s, b.s)),
y AS (SELECT user_id, a, list(b) AS symptoms, row_number() OVER (PARTITION BY user_id ORDER BY a) AS m FROM near WHERE share >= 0.3 AND (fa, fb) IN (VALUES {SYMPTOMS}) GROUP BY user_id, a),
one AS (SELECT user_id, 0::BIGINT AS m, []::BIGINT[] AS gone FROM (SELECT DISTINCT user_id FROM y)
  UNION ALL SELECT y.user_id, y.m, CASE WHEN list_contains(gone, a) THEN gone ELSE list_distinct(list_concat(gone, symptoms)) END FROM one JOIN y ON y.user_id = one.user_id AND y.m = one.m + 1),
symptom AS (SELECT user_id, unnest(arg_max(gone, m)) AS k FROM one GROUP BY user_id),
z AS (SELECT n.*, row_number() OVER (PARTITION BY n.user_id ORDER BY a, b) AS m FROM near n WHERE a < b AND share >= 0.5 AND differ AND abs(lead) >= 0.05
  AND NOT EXISTS (SELECT 1 FROM symptom s WHERE s.user_id = n.user_id AND s.k IN (n.a, n.b))),
two AS (SELECT user_id, 0::BIGINT AS m, []::BIGINT[] AS gone FROM (SELECT DISTINCT user_id FROM z)
  UNION ALL SELECT z.user_id, z.m, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone ELSE list_append(gone, CASE WHEN lead > 0 THEN b ELSE a END) END FROM two JOIN z ON z.user_id = two.user_id AND z.m = two.m + 1),
beaten AS (SELECT user_id, unnest(arg_max(gone, m)) AS k FROM two GROUP BY user_id)
SELECT flaw, count(*) AS kept FROM o WHERE (user_id, k) NOT IN (SELECT (user_id, k) FROM symptom) AND (user_id, k) NOT IN (SELECT (user_id, k) FROM beaten) GROUP BY flaw""")
def arbitration_pass(spark, sf_dir):
    trust = spark.createDataFrame(list(TRUST.items()), "flaw string, reliability double")
    return intervals.arbitrated(candidates(spark, sf_dir), trust).groupBy("flaw").agg(F.count(F.lit(1)).alias("kept"))


# ---------------------------------------------------------------- evaluation

RULE = "CASE WHEN n_chars % 3 = 0 THEN 'short' WHEN n_chars % 3 = 1 THEN 'middle' ELSE 'long' END"


@query(f"""
WITH d AS (SELECT quality = 1 AS t, n_chars >= 500 AS f FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (t AND f) AS tp, count(*) FILTER (t) AS n_truth, count(*) FILTER (f) AS n_found FROM d)
SELECT tp, n_truth, n_found, tp / n_found AS precision, tp / n_truth AS recall, 2.0 * tp / (n_found + n_truth) AS f1 FROM c""")
def prf_by_rule(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    t, f = F.col("quality") == 1, F.col("n_chars") >= 500
    c = d.agg(F.count_if(t & f).alias("tp"), F.count_if(t).alias("n_truth"), F.count_if(f).alias("n_found"))
    p, r, f1 = evaluate.prf(F.col("tp"), F.col("n_truth"), F.col("n_found"))
    return c.select("*", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


@query("""SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS "1-URGENT", count(*) FILTER (o_orderpriority = '2-HIGH') AS "2-HIGH", count(*) FILTER (o_orderpriority = '5-LOW') AS "5-LOW" FROM orders GROUP BY 1""")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"])


@query("""
WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS y FROM lineitem)
SELECT l_returnflag, count(*) AS n, corr(x, y) AS rho FROM r GROUP BY 1""")
def spearman_by_group(spark, sf_dir):
    return evaluate.spearman(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount")


@query("""
WITH d AS (SELECT lang, quality = 1 AS p, n_chars FROM labels JOIN documents USING (doc_id))
SELECT a.lang, any_value(n_pos) AS n_pos, any_value(n_neg) AS n_neg, avg(CASE WHEN a.n_chars > b.n_chars THEN 1 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0 END) AS auc
FROM d a JOIN d b ON a.lang = b.lang AND a.p AND NOT b.p JOIN (SELECT lang, count(*) FILTER (p) AS n_pos, count(*) FILTER (NOT p) AS n_neg FROM d GROUP BY 1) n ON n.lang = a.lang GROUP BY a.lang""")
def auc_rank_sum(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return evaluate.auc(d.withColumn("good", F.col("quality") == 1), ["lang"], "good", "n_chars").filter("auc is not null")


# ---------------------------------------------------------------- score

AREAS = {"click": 0.25, "error": 0.3, "login": 0.1, "purchase": 0.2, "view": 0.15}
RUBRIC = score.Rubric(areas={"events": AREAS}, default_genre="events", event_flaws=("error",))
CATEGORIES = ", ".join(f"('{k}', {v})" for k, v in AREAS.items())

REGION_SQL = f"""
WITH c AS (SELECT user_id, median(value) AS m FROM events GROUP BY 1), d AS (SELECT user_id, any_value(m) AS m, median(abs(value - m)) AS mad FROM events JOIN c USING (user_id) GROUP BY 1),
f AS (SELECT e.*, {T} AS t, value > m + 2 * mad AS hot, least(5.0, greatest(0.0, (value - m) / greatest(mad, 1e-3) / 2)) AS sev FROM events e JOIN d USING (user_id)),
g AS (SELECT *, row_number() OVER w - sum(hot::INT) OVER w AS island FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
regions AS (SELECT user_id, min(event_id) AS rid, arg_min(event_type, (ts, event_id)) AS category, min(t) AS s, max(t) AS e, max(sev) AS sev, count(*) AS n FROM g WHERE hot GROUP BY user_id, island),
priced AS (SELECT *, 0.8 * pow(sev, 2) * 0.5 * CASE WHEN category = 'error' THEN 1.0 ELSE least(3.0, (e - s) / 2) END AS p FROM regions),
mins AS (SELECT user_id, greatest((max({T}) - min({T})) / 60 / 60, 0.25) AS mins FROM events GROUP BY 1),
weights AS (SELECT * FROM (VALUES {CATEGORIES}) v(category, w)),
areas AS (SELECT m.user_id, w.category, w, coalesce(sum(p), 0) AS p, round(100 * exp(-(coalesce(sum(p), 0) / any_value(mins)) / 35.0), 1) AS area FROM mins m CROSS JOIN weights w
  LEFT JOIN priced r ON r.user_id = m.user_id AND r.category = w.category GROUP BY m.user_id, w.category, w)"""


def _regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Runs of a user's high values as regions, and users as clips (an hour of events as a minute)."""
    e = timed(table(spark, sf_dir, "events"))
    mid = e.groupBy("user_id").agg(F.median("value").alias("m"))
    mad = e.join(mid, "user_id").groupBy("user_id").agg(F.max("m").alias("m"), F.median(F.abs(F.col("value") - F.col("m"))).alias("mad"))
    marked = e.join(mad, "user_id").withColumn("sev", F.least(F.lit(5.0), F.greatest(F.lit(0.0), (F.col("value") - F.col("m")) / F.greatest("mad", F.lit(1e-3)) / 2)))
    found = series.runs(
        marked, USER, ORDER, F.col("value") > F.col("m") + 2 * F.col("mad"),
        [F.min("event_id").alias("rid"), F.min_by("event_type", F.struct("ts", "event_id")).alias("category"), F.min("t").alias("start_s"), F.max("t").alias("end_s"), F.max("sev").alias("severity")],
    )
    regions = found.select(F.col("user_id").alias("clip_id"), "rid", F.col("category").alias("flaw"), "category", "start_s", "end_s", "severity", F.lit(0.8).alias("confidence"), F.lit(0.5).alias("reliability"))
    clips = e.groupBy(F.col("user_id").alias("clip_id")).agg(((F.max("t") - F.min("t")) / 60).alias("duration_s")).select("clip_id", "duration_s", F.lit("events").alias("genre"), F.lit(False).alias("rough"), F.lit(True).alias("fluency"))
    return regions, clips


@query(REGION_SQL + """
SELECT user_id AS clip_id, round(0.6 * sum(w * area) / sum(w) + 0.4 * min(area), 1) AS overall, min(area) AS worst FROM areas GROUP BY 1""")
def score_regions(spark, sf_dir):
    clips, _ = score.score(*_regions(spark, sf_dir), RUBRIC)
    return clips.select("clip_id", "overall", F.col("worst_area_score").alias("worst"))


@query(REGION_SQL + """, o AS (SELECT round(0.6 * sum(w * area) / sum(w) + 0.4 * min(area), 1) AS s, min(area) AS worst FROM areas GROUP BY user_id)
SELECT CASE WHEN worst < 30 THEN 'needs work' WHEN s >= 75 AND worst < 50 THEN 'noticeable' WHEN s >= 90 THEN 'polished' WHEN s >= 75 THEN 'strong' WHEN s >= 60 THEN 'noticeable' ELSE 'needs work' END AS band, count(*) AS n FROM o GROUP BY 1""")
def band_counts(spark, sf_dir):
    clips, _ = score.score(*_regions(spark, sf_dir), RUBRIC)
    return clips.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query(REGION_SQL + """
SELECT r.rid, round(CASE WHEN a.p > 0 THEN w * (100 - area) * r.p / a.p / sum_w ELSE 0 END, 2) AS points_lost
FROM priced r JOIN areas a USING (user_id, category) JOIN (SELECT sum(w) AS sum_w FROM weights) ON true""")
def points_lost_share(spark, sf_dir):
    _, regions = score.score(*_regions(spark, sf_dir), RUBRIC)
    return regions.select("rid", "points_lost")


@query("""
SELECT event_id, CASE WHEN event_type <> 'view' THEN least(5, greatest(0, value / 10)) WHEN value <= 10 THEN 2 WHEN value <= 20 THEN 2 + (value - 10) / 10 WHEN value <= 40 THEN 3 + (value - 20) / 10 ELSE 5 END AS severity FROM events""")
def severity_interp(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("flaw"), (F.col("value") / 10).alias("d"))
    knots = spark.createDataFrame([("view", 1.0, 2.0), ("view", 2.0, 3.0), ("view", 4.0, 5.0)], "flaw string, x double, y double")
    return score.severity(e, knots).select("event_id", "severity")


# ---------------------------------------------------------------- text

WORDS = r"""
WITH w AS (SELECT conv_id, turn, unnest(list_filter(string_split(trim(regexp_replace(regexp_replace(text, '[–—]|--', ' ', 'g'), '[ \t\r\n\f]+', ' ', 'g'), ' '), ' '), lambda x: regexp_matches(lower(x), '[a-z'']'))) AS w FROM conversations)"""


@query(WORDS + r"""
SELECT conv_id, turn, count(*) AS n, count(*) FILTER (regexp_matches(rtrim(w, '"'')]}'), '[.?!]$')) AS sentences, count(*) FILTER (regexp_matches(rtrim(w, '"'')]}'), '[,;:.?!]$')) AS clauses FROM w GROUP BY ALL""")
def sentence_flags(spark, sf_dir):
    w = text.words_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    return w.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.count_if("sent_end").alias("sentences"), F.count_if("clause_end").alias("clauses"))


@query(WORDS + r""", p AS (SELECT conv_id, regexp_replace(lower(w), '[^a-z]', '', 'g') AS c FROM w),
s AS (SELECT conv_id, c, len(regexp_extract_all(c, '[aeiouy]+')) AS g FROM p)
SELECT conv_id, sum(CASE WHEN c = '' THEN 0 ELSE greatest(1, g - (g > 1 AND c LIKE '%e' AND NOT c LIKE '%le' AND NOT c LIKE '%ee')::INT) END)::BIGINT AS syllables FROM s GROUP BY 1""")
def syllable_counts(spark, sf_dir):
    w = text.words_of(table(spark, sf_dir, "conversations").select("conv_id", "text"))
    return w.groupBy("conv_id").agg(F.sum(text.syllables(F.col("w"))).alias("syllables"))


@query(WORDS + r""", o AS (SELECT conv_id, turn, regexp_replace(lower(w), '[^a-z'']', '', 'g') AS c FROM w)
SELECT conv_id, count(*) FILTER (c IN ('um', 'umm', 'uh', 'uhh', 'er', 'erm', 'ah', 'hmm', 'mm', 'mhm', 'uhm', 'eh')) AS fillers, count(*) AS words FROM o GROUP BY 1""")
def filler_counts(spark, sf_dir):
    w = text.words_of(table(spark, sf_dir, "conversations").select("conv_id", "text"))
    return w.groupBy("conv_id").agg(F.count_if(F.col("clean").isin(text.FILLERS)).alias("fillers"), F.count(F.lit(1)).alias("words"))


@query(r"""
WITH t AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS repeats FROM t WHERE text_ok(w)""".replace(" WHERE text_ok(w)", " WHERE w IS NOT NULL"))
def repeat_adjacent_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", text.repeats(F.col("text")).alias("repeats"))


PART_WORDS = "w AS (SELECT w, avg(p_size) AS size FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w, p_size FROM part) GROUP BY w)"


@query(f"""
WITH {PART_WORDS}, c AS (SELECT a.w, b.w AS other, levenshtein(a.w, b.w) AS distance, row_number() OVER (PARTITION BY a.w ORDER BY levenshtein(a.w, b.w), b.w) AS k FROM w a JOIN w b
  ON a.w <> b.w AND a.w[1] = b.w[1] AND abs(length(a.w) - length(b.w)) <= 2 AND b.size / a.size BETWEEN 0.6 AND 1.6 AND levenshtein(a.w, b.w) <= 2)
SELECT w, other, distance::INTEGER AS distance FROM c WHERE k = 1""")
def lookalike_words(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w"), "p_size")
    return text.lookalikes(p.groupBy("w").agg(F.avg("p_size").alias("size")))


# ---------------------------------------------------------------- catalog


@query("""
SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), '|') AS flaw_codes, array_to_string(list_sort(list(DISTINCT l_linestatus)), '|') AS categories, max(l_linenumber) AS max_level, count(*)::INTEGER AS n_regions FROM lineitem GROUP BY 1""")
def manifest_flatten(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_returnflag").alias("flaw"), F.col("l_linestatus").alias("category"), F.col("l_linenumber").alias("level")).alias("r"))
    return catalog.manifest(lines.groupBy("l_orderkey").agg(F.collect_list("r").alias("what")))


@query("""SELECT l_returnflag, """ + ", ".join(f'count(*) FILTER (l_linenumber = {k}) AS "{k}"' for k in range(1, 8)) + """ FROM lineitem GROUP BY 1""")
def flaw_level_grid(spark, sf_dir):
    return catalog.grid(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber", list(range(1, 8)))


@query("""SELECT l_returnflag, sum(l_discount * l_quantity) / sum(l_quantity) AS share, sum(l_quantity) AS weight FROM lineitem GROUP BY 1""")
def weighted_gate_share(spark, sf_dir):
    return catalog.weighted_share(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity")


@query("""
SELECT event_type, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'middle' ELSE 'low' END AS placed_at, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY event_type) AS share FROM events GROUP BY 1, 2""")
def placement_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns({"a": F.when(F.col("value") > 50, "high").otherwise(""), "b": F.when(F.col("value") > 10, "middle"), "c": F.lit("low")})
    return catalog.placement(e, "event_type", ["a", "b", "c"])


@query("""
WITH f AS (SELECT l_returnflag AS flaw, l_linenumber AS level, avg(l_tax) AS felt FROM lineitem GROUP BY 1, 2),
r AS (SELECT flaw, bool_and(rises) AND count(*) >= 3 AS rising FROM (SELECT flaw, coalesce(felt > lag(felt) OVER (PARTITION BY flaw ORDER BY level), true) AS rises FROM f) GROUP BY 1),
s AS (SELECT l_returnflag AS flaw, count(l_linestatus) AS rated, count(*) AS total, avg((l_linestatus <> 'O')::INT) AS "natural" FROM lineitem GROUP BY 1)
SELECT s.flaw, rated, total, "natural", rising, CASE WHEN rated < total THEN 'incomplete' WHEN "natural" >= 0.4 AND rising THEN 'PASS' ELSE 'FAIL' END AS verdict FROM s JOIN r USING (flaw)""")
def pilot_gate_status(spark, sf_dir):
    realism = F.when(F.col("l_linestatus") == "O", "robotic").otherwise(F.col("l_linestatus"))
    r = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flaw"), F.col("l_linenumber").alias("level"), realism.alias("realism"), F.col("l_tax").alias("level_feel"))
    return catalog.pilot_gate(r, least_share=0.4)


@query("""SELECT n_name, """ + ", ".join(f"count(*) FILTER (c_mktsegment = '{s}') AS \"{s}\"" for s in ("BUILDING", "MACHINERY")) + """ FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def coverage_pivot(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return catalog.grid(c, "n_name", "c_mktsegment", ["BUILDING", "MACHINERY"])


@query("""SELECT c_mktsegment FROM (VALUES ('BUILDING'), ('AEROSPACE'), ('FURNITURE')) v(c_mktsegment) WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM customer)""")
def set_inclusion(spark, sf_dir):
    return catalog.domain_missing(table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "AEROSPACE", "FURNITURE"])


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def upsert_latest(spark, sf_dir):
    return catalog.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('rater|' || c_custkey::VARCHAR))::INTEGER AS place FROM customer""")
def stable_hash_order(spark, sf_dir):
    key = catalog.stable_order(F.lit("rater"), F.col("c_custkey").cast("string"))
    return series.placed(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", key.alias("key")), ["c_nationkey"], ["key"]).select("c_custkey", "place")


@query("""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS of_byte)
SELECT c_custkey, xor(list_reduce(list_concat([4294967295], list_transform(string_split(c_name || '|SHOUT', ''), lambda s: unicode(s)::BIGINT)), lambda c, b: xor(c >> 8, of_byte[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS seed
FROM customer, t""")
def crc_seed(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.seed_of(F.col("c_name"), F.lit("SHOUT")).alias("seed"))


@query("""
WITH c AS (SELECT l_returnflag, median(l_quantity) AS m FROM lineitem GROUP BY 1)
SELECT l_returnflag, any_value(m) AS median, 1.4826 * median(abs(l_quantity - m)) AS mad, quantile_cont(l_quantity, 0.05) AS p05, quantile_cont(l_quantity, 0.95) AS p95, count(*) AS n FROM lineitem JOIN c USING (l_returnflag) GROUP BY 1""")
def pause_norms(spark, sf_dir):
    return catalog.pause_norms(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


@query("""
WITH u AS (SELECT p_partkey, p_brand, pow((('0x' || substr(md5(p_partkey::VARCHAR), 1, 13))::BIGINT + 1) / 4503599627370497.0, 1.0 / p_size) AS k FROM part WHERE p_size > 0)
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY k DESC, p_partkey)::INTEGER AS place FROM u""")
def weighted_sample_order(spark, sf_dir):
    uniform = (F.conv(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 13), 16, 10).cast("long") + 1) / 4503599627370497.0
    p = table(spark, sf_dir, "part").withColumn("k", -catalog.weighted_order(uniform, F.col("p_size"))).filter("k is not null")
    return series.placed(p.select("p_partkey", "p_brand", "k"), ["p_brand"], ["k", "p_partkey"]).select("p_partkey", "place")


# ---------------------------------------------------------------- alignment, calibration


@query()
def nw_alignment(spark, sf_dir):
    """Each turn of a conversation aligned word by word with the turn of the next number; ``clip_id`` is conversation:turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(text.words_in(F.coalesce("text", F.lit(""))), lambda t: t["clean"]).alias("ref"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ref").alias("hyp"))
    pairs = turns.join(after, ["conv_id", "turn"]).withColumn("clip_id", F.concat_ws(":", "conv_id", "turn"))
    return align.aligned_counts(pairs)


@query()
def dtw_distance(spark, sf_dir):
    """Embeddings as short series of frames (eight numbers each), each warped onto its block's next label.

    A label's vectors among 50 consecutive ids are a series, so its length is
    bounded whatever the table's size; the last label is followed by the
    first, a label alone in its block by itself.
    """
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings").withColumn("block", F.floor(F.col("vec_id") / 50))
    frames = e.select("block", "label", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, 8))).alias("k", "v"), "vec_id", "embedding")
    order = F.row_number().over(Window.partitionBy("block", "label").orderBy("vec_id", "embedding", "k")) - 1
    frames = frames.select("block", "label", order.alias("frame_i"), F.col("v").cast("array<double>").alias("vector"))
    there = e.select("block", "label").distinct()
    after = F.coalesce(F.lead("label").over(Window.partitionBy("block").orderBy("label")), F.min("label").over(Window.partitionBy("block")))
    onto = there.select("block", F.col("label").alias("of_label"), after.alias("label"))
    ref = frames.select(F.concat_ws(":", "block", "label").alias("clip_id"), "frame_i", "vector")
    par = frames.join(onto, ["block", "label"]).select(F.concat_ws(":", "block", "of_label").alias("clip_id"), "frame_i", "vector")
    path = align.frame_alignment(ref, par)
    return path.groupBy("clip_id").agg(F.max("path_cost").alias("path_cost"), F.count(F.lit(1)).alias("steps"))


@query("""
WITH g AS (SELECT unnest([10.0, 20.0, 40.0, 80.0]) AS threshold), n AS (SELECT count(*) AS total FROM events WHERE event_type = 'purchase'),
c AS (SELECT threshold, count(*) FILTER (event_type = 'purchase') AS tp, count(*) AS found FROM events, g WHERE value >= threshold GROUP BY 1),
f AS (SELECT threshold, 2 * tp / (found + total) AS f1 FROM c, n)
SELECT 'all' AS flaw, threshold::DOUBLE AS threshold, f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1""")
def threshold_grid_search(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    total = e.agg(F.count_if(F.col("event_type") == "purchase").alias("n_truth"))
    scored = e.crossJoin(F.broadcast(total)).select(F.lit("all").alias("flaw"), F.col("value").alias("d"), (F.col("event_type") == "purchase").alias("hit"), "n_truth")  # total is one row
    return calibrate.best_threshold(scored, [10.0, 20.0, 40.0, 80.0])


@query("""
WITH p AS (SELECT l_returnflag AS flaw, l_quantity AS x, avg(l_linenumber) AS y, count(*) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS k FROM lineitem GROUP BY 1, 2),
a AS (SELECT i.flaw, i.k AS i, j.k AS j, sum(m.y * m.n) / sum(m.n) AS mean FROM p i JOIN p j ON i.flaw = j.flaw AND i.k <= j.k JOIN p m ON m.flaw = i.flaw AND m.k BETWEEN i.k AND j.k GROUP BY 1, 2, 3),
b AS (SELECT a.flaw, i, p.k, min(mean) AS lowest FROM a JOIN p ON p.flaw = a.flaw AND a.i <= p.k AND a.j >= p.k GROUP BY 1, 2, 3),
f AS (SELECT flaw, k, round(max(lowest), 9) AS y FROM b GROUP BY 1, 2), s AS (SELECT f.flaw, f.y, min(x) AS low, max(x) AS high FROM f JOIN p ON p.flaw = f.flaw AND p.k = f.k GROUP BY 1, 2)
SELECT flaw, low AS x, y FROM s UNION SELECT flaw, high, y FROM s""")
def isotonic_knots(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flaw"), F.col("l_quantity").alias("d"), F.col("l_linenumber").alias("level"))
    return calibrate.isotonic(lines).withColumn("y", F.round("y", 9))


@query("""SELECT l_returnflag, greatest(0.4, least(2.0, sum(l_tax * l_discount) / sum(l_tax * l_tax))) AS weight FROM lineitem GROUP BY 1""")
def least_squares_weight(spark, sf_dir):
    return calibrate.weight_of_least_squares(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_tax", "l_discount")


# ---------------------------------------------------------------- retakes, cuts


@query("""
SELECT l_orderkey, l_linenumber, round(l_quantity * CASE WHEN was > 0 THEN least(1.0, now / was) WHEN now > 0 THEN 1.0 ELSE 0.0 END, 2) AS points_after FROM
(SELECT *, greatest(0.0, 0.02 - l_discount, l_discount - 0.05) AS was, greatest(0.0, 0.02 - l_tax, l_tax - 0.05) AS now FROM lineitem)""")
def retake_points(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("points_lost"), F.col("l_discount").alias("first"), F.col("l_tax").alias("again"), F.lit(0.02).alias("low"), F.lit(0.05).alias("high"))
    return retake.points_after(lines).select("l_orderkey", "l_linenumber", "points_after")


@query("""
WITH f AS (SELECT *, value > 60 AS flagged, row_number() OVER w - 1 AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(flagged::INT) OVER (PARTITION BY user_id ORDER BY i) AS block FROM f),
n AS (SELECT user_id, i, block, (row_number() OVER (PARTITION BY user_id, block ORDER BY i) - 1) // 8 AS k FROM g WHERE NOT flagged)
SELECT user_id AS clip_id, min(i) AS w0, max(i) AS w1 FROM n GROUP BY user_id, block, k HAVING count(*) = 8""")
def clean_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("i", F.row_number().over(series._in_order(USER, ORDER)) - 1)
    return retake.clean_windows(e.select(F.col("user_id").alias("clip_id"), "i", (F.col("value") > 60).alias("flagged"))).select("clip_id", "w0", "w1")


@query("""
WITH b AS (SELECT *, coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders)
SELECT o_custkey, o_orderkey FROM b WHERE before < 500000""")
def until_total(spark, sf_dir):
    return sources.until_total(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 500000.0).select("o_custkey", "o_orderkey")


@query("""
WITH s AS (SELECT o_custkey % 50 AS take, CASE o_orderstatus WHEN 'F' THEN NULL ELSE o_orderstatus END AS condition, avg(o_totalprice) AS overall FROM orders GROUP BY 1, 2)
SELECT a.condition, avg(abs(a.overall - b.overall)) AS mean_shift, max(abs(a.overall - b.overall)) AS worst_shift, count(*) AS n FROM s a JOIN s b ON a.take = b.take AND b.condition IS NULL WHERE a.condition IS NOT NULL GROUP BY 1""")
def invariance_by_condition(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumns({"take_id": F.pmod("o_custkey", F.lit(50)), "condition": F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))})
    return evaluate.invariance(o.groupBy("take_id", "condition").agg(F.avg("o_totalprice").alias("overall")))


@query(f"""
WITH t AS (SELECT event_id, user_id, event_type, {T} AS t FROM events), m AS (SELECT * FROM t WHERE event_type IN ('view', 'click')),
f AS (SELECT user_id, t AS s, t + 1800 AS e, event_id % 2 = 0 AS same FROM t WHERE event_type = 'error'),
h AS (SELECT m.event_id, m.event_type, count(f.s) > 0 AS hit, coalesce(bool_or(m.event_id % 2 = 0 AND f.same OR m.event_id % 2 = 1 AND NOT f.same), false) AS same FROM m LEFT JOIN f ON m.user_id = f.user_id AND m.t >= f.s - 600 AND m.t <= f.e + 600 GROUP BY 1, 2)
SELECT event_type AS rater, count(*) AS n_marks, count(*) FILTER (hit) AS any_area, count(*) FILTER (same) AS same_area FROM h GROUP BY 1""")
def marks_met(spark, sf_dir):
    e = timed(table(spark, sf_dir, "events")).withColumn("area", F.pmod("event_id", F.lit(2)).cast("string"))
    marks = e.filter("event_type in ('view', 'click')").select(F.col("event_type").alias("rater"), F.col("user_id").alias("clip"), F.col("t").alias("t_s"), "area", F.col("event_id").alias("mark_id"))
    flags = e.filter("event_type = 'error'").select(F.col("user_id").alias("clip"), F.col("t").alias("start_s"), (F.col("t") + 1800).alias("end_s"), F.col("area").alias("category"))
    return evaluate.marks_met(marks, flags, within_s=600.0, width=3600.0)


@query("""SELECT l_returnflag AS flaw, round(greatest(0.1, avg((l_discount > 0.05)::INT)), 3) AS reliability FROM lineitem GROUP BY 1""")
def fit_reliability(spark, sf_dir):
    return calibrate.reliability(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flaw"), (F.col("l_discount") > 0.05).alias("hit")))
