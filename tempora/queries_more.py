"""Queries for schemas, spectra, best paths, edges of words and edits over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from tempora.functions import named
from tempora.operators import detect, edges, sound, spectral
from tempora.plans import verify
from tempora.queries import USER, T, query, table, timed
from tempora.runtime import shared_folder
from tempora.sources import paged, schema

# ---------------------------------------------------------------- schemas

#: What an order with its lines has to be; some orders break each rule.
ORDER_SCHEMA = {
    "type": "object",
    "required": ["id", "status", "total", "lines"],
    "properties": {
        "id": {"type": "integer", "minimum": 0},
        "status": {"enum": ["F", "O"]},
        "priority": {"type": "string", "pattern": "^[1-4]-"},
        "total": {"type": "number", "exclusiveMaximum": 400000},
        "lines": {"type": "array", "minItems": 2, "items": {"$ref": "#/$defs/line"}},
    },
    "$defs": {
        "line": {
            "type": "object",
            "required": ["flag"],
            "additionalProperties": False,
            "properties": {"quantity": {"type": "integer", "maximum": 48}, "flag": {"type": "string"}, "number": {"const": 1}},
        }
    },
}


@query("""
WITH l AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS k, l_quantity::BIGINT AS quantity, l_linenumber AS number,
  CASE WHEN l_returnflag <> 'R' OR l_linenumber > 2 THEN l_returnflag END AS flag, l_discount >= 0.09 AS off FROM lineitem),
o AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 7 > 0 THEN o_orderstatus END AS status, o_orderpriority AS priority, o_totalprice AS total, (SELECT count(*) FROM l WHERE l.id = o_orderkey) AS n FROM orders)
SELECT id, '<root>' AS path, '''status'' is a required property' AS message FROM o WHERE status IS NULL
UNION ALL SELECT id, 'status', '''' || status || ''' is not one of [''F'', ''O'']' FROM o WHERE status NOT IN ('F', 'O')
UNION ALL SELECT id, 'priority', '''' || priority || ''' does not match ''^[1-4]-''' FROM o WHERE priority NOT SIMILAR TO '[1-4]-.*'
UNION ALL SELECT id, 'total', 'too much' FROM o WHERE total >= 400000
UNION ALL SELECT id, 'lines', 'too short' FROM o WHERE n < 2
UNION ALL SELECT id, 'lines/' || k || '/quantity', quantity || ' is greater than the maximum of 48' FROM l SEMI JOIN o USING (id) WHERE quantity > 48
UNION ALL SELECT id, 'lines/' || k || '/number', '1 was expected' FROM l SEMI JOIN o USING (id) WHERE number <> 1
UNION ALL SELECT id, 'lines/' || k, '''flag'' is a required property' FROM l SEMI JOIN o USING (id) WHERE flag IS NULL
UNION ALL SELECT id, 'lines/' || k, 'Additional properties are not allowed (''off'' was unexpected)' FROM l SEMI JOIN o USING (id) WHERE off""")
def schema_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as documents, against a schema with nested parts and references."""
    flag = F.when((F.col("l_returnflag") != "R") | (F.col("l_linenumber") > 2), F.col("l_returnflag"))
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("place")
    line = F.struct(F.col("l_quantity").cast("long").alias("quantity"), F.col("l_linenumber").alias("number"), flag.alias("flag"), F.when(F.col("l_discount") >= 0.09, True).alias("off"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", place, line.alias("line")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))  # an order's lines
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    of_lines = F.coalesce(F.transform("lines", lambda x: x["line"]), F.from_json(F.lit("[]"), "array<struct<quantity: long, number: int, flag: string, off: boolean>>"))
    doc = F.struct(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 7 > 0, F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("total"), of_lines.alias("lines"),
    )
    told = schema.breaches(orders.select(F.col("o_orderkey").alias("id"), F.to_json(doc).alias("value")), ORDER_SCHEMA)
    # how a price or a whole list is shown is not a matter of the rules
    short = F.when(F.col("path") == "total", "too much").when(F.col("path") == "lines", "too short").otherwise(F.col("message"))
    return told.select("id", "path", short.alias("message"))


# ---------------------------------------------------------------- spectra and paths

_WIDTH, _STEP, _BANDS, _RATE = 16, 8, 4, 1000


def _features_sql() -> str:
    """The spectra by sums of sines and cosines; the mel bank and the window are constants."""
    bank = spectral.mel_bank(_RATE, _WIDTH, _BANDS, 20.0, 480.0)
    taper = spectral._taper(_WIDTH)
    weights = ", ".join(f"({b}, {k}, {bank[b, k]!r})" for b in range(len(bank)) for k in range(_BANDS)).replace("np.float64(", "").replace("))", ")")
    window = ", ".join(f"({i}, {float(w)!r})" for i, w in enumerate(taper))
    half, frames = _WIDTH // 2, (64 + _WIDTH - _WIDTH) // _STEP + 1
    return f"""
WITH weights AS (SELECT * FROM (VALUES {weights}) v(b, k, w)), window_ AS (SELECT * FROM (VALUES {window}) v(i, w)),
x AS (SELECT vec_id, unnest(range(64)) + {half} AS p, unnest(embedding)::DOUBLE AS x FROM embeddings),
frames AS (SELECT vec_id, f, p - f * {_STEP} AS i, x FROM x, range({frames}) t(f) WHERE p >= f * {_STEP} AND p < f * {_STEP} + {_WIDTH}),
power AS (SELECT vec_id, f, b, pow(sum(x * w * cos(2 * pi() * b * i / {_WIDTH})), 2) + pow(sum(x * w * sin(2 * pi() * b * i / {_WIDTH})), 2) AS p FROM frames JOIN window_ USING (i), range({half + 1}) t(b) GROUP BY ALL),
logs AS (SELECT vec_id, f, k, ln(sum(p * w) + 1e-8) AS l FROM power JOIN weights USING (b) GROUP BY ALL),
levelled AS (SELECT vec_id, f, k, (l - avg(l) OVER c) / (stddev_pop(l) OVER c + 1e-6) AS l FROM logs WINDOW c AS (PARTITION BY vec_id, k)),
inner_ AS (SELECT vec_id, f, k, l, (2 * lead(l, 2) OVER o + lead(l) OVER o - lag(l) OVER o - 2 * lag(l, 2) OVER o) / 10 AS d FROM levelled WINDOW o AS (PARTITION BY vec_id, k ORDER BY f)),
sloped AS (SELECT vec_id, f, k, l, coalesce(d, CASE WHEN f < 2 THEN first_value(d IGNORE NULLS) OVER a ELSE last_value(d IGNORE NULLS) OVER a END) AS d FROM inner_ WINDOW a AS (PARTITION BY vec_id, k ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT vec_id, f::INTEGER AS frame_i, k::INTEGER AS band, round(l, 5) + 0.0 AS level, round(0.5 * d, 5) + 0.0 AS slope FROM sloped
"""


@query(_features_sql())
def spectral_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as short signals: mel levels and slopes of every frame."""
    signals = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(_RATE).alias("sr"), F.col("embedding").alias("samples"))
    made = spectral.features(signals, _WIDTH / _RATE, _STEP / _RATE, _BANDS, 20.0, 480.0, keep=("vec_id",))
    each = made.select("vec_id", "frame_i", F.posexplode("vector").alias("at", "x"))
    pairs = each.groupBy("vec_id", "frame_i", (F.col("at") % _BANDS).alias("band")).agg(*[(F.round(F.max(F.when(F.floor(F.col("at") / _BANDS) == k, F.col("x"))), 5) + 0.0).alias(n) for k, n in enumerate(("level", "slope"))])
    return pairs


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, floor({T} / 7200)::BIGINT AS step, event_id, value + 1 AS v, (event_id % 10) / 10.0::DOUBLE AS s FROM events),
f AS (SELECT user_id, step, list({{'id': event_id, 'v': v, 's': s}} ORDER BY v, event_id) AS c, row_number() OVER (PARTITION BY user_id ORDER BY step) AS k FROM e GROUP BY user_id, step),
go AS (SELECT user_id, k, c, list_transform(c, lambda x: x.s) AS total, list_transform(c, lambda x: 0::BIGINT) AS back FROM f WHERE k = 1
  UNION ALL SELECT user_id, k, c, list_transform(list_zip(reached, c), lambda z: list_max(z[1]) + z[2].s), list_transform(reached, lambda r: list_position(r, list_max(r))::BIGINT)
  FROM (SELECT f.user_id, f.k, f.c, list_transform(f.c, lambda x: list_transform(list_zip(go.total, go.c), lambda p: p[1] - 0.3 * abs(log2(p[2].v) - log2(x.v)))) AS reached FROM go JOIN f ON f.user_id = go.user_id AND f.k = go.k + 1)),
stay AS (SELECT user_id, k, c, back, list_position(total, list_max(total))::BIGINT AS chosen FROM go QUALIFY k = max(k) OVER (PARTITION BY user_id)
  UNION ALL SELECT g.user_id, g.k, g.c, g.back, s.back[s.chosen] FROM stay s JOIN go g ON g.user_id = s.user_id AND g.k = s.k - 1)
SELECT c[chosen].id AS event_id FROM stay""")
def best_event_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each two hours of a user the event on the path of strong events with the smallest jumps of value."""
    e = timed(table(spark, sf_dir, "events")).select(
        "user_id", F.floor(F.col("t") / 7200).alias("step"), "event_id", (F.col("value") + 1).alias("v"), ((F.col("event_id") % 10) / 10.0).cast("double").alias("s")
    )
    return spectral.best_paths(e, USER, "step", "v", "s", "event_id", jump=0.3).select("event_id")


def _resampled_sql(up: int = 3, down: int = 2) -> str:
    h = [float(x) for x in sound.sinc_filter(up, down)]
    n = -(-64 * up // down)
    return f"""
WITH h AS (SELECT unnest({h}) AS h, unnest(range({len(h)})) AS i), x AS (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, n::INTEGER AS n, round(sum(x * h)::FLOAT::DOUBLE, 4) + 0.0 AS y FROM x, range({n}) t(n) JOIN h ON true WHERE i = n * {down} + {len(h) // 2} - k * {up} GROUP BY vec_id, n
"""


@query(_resampled_sql())
def resampled_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as signals at 1000 samples a second, at 1500."""
    signals = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.lit(1000).alias("sr"), F.col("embedding").alias("samples"))
    made = sound.resampled(signals, 1500).select(F.col("path").cast("long").alias("vec_id"), F.posexplode("samples").alias("n", "x"))
    return made.select("vec_id", "n", (F.round(F.col("x").cast("double"), 4) + 0.0).alias("y"))


# ---------------------------------------------------------------- edges of words


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: a user is a clip, and events in order of time are its frames."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), (F.row_number().over(w) - 1).alias("frame_i"), F.col("value").alias("level"), "event_id", "event_type")


NUMBERED = "n AS (SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_i, value AS level, event_id, event_type FROM events)"


@query(f"""
WITH {NUMBERED}, near AS (SELECT a.event_id, b.level, b.frame_i - a.frame_i AS o FROM n a JOIN n b ON a.clip_id = b.clip_id AND b.frame_i BETWEEN a.frame_i - 5 AND a.frame_i + 3)
SELECT event_id, level AS low, o::INTEGER AS low_offset FROM near QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY level, abs(o), o) = 1""")
def lowest_near_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.lowest_near(_numbered(spark, sf_dir), ["clip_id"], ["frame_i"], "level", 5, 3).select("event_id", "low", "low_offset")


@query(f"""
WITH {NUMBERED}, f AS (SELECT *, quantile_cont(level, 0.05) OVER (PARTITION BY clip_id) AS floor FROM n), near AS (SELECT a.event_id, b.level, a.floor * 2 AS floor, b.frame_i - a.frame_i AS o FROM f a JOIN n b ON a.clip_id = b.clip_id AND abs(b.frame_i - a.frame_i) <= 8),
each AS (SELECT event_id, k, level, o, floor FROM near JOIN (VALUES (2), (4), (8)) t(k) ON abs(o) <= k QUALIFY row_number() OVER (PARTITION BY event_id, k ORDER BY level, abs(o), o) = 1)
SELECT event_id, level AS low, o::INTEGER AS low_offset FROM each QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN level < floor OR k = 8 THEN k ELSE 100 END) = 1""")
def quiet_near_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _numbered(spark, sf_dir)
    floored = frames.join(edges.floors(frames), "clip_id")
    return edges.quiet_near(floored, ["clip_id"], ["frame_i"], "level", F.col("floor_db") * 2, [2, 4, 8]).select("event_id", "low", "low_offset")


@query(f"""
WITH RECURSIVE {NUMBERED}, w AS (SELECT clip_id, frame_i // 7 AS i, min(frame_i)::DOUBLE AS s, max(frame_i) + 1.0::DOUBLE - (frame_i // 7 % 3 = 0)::INT AS e FROM n GROUP BY clip_id, frame_i // 7),
sm AS (SELECT clip_id, frame_i, (coalesce(lag(level) OVER o, 0) + level + coalesce(lead(level) OVER o, 0)) / 3 AS level FROM n WINDOW o AS (PARTITION BY clip_id ORDER BY frame_i)),
p AS (SELECT *, lead(s) OVER o AS ns, lead(e) OVER o AS ne, row_number() OVER o AS k FROM w WINDOW o AS (PARTITION BY clip_id ORDER BY i)),
b AS (SELECT p.clip_id, p.i, list({{'f': frame_i, 'l': level}} ORDER BY level, frame_i) AS levels FROM p JOIN sm ON p.clip_id = sm.clip_id AND ns - e < 0.5 AND frame_i BETWEEN floor((e + ns) / 2 - 4) AND floor(least(ne - 1, (e + ns) / 2 + 4)) GROUP BY ALL),
q AS (SELECT p.*, coalesce(ns - e < 0.5, false) AS touching, levels FROM p LEFT JOIN b USING (clip_id, i)),
go AS (SELECT clip_id, k, i, s AS start_s, CASE WHEN touching THEN coalesce(list_filter(levels, lambda x: x.f >= floor(greatest(s + 1, (e + ns) / 2 - 4)))[1].f + 1, (e + ns) / 2) ELSE e END AS end_s, touching FROM q WHERE k = 1
  UNION ALL SELECT q.clip_id, q.k, q.i, CASE WHEN go.touching THEN go.end_s ELSE q.s END, CASE WHEN q.touching THEN coalesce(list_filter(q.levels, lambda x: x.f >= floor(greatest(CASE WHEN go.touching THEN go.end_s ELSE q.s END + 1, (q.e + q.ns) / 2 - 4)))[1].f + 1, (q.e + q.ns) / 2) ELSE q.e END, q.touching
  FROM go JOIN q ON q.clip_id = go.clip_id AND q.k = go.k + 1)
SELECT clip_id, i, start_s::DOUBLE AS start_s, end_s::DOUBLE AS end_s FROM go""")
def cut_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of seven events, two of three of which touch the next one."""
    frames = _numbered(spark, sf_dir)
    words = frames.groupBy("clip_id", F.floor(F.col("frame_i") / 7).alias("i")).agg(F.min("frame_i").cast("double").alias("start_s"), F.max("frame_i").alias("last"))
    words = words.select("clip_id", "i", "start_s", (F.col("last") + 1.0 - F.when(F.col("i") % 3 == 0, 1).otherwise(0)).alias("end_s"))
    return edges.refined_words(words, frames, step_s=1.0, touching_s=0.5, kept_s=1.0, reach_s=4.0)


@query(f"""
WITH {NUMBERED}, s AS (SELECT clip_id, frame_i // 12 AS rid, frame_i, event_type IN ('click', 'view') AS v, level FROM n),
g AS (SELECT *, v OR (coalesce(lag(v) OVER o, false) AND coalesce(lead(v) OVER o, false)) AS b FROM s WINDOW o AS (PARTITION BY clip_id, rid ORDER BY frame_i)),
r AS (SELECT *, frame_i - row_number() OVER (PARTITION BY clip_id, rid ORDER BY frame_i) AS k FROM g WHERE b),
t AS (SELECT clip_id, rid, k, min(frame_i) AS a, max(frame_i) AS b, count(*) AS n, quantile_cont(CASE WHEN v THEN level ELSE 0 END, 0.5) AS f0 FROM r GROUP BY clip_id, rid, k HAVING count(*) >= 3)
SELECT clip_id, rid, a - 0.5::DOUBLE AS start_s, b + 0.5::DOUBLE AS end_s, f0 FROM t QUALIFY row_number() OVER (PARTITION BY clip_id, rid ORDER BY n DESC, a) = 1""")
def longest_voiced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each twelve events of a user the longest stretch of clicks and views."""
    frames = _numbered(spark, sf_dir).select("clip_id", "frame_i", F.col("event_type").isin("click", "view").alias("voiced"), F.col("level").alias("f0"))
    spans = frames.select("clip_id", F.floor(F.col("frame_i") / 12).alias("rid")).distinct().withColumns({"start_s": F.col("rid") * 12.0, "end_s": F.col("rid") * 12.0 + 12.0})
    return edges.voiced_stretches(spans, frames, step_s=1.0, least_s=3.0)


# ---------------------------------------------------------------- pages of a service

PAGE = 500


@query("SELECT o_orderkey AS row_idx, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey >= 700")
def paged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a service gives them, a page a file, read back by the data source from the second page on."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    row = F.struct(F.col("o_orderkey").alias("row_idx"), F.struct("o_custkey", "o_orderstatus", "o_totalprice").alias("row"))
    pages = orders.groupBy(F.floor(F.col("o_orderkey") / PAGE).alias("page")).agg(F.to_json(F.struct(F.collect_list(row).alias("rows"))).alias("value"))  # PAGE rows
    folder = shared_folder(spark, "pages")
    pages.write.partitionBy("page").text(folder)
    total = orders.agg(F.max("o_orderkey")).first()[0] + 1
    read = paged.paged_rows(spark, folder + "/page={page}", "row_idx long, o_custkey long, o_orderstatus string, o_totalprice double", total, page_size=PAGE, pages_per_task=20)
    return read.filter("row_idx >= 700")


# ---------------------------------------------------------------- edits

#: Lines of an order as edits of it: each in its own 100 units, replaced by a stretch of another length or removed.
EDITS = "e AS (SELECT o AS clip_id, k * 100 + q AS a, k * 100 + q + d AS b, CASE WHEN d % 4 = 0 THEN 0 ELSE q END AS n FROM (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS k, l_quantity::BIGINT AS q, (l_discount * 100)::BIGINT AS d FROM lineitem))"
POINTS = "p AS (SELECT o_orderkey AS clip_id, o_custkey * 7 % 800 + k * 50.5::DOUBLE AS t, k FROM orders, range(4) r(k))"


def _edits_and_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip_id"), F.row_number().over(w).alias("k"), F.col("l_quantity").cast("long").alias("q"), F.rint(F.col("l_discount") * 100).cast("long").alias("d"))
    start = F.col("k") * 100 + F.col("q")
    edits = lines.select("clip_id", start.alias("a"), (start + F.col("d")).alias("b"), F.when(F.col("d") % 4 == 0, 0).otherwise(F.col("q")).alias("n"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip_id"), "o_custkey", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k"))
    return edits, orders.select("clip_id", "k", (F.col("o_custkey") * 7 % 800 + F.col("k") * F.lit(50.5)).alias("t"))


@query(f"""
WITH {EDITS}, {POINTS}, m AS (SELECT *, a + coalesce(sum(n - (b - a)) OVER (PARTITION BY clip_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS na FROM e),
hit AS (SELECT p.*, m.a, m.b, m.na, m.n FROM p ASOF LEFT JOIN m ON p.clip_id = m.clip_id AND p.t >= m.a),
n AS (SELECT *, CASE WHEN a IS NULL THEN t WHEN t < b THEN na + (t - a) * n / (b - a) ELSE na + n + t - b END AS new_t FROM hit),
back AS (SELECT n.clip_id, n.k, n.t, new_t, m.a AS a2, m.b AS b2, m.na AS na2, m.n AS n2 FROM n ASOF LEFT JOIN m ON n.clip_id = m.clip_id AND new_t >= m.na)
SELECT clip_id, k::INTEGER AS k, round(new_t, 6) + 0.0 AS new_t, round(CASE WHEN a2 IS NULL THEN new_t WHEN new_t < na2 + n2 THEN a2 + (new_t - na2) * (b2 - a2) / n2 ELSE b2 + new_t - na2 - n2 END, 6) + 0.0 AS old_t FROM back""")
def times_through_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of orders carried through the edits that their lines are, and back."""
    edits, points = _edits_and_points(spark, sf_dir)
    there = verify.to_new(points, edits)
    back = verify.to_old(there, edits, at="new_t")
    return back.select("clip_id", "k", (F.round("new_t", 6) + 0.0).alias("new_t"), (F.round("old_t", 6) + 0.0).alias("old_t"))


@query("""
WITH r AS (SELECT l_suppkey % 50 AS take_id, list_extract(['PACE_FAST', 'PAUSE_BAD', 'FILLER', 'PAUSE_LOST', 'RARE_HESIT', 'WORD_SKIP', 'SHOUT'], (l_partkey % 7 + 1)::INT) AS flaw, l_linenumber AS level, l_quantity + l_linenumber AS new, l_quantity * (1 + l_tax) AS old FROM lineitem),
v AS (SELECT *, CASE flaw WHEN 'PACE_FAST' THEN old / greatest(new, 1e-6) WHEN 'PAUSE_BAD' THEN new WHEN 'FILLER' THEN new WHEN 'PAUSE_LOST' THEN old - new WHEN 'RARE_HESIT' THEN new - old WHEN 'WORD_SKIP' THEN old END AS value FROM r WHERE level BETWEEN 1 AND 5),
e AS (SELECT take_id, flaw, level, CASE WHEN flaw IN ('FILLER', 'WORD_SKIP') THEN sum(value) ELSE avg(value) END AS effect FROM v GROUP BY take_id, flaw, level HAVING sum(value) IS NOT NULL),
s AS (SELECT *, effect - lag(effect) OVER (PARTITION BY take_id, flaw ORDER BY level) AS step, rank() OVER (PARTITION BY take_id, flaw ORDER BY level) AS lr, rank() OVER (PARTITION BY take_id, flaw ORDER BY effect) + (count(*) OVER (PARTITION BY take_id, flaw, effect) - 1) / 2 AS er, count(*) OVER (PARTITION BY take_id, flaw) AS n FROM e)
SELECT take_id, flaw, max(effect) FILTER (level = 1) AS L1, max(effect) FILTER (level = 5) AS L5, CASE WHEN max(n) >= 2 THEN round(corr(lr, er), 9) + 0.0 END AS spearman,
  coalesce(min(step) >= -1e-6, true) OR coalesce(max(step) <= 1e-6, true) AS monotonic, coalesce(min(step) >= -1e-6, true) AS rises FROM s GROUP BY take_id, flaw""")
def dose_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as regions of flaws of time, by supplier: whether effects rise with the level."""
    flaw = F.element_at(F.array(*[F.lit(f) for f in ("PACE_FAST", "PAUSE_BAD", "FILLER", "PAUSE_LOST", "RARE_HESIT", "WORD_SKIP", "SHOUT")]), (F.col("l_partkey") % 7 + 1).cast("int"))
    regions = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("take_id"), flaw.alias("flaw"), F.col("l_linenumber").alias("level"), F.lit(0.0).alias("start_s"), (F.col("l_quantity") + F.col("l_linenumber")).alias("end_s"),
        F.lit(0.0).alias("baseline_start_s"), (F.col("l_quantity") * (1 + F.col("l_tax"))).alias("baseline_end_s"),
    )
    return verify.doses(verify.timed_measures(regions), ["take_id"]).select("take_id", "flaw", "L1", "L5", (F.round("spearman", 9) + 0.0).alias("spearman"), "monotonic", "rises")


# ---------------------------------------------------------------- functions by name


@query("""
WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events), h AS (SELECT *, r - row_number() OVER (PARTITION BY user_id ORDER BY r) AS k FROM n WHERE value > 5)
SELECT user_id, min(r) AS first_row, max(r) AS last_row, count(*) AS n, max(value) AS most FROM h GROUP BY user_id, k HAVING count(*) >= 3""")
def runs_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three large events of a user, by the table function in SQL."""
    named.register(spark)
    table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value").createOrReplaceTempView("events_of_runs")
    return spark.sql("SELECT * FROM runs_above(TABLE(events_of_runs) PARTITION BY user_id ORDER BY (ts, event_id), key => 'user_id', value => 'value', above => 5.0, least => 3)")


# ---------------------------------------------------------------- detectors

_FRAMES = """n AS (SELECT user_id // 10 AS clip_id, row_number() OVER (PARTITION BY user_id // 10 ORDER BY ts, event_id) - 1 AS frame_i, event_id, event_type, value FROM events),
f AS (SELECT clip_id, frame_i, value % 10 + CASE WHEN frame_i // 120 % 4 = 2 THEN 8 ELSE 0 END - CASE WHEN frame_i % 135 >= 90 THEN 6 ELSE 0 END AS inten, (event_id % 17 - CASE WHEN frame_i // 150 % 4 = 3 THEN 9 ELSE 0 END)::DOUBLE AS hf,
  CASE WHEN event_type IN ('click', 'view') THEN value % 12 * CASE WHEN frame_i // 300 % 3 = 1 THEN 0.2::DOUBLE ELSE 1 END END AS f0_st FROM n),
w AS (SELECT clip_id, i, i * 0.15::DOUBLE AS start_s, i * 0.15::DOUBLE + 0.06::DOUBLE + CASE WHEN i // 8 % 6 = 1 THEN 0.08::DOUBLE ELSE 0 END + i % 3 * 0.005::DOUBLE AS end_s, i % 13 <> 5 AS heard,
  CASE WHEN i % 9 = 8 THEN 'sentence' WHEN i % 3 = 0 THEN 'phrase_tight' ELSE 'phrase_loose' END AS btype, (i * 7 % 10) / 10.0::DOUBLE AS sim FROM (SELECT DISTINCT clip_id, frame_i // 15 AS i FROM n)),
last AS (SELECT clip_id, max(i) AS last_i FROM w GROUP BY 1)"""
_IN = "f.clip_id = {0}.clip_id AND f.frame_i BETWEEN floor(greatest(0, {1}) / 0.01::DOUBLE) AND greatest(1, floor({2} / 0.01::DOUBLE)) - 1"
_ISLANDS = "SELECT clip_id, min(i) AS w0, max(i) AS w1, count(*) AS n{2} FROM (SELECT *, r - row_number() OVER (PARTITION BY clip_id ORDER BY r) AS k FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY i) AS r FROM {0}) WHERE {1}) GROUP BY clip_id, k"
_TIMES = "(SELECT start_s FROM w WHERE w.clip_id = x.clip_id AND w.i = x.w0) AS start_s, (SELECT end_s FROM w WHERE w.clip_id = x.clip_id AND w.i = x.w1) AS end_s"


def _spread_sql(runs: str, before: int, after: int) -> str:
    """Runs widened by words, with their times."""
    return f"SELECT *, {_TIMES} FROM (SELECT * REPLACE (greatest(0, w0 - {before}) AS w0, least(last_i, w1 + {after}) AS w1) FROM {runs} JOIN last USING (clip_id)) x"


def _against_sql(flaw: str, value: str, rows: int, least: int, sign: int, limit: float, least_s: float) -> str:
    t = flaw.lower()
    return f"""{t}_to AS (SELECT *, last_value(end_s) OVER (PARTITION BY clip_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {rows - 1} FOLLOWING) AS upto FROM w),
{t}_v AS (SELECT s.clip_id, s.i, CASE WHEN count(f.frame_i) > {least} THEN {value} END AS v FROM {t}_to s LEFT JOIN f ON {_IN.format("s", "s.start_s", "s.upto")} GROUP BY s.clip_id, s.i),
{t}_o AS (SELECT *, {sign} * (v - median(v) OVER (PARTITION BY clip_id)) AS over, count(v) OVER (PARTITION BY clip_id) AS valid FROM {t}_v),
{t}_r AS ({_ISLANDS.format(f"(SELECT * FROM {t}_o WHERE valid >= 10)", f"coalesce(over, 0) >= {limit}", "")}),
{t} AS (SELECT '{flaw}' AS flaw, clip_id, w0, w1, start_s, end_s, (SELECT max(coalesce(over, 0)) FROM {t}_o o WHERE o.clip_id = s.clip_id AND o.i BETWEEN w0 AND w1) AS d FROM ({_spread_sql(f"{t}_r", 0, rows - 1)}) s WHERE end_s - start_s >= {least_s})"""


def _tails_sql(name: str, tail_s: float, spare: int) -> str:
    return f"""{name} AS (SELECT clip_id, first, w1, min(i) AS w0 FROM (SELECT *, min(i) OVER g AS first, max(i) OVER g AS w1, max_by(end_s, i) OVER g AS last_s, max_by(heard, i) OVER g AS ok FROM sen WINDOW g AS (PARTITION BY clip_id, k))
  WHERE w1 - first >= 4 AND ok AND ((i >= first + {spare} AND last_s - start_s < {tail_s}) OR i = w1) GROUP BY clip_id, first, w1)"""


_SENTENCES = "sen AS (SELECT *, sum(opens) OVER (PARTITION BY clip_id ORDER BY i) AS k FROM (SELECT *, coalesce((lag(btype) OVER (PARTITION BY clip_id ORDER BY i) = 'sentence')::INT, 1) AS opens FROM w))"
_RANGE = "CASE WHEN count(f0_st) >= 11 THEN quantile_cont(f0_st, 0.75) - quantile_cont(f0_st, 0.25) END"


def _found_sql(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT flaw, clip_id, w0::INTEGER AS w0, w1::INTEGER AS w1, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, round(d, 6) + 0.0 AS d FROM {n}" for n in names)


def _clips(spark: SparkSession, sf_dir: str) -> detect.Clips:
    """Events as frames of ten users each, with louder, duller and flatter stretches, and words of 15 frames."""
    w = Window.partitionBy("clip_id").orderBy("ts", "event_id")
    n = table(spark, sf_dir, "events").withColumn("clip_id", F.floor(F.col("user_id") / 10)).withColumn("frame_i", F.row_number().over(w) - 1)
    part = lambda size, of: F.floor(F.col("frame_i") / size) % of
    inten = F.col("value") % 10 + F.when(part(120, 4) == 2, 8).otherwise(0) - F.when(F.col("frame_i") % 135 >= 90, 6).otherwise(0)
    pitch = F.when(F.col("event_type").isin("click", "view"), F.col("value") % 12 * F.when(part(300, 3) == 1, 0.2).otherwise(1.0))
    frames = n.select("clip_id", "frame_i", inten.alias("inten"), (F.col("event_id") % 17 - F.when(part(150, 4) == 3, 9).otherwise(0)).cast("double").alias("hf"), pitch.alias("f0_st"), pitch.isNotNull().alias("voiced"))
    i = F.col("i")
    words = frames.select("clip_id", F.floor(F.col("frame_i") / 15).cast("int").alias("i")).distinct().select(
        "clip_id", "i", (i * F.lit(0.15)).alias("start_s"), (i * F.lit(0.15) + 0.06 + F.when(F.floor(i / 8) % 6 == 1, 0.08).otherwise(0.0) + i % 3 * F.lit(0.005)).alias("end_s"), (i % 13 != 5).alias("heard"),
        F.when(i % 9 == 8, "sentence").when(i % 3 == 0, "phrase_tight").otherwise("phrase_loose").alias("btype"), (i * 7 % 10 / F.lit(10.0)).alias("sim"), F.lit("word").alias("clean"), F.lit("heard").alias("heard_w"),
    )
    none = spark.createDataFrame([], "clip_id long, w string, start_s double, end_s double, i int")
    clips = words.groupBy("clip_id").agg(F.max("end_s").alias("duration_s"))
    return detect.Clips(words, frames, clips, none, none, none)


def _told(found: DataFrame) -> DataFrame:
    return found.select("flaw", F.col("clip_id").cast("long").alias("clip_id"), "w0", "w1", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), (F.round("d", 6) + 0.0).alias("d"))


@query(f"""
WITH {_FRAMES}, {_against_sql("SHOUT", "quantile_cont(inten, 0.8)", 6, 5, 1, 4.0, 0.6)}, {_against_sql("SLUR", "list_avg(list_sort(list(hf), 'DESC')[1:greatest(1, floor(0.3::DOUBLE * count(*)))::INT])", 7, 8, -1, 4.0, 1.0)},
{_SENTENCES}, {_tails_sql("ft", 1.4, 2)},
fl AS (SELECT t.*, {_TIMES.replace("x.", "t.")}, (SELECT start_s FROM w WHERE w.clip_id = t.clip_id AND w.i = t.first) AS first_s FROM ft t),
fv AS (SELECT fl.*, (SELECT CASE WHEN count(*) >= 5 THEN avg(inten) END FROM f WHERE {_IN.format("fl", "fl.start_s", "fl.end_s")}) AS tail, (SELECT CASE WHEN count(*) >= 5 THEN avg(inten) END FROM f WHERE {_IN.format("fl", "fl.first_s", "fl.start_s")}) AS rest FROM fl),
fade AS (SELECT 'FADE' AS flaw, clip_id, w0, w1, start_s, end_s, -1 - (tail - rest) AS d FROM fv WHERE -1 - (tail - rest) >= 3.5)
{_found_sql("shout", "slur", "fade")}""")
def detected_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shouts, slurred stretches and fades."""
    c = _clips(spark, sf_dir)
    th = detect.DEFAULTS
    found = detect.shout(c.words, c.frames, th).unionByName(detect.slur(c.words, c.frames, th)).unionByName(detect.fade(c.words, c.frames, c.norms, th))
    return _told(found)


@query(f"""
WITH {_FRAMES}, {_SENTENCES}, {_tails_sql("ut", 1.0, 1)},
uv AS (SELECT t.clip_id, t.w1, f.frame_i, f.f0_st, f.inten, row_number() OVER (PARTITION BY t.clip_id, t.w1 ORDER BY f.frame_i DESC) AS late FROM ut t JOIN w ON w.clip_id = t.clip_id AND w.i = t.w1 JOIN f ON f0_st IS NOT NULL AND {_IN.format("w", "w.start_s", "w.end_s")}),
ur AS (SELECT clip_id, w1, median(f0_st) FILTER (late <= 5) - first(f0_st ORDER BY inten DESC, frame_i) AS rise FROM uv GROUP BY clip_id, w1 HAVING count(*) >= 6),
uptalk AS (SELECT 'UPTALK' AS flaw, x.clip_id, w0, w1, {_TIMES}, rise + 3.0 AS d FROM ut x JOIN ur USING (clip_id, w1) WHERE rise + 3.0 >= 2.0),
whole AS (SELECT clip_id, {_RANGE} AS whole FROM f GROUP BY 1), mw AS (SELECT clip_id, unnest(range(0, greatest(0, last_i + 1 - 12) + 1, 3)) AS w0 FROM last),
mx AS (SELECT clip_id, w0, w0 + 11 AS w1 FROM mw), ms AS ({_spread_sql("mx", 0, 0)}),
mo AS (SELECT ms.clip_id, ms.w0, ms.w1, {_RANGE} AS own FROM ms JOIN f ON {_IN.format("ms", "ms.start_s", "ms.end_s")} GROUP BY ALL),
mf AS (SELECT DISTINCT clip_id, unnest(range(w0, w1 + 1)) AS i FROM mo JOIN whole USING (clip_id) WHERE whole > 0.5 AND own <= 0.62 * whole),
mr AS ({_ISLANDS.format("(SELECT w.*, mf.i IS NOT NULL AS flat FROM w LEFT JOIN mf USING (clip_id, i))", "flat", "")}), mt AS ({_spread_sql("mr", 0, 0)}),
mono AS (SELECT 'MONOTONE' AS flaw, clip_id, w0, w1, start_s, end_s, coalesce(whole - (SELECT {_RANGE} FROM f WHERE {_IN.format("mt", "mt.start_s", "mt.end_s")}), 0) AS d FROM mt JOIN whole USING (clip_id) WHERE end_s - start_s >= 2.4 AND whole > 0.5)
{_found_sql("uptalk", "mono")}""")
def detected_by_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rising ends and flat stretches."""
    c = _clips(spark, sf_dir)
    return _told(detect.uptalk(c.words, c.frames, c.norms, detect.DEFAULTS).unionByName(detect.monotone(c.words, c.frames, detect.DEFAULTS)))


def _pace_sql(flaw: str, flag: str, sign: int) -> str:
    t = flaw.lower()
    runs = _ISLANDS.format("(SELECT * FROM z WHERE valid >= 10)", flag, ", median(v) AS v")
    return f"{t}_r AS ({runs}), {t} AS (SELECT '{flaw}' AS flaw, clip_id, w0, w1, start_s, end_s, exp({sign} * v) AS d FROM ({_spread_sql(f'{t}_r', 2, 2)}) WHERE end_s - start_s >= 1.2)"


@query(f"""
WITH {_FRAMES}, logs AS (SELECT *, CASE WHEN heard THEN ln(greatest(end_s - start_s, 0.03)) END AS l FROM w), res AS (SELECT *, l - median(l) OVER (PARTITION BY clip_id) AS resid FROM logs),
sm AS (SELECT *, CASE WHEN count(resid) OVER h = 5 THEN avg(resid) OVER h END AS v FROM res WINDOW h AS (PARTITION BY clip_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
md AS (SELECT *, median(v) OVER (PARTITION BY clip_id) AS m FROM sm), sp AS (SELECT *, greatest(0.05, 1.4826 * median(abs(v - m)) OVER (PARTITION BY clip_id)) AS spread, count(v) OVER (PARTITION BY clip_id) AS valid FROM md), z AS (SELECT *, v / spread AS z FROM sp),
{_pace_sql("PACE_FAST", "z <= -2.0", -1)}, {_pace_sql("PACE_SLOW", "z >= 2.0", 1)},
gone AS ({_ISLANDS.format("w", "NOT heard", "")}), cut_at AS (SELECT gone.*, (a.end_s + b.start_s) / 2 AS t FROM gone JOIN last USING (clip_id) JOIN w a ON a.clip_id = gone.clip_id AND a.i = w0 - 1 JOIN w b ON b.clip_id = gone.clip_id AND b.i = w1 + 1 WHERE w0 > 0 AND w1 < last_i),
skip AS (SELECT 'WORD_SKIP' AS flaw, clip_id, w0, w1, t - 0.025 AS start_s, t + 0.025 AS end_s, n AS d FROM cut_at),
swap AS (SELECT 'WORD_SWAP' AS flaw, clip_id, i AS w0, i AS w1, start_s, greatest(end_s, start_s + 0.1) AS end_s, 1 AS d FROM w WHERE heard AND sim < 0.8)
{_found_sql("pace_fast", "pace_slow", "skip", "swap")}""")
def detected_by_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fast and slow stretches, skipped and swapped words."""
    c = _clips(spark, sf_dir)
    th = {**detect.DEFAULTS, "pace_win": 2}
    found = detect.pace(c.words, c.norms, th).unionByName(detect.skipped(c.words, th)).unionByName(detect.swapped(c.words, th))
    return _told(found)
