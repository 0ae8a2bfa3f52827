"""Registered queries against their SQL on the small tables."""

import math

import duckdb
import pytest

from tempora import queries, queries_more, queries_plans  # noqa: F401  (register their queries)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(plain(x) for x in r) for r in got.select(*[f"`{c}`" for c in columns]).collect()), key=key) == sorted((tuple(plain(x) for x in r) for r in want.fetchall()), key=key)


def test_queries_without_sql_are_held_against_plain_tables_below():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"nw_alignment", "dtw_distance"}


def test_every_turn_is_aligned_over_all_words(spark, tmp_path):
    import random

    from tempora.operators.align import GAP, SIMILAR, similarity

    r = random.Random(3)
    words = ["a", "the", "then", "thing", "things", "form", "from", "people", "queue"]
    turns = [(c, t, " ".join(r.choice(words) for _ in range(n))) for c, sizes in ((1, [3, 70, 75, 4]), (2, [5, 0, 6]), (3, [2])) for t, n in enumerate(sizes)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def pairs(a, b):
        """By the plain table, cell by cell."""
        total = [[GAP * (i + j) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        point = lambda x, y: 1.0 if x == y else 2 * s - 1 if (s := similarity(x, y)) > SIMILAR else -1.0
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                total[i][j] = max(total[i - 1][j - 1] + point(x, y), total[i - 1][j] + GAP, total[i][j - 1] + GAP)
        i, j, n = len(a), len(b), 0
        near = lambda x, y: abs(x - y) <= 1e-8 + 1e-5 * abs(y)
        while i or j:
            if i and j and near(total[i - 1][j - 1] + point(a[i - 1], b[j - 1]), total[i][j]):
                i, j, n = i - 1, j - 1, n + 1
            elif i and near(total[i - 1][j] + GAP, total[i][j]):
                i -= 1
            else:
                j -= 1
        return n

    said = {(c, t): s.split() for c, t, s in turns}
    want = {(f"{c}:{t}", len(a), len(said[c, t + 1]), pairs(a, said[c, t + 1])) for (c, t), a in said.items() if (c, t + 1) in said}
    assert {tuple(x) for x in queries.nw_alignment(spark, str(tmp_path)).select("clip_id", "ref", "hyp", "pairs").collect()} == want


def test_every_embedding_is_warped(spark, tmp_path):
    import numpy as np

    from tempora.operators import align

    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=64).astype(np.float32)], int(r.integers(0, 4))) for i in range(130)] + [(200, [1.0] * 64, 7)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    series = {}
    for i, v, label in rows:
        series.setdefault((i // 50, label), []).extend(np.array(v).reshape(8, 8))
    want = {}
    for block, label in series:
        there = sorted(x for b, x in series if b == block)
        after = there[(there.index(label) + 1) % len(there)]
        path, cost = align.warp(np.array(series[block, label]), np.array(series[block, after]))
        want[f"{block}:{label}"] = (round(cost, 9), len(path))
    assert {x.clip_id: (round(x.path_cost, 9), x.steps) for x in queries.dtw_distance(spark, str(tmp_path)).collect()} == want
    assert sum(len(x) for x in series.values()) == 8 * len(rows)
