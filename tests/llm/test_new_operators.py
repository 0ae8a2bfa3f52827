"""Clustering by two trees, divergence from language references, spelling variants."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyspark.sql.functions as F
import pytest

from tempora.llm import clusters, divergence, queries, variants

VECTORS = "vec_id long, embedding array<float>, vector string"


def plain_lloyd(rows, k, rounds, seed, scale, length):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for n in set(of):
            held = [v for (_, v), m in zip(kept, of) if m == n]
            centroids[n] = [sum(x) // len(held) for x in zip(*held)]
    found = [(i, n, d) for i, v in kept for d, n in [nearest(v)]]
    total, all_ = Counter(), sum(d for _, _, d in found)
    for _, n, d in found:
        total[n] += d
    return [(i, n, d, total[n], all_, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, n, d in found]


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_clusters_are_those_of_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(clusters, "SHARD_ROWS", 60)
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 1, (6, 8))
    spread = [(i, [float(np.float32(x)) for x in middles[i % 6] + rng.normal(0, 0.02, 8)]) for i in range(200)]
    same = [(300 + i, [0.5] * 8) for i in range(70)] + [(7, [0.25] * 8)] * 3 + [(None, [0.125] * 8)]
    odd = [(900, None), (901, [1.0] * 7), (902, [float("nan")] + [0.0] * 7), (903, [None] + [0.0] * 7), (904, [float("inf")] + [0.0] * 7)]
    rows = spread + same + odd
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], VECTORS).repartition(3)
    for k, rounds in ((5, 4), (1, 1), (400, 1)):
        got = clusters.clustered(df, k=k, rounds=rounds, seed=3, scale=64, length=8)
        assert by_text(got.collect()) == by_text(plain_lloyd(rows, k, rounds, 3, 64, 8))
    none = clusters.clustered(df.limit(0), k=5, length=8)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_large_components_stay_exact(spark):
    rows = [(i, [float(np.float32(s * 2.0**40)), float(i)]) for i, s in enumerate([1, -1, 1.5, 1, -1.25])]
    df = spark.createDataFrame([(i, v, "") for i, v in rows], VECTORS)
    want = [(*r[:2], *(min(x, clusters.LARGEST) for x in r[2:5]), r[5]) for r in plain_lloyd(rows, 2, 3, 3, 1024, 2)]
    want = [(i, n, d, min(sum(x[2] for x in want if x[1] == n), clusters.LARGEST), min(sum(x[2] for x in want), clusters.LARGEST), s) for i, n, d, _, _, s in want]
    assert by_text(clusters.clustered(df, k=2, rounds=3, length=2).collect()) == by_text(want)


def test_cover_tree_covers_and_separates_and_bounds_prune():
    rng = np.random.default_rng(2)
    middles = rng.integers(-4000, 4000, (8, 16))
    points = (middles[rng.integers(0, 8, 1500)] + rng.integers(-20, 20, (1500, 16))).astype(np.int64)
    points[:400] = points[0]
    tree = clusters.CoverTree(points)
    held = points[tree.order]
    for (start, end), (first, last), centre, radius in zip(tree.span, tree.children, tree.centre, tree.radius):
        far = np.sqrt(((held[start:end] - points[centre]) ** 2).sum(axis=1))
        assert far.max() <= radius + 1e-9
        if last > first:
            assert tree.span[first][0] == start and tree.span[last - 1][1] == end
            within = 2.0 ** (np.ceil(np.log2(radius)) - 1)
            assert max(tree.radius[first:last]) <= within
            of_children = points[tree.centre[first:last]].astype(float)
            apart = np.sqrt(((of_children[:, None] - of_children[None]) ** 2).sum(axis=2))
            assert (apart[~np.eye(len(of_children), dtype=bool)] > within).all()
    shard = clusters.Shard(clusters.Shard.packed(held, clusters._moved(tree)))
    balls = clusters.Balls([list(map(int, c)) for c in middles])
    numbers = shard.nearest(balls)
    assert (numbers == ((held[:, None] - middles[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert shard.compared == 0  # whole nodes were assigned


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def prose(r, n):
    common = "the of and to a in is that it for was on with be".split()
    return " ".join(r.choice(common) if r.random() < 0.5 else "".join(r.choice("abcdefghijklm") for _ in range(r.randint(6, 11))) for _ in range(n)).capitalize() + "."


def test_divergence_counts_and_verdicts(spark):
    r = random.Random(4)
    clean = [prose(r, r.randint(60, 400)) for _ in range(60)]
    signs = " ".join(w + "***" for w in clean[0].split() * 2)
    loud = " ".join(clean[1].split()).upper()
    salad = " ".join("".join(r.choice("abcdefghijklm") for _ in range(r.randint(6, 11))) for _ in range(300))
    odd = [None, "", " \t\n", "a b c a b c a b c", "x" * 5000, "aa bb cc " * 40, "l one\nl one\n \n \nl two\nl one", "é　è\x0b語\x1c1#|", clean[3], clean[3], prose(r, 30_000)]
    texts = [*clean, *odd, signs, loud, salad, salad, clean[5], clean[6]]
    langs = ["en"] * (len(texts) - 3) + ["xx", None, "en"]
    df = spark.createDataFrame([(i, t, g, "clash", i) for i, (t, g) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string, kept string, c0 long").repartition(3)
    rows = {x.doc_id: x for x in divergence.judged(df).collect()}
    assert len(rows) == len(texts) and set(rows[0].asDict()) == {"doc_id", "text", "lang", "c0", *divergence.OUTPUTS}
    for i, t in enumerate(texts):
        x = rows[i]
        assert x.text == t and x.c0 == i
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == plain_base(t), repr(t)[:80]
    assert all(rows[i].kept for i in range(len(clean))) and rows[70].kept
    assert [rows[i].kept for i in range(71, 77)] == [False, False, False, True, True, True]  # the others' languages have no reference
    assert divergence.judged(df.limit(0)).count() == 0


def test_distance_is_the_root_of_the_divergence(spark):
    def plain(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q)]
        return math.sqrt(sum((a * math.log2(a / c) if a else 0) + (b * math.log2(b / c) if b else 0) for a, b, c in zip(p, q, m)) / 2)

    cases = [([1, 2, 0, 5], [0.25, 0.25, 0.5, 0.0]), ([0, 3, 0, 0], [0.0, 1.0, 0.0, 0.0]), ([4, 0, 0, 0], [0.0, 0.5, 0.5, 0.0])]
    df = spark.createDataFrame([(i, c, s) for i, (c, s) in enumerate(cases)] + [(9, [0, 0], [0.5, 0.5])], "i int, counts array<long>, shares array<double>")
    got = {r.i: r.d for r in df.select("i", divergence.distance(F.col("counts"), F.col("shares")).alias("d")).collect()}
    for i, (c, s) in enumerate(cases):
        assert got[i] == pytest.approx(plain([x / sum(c) for x in c], s), abs=1e-9)
    assert got[2] == pytest.approx(1.0) and got[9] is None


def test_no_python_on_the_native_path(spark):
    df = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    for made in (divergence.judged(df), divergence.references(divergence.measured(df))):
        assert "Python" not in (plan := made._jdf.queryExecution().toString()) and "Arrow" not in plan and "Pandas" not in plan


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs, least, times, factor, damage):
    counts = Counter()
    for i, t in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least and n >= times}
    near = {w: [o for o in counts if one_apart(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= factor * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def test_variants_equal_all_pairs(spark):
    r = random.Random(8)
    letters = "abÀéß÷"
    base = ["".join(r.choice(letters) for _ in range(r.randint(4, 8))) for _ in range(40)]
    texts = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = base[min(int(r.expovariate(0.3)), 39)]
            if r.random() < 0.15:
                k = r.randrange(len(w))
                w = w[:k] + r.choice(["", r.choice(letters), w[k] + r.choice(letters)]) + w[k + 1 :]
            words.append(w.upper() if r.random() < 0.1 else w)
        texts.append(" ".join(words))
    long = "ab" * 3000
    texts += [None, "", "123 - Ā", long, long + "a", long + "b", long, long + "a", long + "b", "aaaaaaaa", "aaaaaaa aaaaaaaaa", "aaaaaaaaa", texts[0], texts[0]]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (5, texts[5])]
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, word string").repartition(4)
    for damage, factor in ((0, 10), (5, 3)):
        got = variants.spelling_variants(df, least_letters=4, times=2, factor=factor, damage=damage).select("word", "form", "root", "n", "n_near", "form_n").collect()
        assert len(got) == len({tuple(x) for x in got})
        assert {tuple(x) for x in got} == plain_variants(docs, 4, 2, factor, damage)
    assert variants.spelling_variants(df.limit(0)).count() == 0


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    from tempora.llm.variants import _links_of

    import pandas as pd

    rows = [(1, -1, 10, "abcdefg", 5), (1, 2, 11, "abXcdefg", 2), (1, 2, 12, "qqqqqqqq", 9), (1, 4, 13, "abcdXefg", 3), (2, 0, 11, "abXcdefg", 2), (2, 0, 14, "zbXcdefg", 4)]
    told = _links_of(pd.DataFrame(rows, columns=["key", "at", "id", "word", "n"]))
    assert sorted(map(tuple, told.to_numpy())) == [(10, 2, 3, "abcdXefg"), (11, 1, 4, "zbXcdefg"), (11, 1, 5, "abcdefg"), (13, 1, 5, "abcdefg"), (14, 1, 2, "abXcdefg")]


def test_roots_follow_forms_to_the_last(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(13)] + [("x", "w05")]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w13" for w, _ in chain}


@pytest.mark.parametrize("name", ["op11_dual_tree_lloyd", "op12_divergence", "op13_deletion_keys"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(columns) == sorted(got.columns)
    assert by_text(got.select(*columns).collect()) == by_text(want.fetchall())
