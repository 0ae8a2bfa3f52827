"""Operators on texts: BPE, quality, mixing, fingerprints, near copies, token files, licences."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyspark.sql.functions as F
import pytest
import tiktoken
from tokenizers import Tokenizer

from tempora.llm import bpe, graph, licenses, minhash, mixing, quality, spotsigs, token_store
from tempora.llm.shared import old_file

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, **more):
    rows = [(i, t, "en", more.get("source", "s"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    r = random.Random(3)
    signs = "ab Zé'sre\n\t  12,.!語\xa0\x1c"
    made = ["".join(r.choice(signs) for _ in range(r.randint(0, 400))) for _ in range(30)]
    return [None, "", " ", "a", "x" * 700, " " * 300, *made, "it's we've " * 60, made[0], made[0]]


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_chunks_equal_the_library_and_round_trip(spark, tik):
    texts = odd_texts()
    docs = documents(spark, texts).withColumn("ids", F.lit("clash")).withColumn("c0", F.lit(1))
    rows = bpe.decode(bpe.encode(docs, RANKS, PATTERN, chunk=40, overlap=12), RANKS, PATTERN).collect()
    assert len(rows) == len(texts) and set(rows[0].asDict()) == {"doc_id", "lang", "source", "n_chars", "ids", "c0", "bytes"}
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.ids == tik.encode_ordinary(text), repr(text)
        assert bytes(r.bytes) == text.encode()


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 6), (23, 23), (64, 12)])
def test_bpe_of_much_white_space_equals_the_library(spark, tik, chunk, overlap):
    r = random.Random(chunk)
    made = ["".join(r.choice(signs) for _ in range(r.randint(0, 6 * chunk))) for signs in ("a \n", "a1'.s \n\t\xa0", " \n\x1cé!", "ab      \n\n") for _ in range(700)]
    rows = bpe.encode(documents(spark, made), RANKS, PATTERN, chunk=chunk, overlap=overlap).select("doc_id", "ids").collect()
    assert len(rows) == len(made) and all(row.ids == tik.encode_ordinary(made[row.doc_id]) for row in rows)


def test_bpe_of_breaks_around_the_default_chunk(spark, tik):
    word = "some words of a long text "
    texts = [(word * 700)[: 16384 + at] + run + word * 700 for at in range(-6, 5) for run in ("\n\n", "  \n", " ", "\t\t\t")]
    texts += [" " * 40000, "x" * 40000, ("y " * 9000) + " " * 5000 + "z" * 5000]
    rows = bpe.encode(documents(spark, texts), RANKS, PATTERN).select("doc_id", "ids").collect()
    assert len(rows) == len(texts) and all(row.ids == tik.encode_ordinary(texts[row.doc_id]) for row in rows)


def test_bpe_by_a_pattern_that_counts_equals_the_library(spark):
    """Two chunks of a long run of digits agree on a wrong phase where three divides the chunk."""
    pattern = r"\p{N}{1,3}| ?\p{L}+|\s+|[^\s\p{L}\p{N}]+"
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(6)
    texts = ["x" * k + "".join(r.choice("0123456789") for _ in range(n)) + " and words of a text " * m for k in range(4) for n in (20, 100, 400) for m in (0, 5, 20)]
    texts += [" and words of a text " * 6 + t for t in texts[:12]]
    for chunk, overlap in ((30, 12), (33, 33), (31, 9)):
        rows = bpe.encode(documents(spark, texts), RANKS, pattern, chunk=chunk, overlap=overlap).select("doc_id", "ids").collect()
        assert len(rows) == len(texts) and all(row.ids == library.encode_ordinary(texts[row.doc_id]) for row in rows)


def test_bpe_of_an_empty_table(spark):
    assert bpe.encode(documents(spark, []), RANKS, PATTERN).count() == 0


def test_boundaries_hold_whatever_follows():
    text = "we'll see  it's\n\n  here 12ab"
    whole = {m for m in bpe.boundaries(text, PATTERN, True)}
    for cut in range(1, len(text)):
        assert set(bpe.boundaries(text[:cut], PATTERN, False)) <= whole


def test_quality_learns_and_scores_whole_texts(spark):
    r = random.Random(1)
    words = ["tion", "the", "ore", "and", "in", "est", "ou"]
    good = [" ".join(r.choice(words) for _ in range(r.randint(5, 80))) for _ in range(150)]
    bad = [g + " " + "zz### " * 3 for g in good[:75]]
    texts, labels = good + bad, [1] * len(good) + [0] * len(bad)
    net = quality.fit(texts, labels)
    far = "the ore " * 2000
    scores = net.score([far, far + "zz### zz### ", None, "", "in"])
    assert scores[0] > 0.7 > scores[1] and np.isfinite(scores).all() and scores[2] == scores[3]
    docs = documents(spark, [far, None, ""]).withColumn("score", F.lit("clash"))
    rows = quality.score(docs, net).orderBy("doc_id").collect()
    assert abs(rows[0].score - scores[0]) < 1e-6 and len(rows) == 3
    chunked, where = net.pooled(quality._bytes(far + "zz### zz### "))
    assert where.max() > quality.CHUNK and len(chunked) == quality.FILTERS


def plain_score(net, text):
    """The network by its definition: each filter at each window of bytes, the largest response, one logistic layer."""
    data = list((text or "").encode()) or [0]
    padded = data + [0] * (quality.WIDTH - 1)
    hidden = []
    for f in range(quality.FILTERS):
        top = max(sum(float(net.filters[k, padded[at + k], f]) for k in range(quality.WIDTH)) for at in range(len(data)))
        hidden.append(max(top + float(net.bias[f]), 0.0))
    total = net.base + float(np.dot([*hidden, np.log1p(len(data)) / 10], net.out))
    return 1 / (1 + np.exp(-min(max(total, -40), 40)))


def test_quality_scores_equal_a_plain_convolution():
    r = random.Random(8)
    words = ["tion", "the", "Zé", "語", "est", "#"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(40)]
    net = quality.fit(texts, [int("the" in t) for t in texts])
    asked = [*texts, None, "", "a", " ".join(r.choice(words) for _ in range(2500))]
    scores = net.score(asked)
    assert max(abs(s - plain_score(net, t)) for s, t in zip(scores, asked)) < 1e-4
    for t in asked[-6:]:
        best, where = net.pooled(quality._bytes(t))
        window = np.concatenate([quality._bytes(t), np.zeros(quality.WIDTH - 1, np.uint8)])
        again = [sum(float(net.filters[k, window[w + k], f]) for k in range(quality.WIDTH)) for f, w in enumerate(where)]
        assert np.allclose(best, again, atol=1e-4)


def test_quality_sample_is_whole_texts_within_its_bounds(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda texts, labels: seen.update(texts=texts, labels=labels))
    docs = documents(spark, ["x" * (10 * i) for i in range(60)]).union(documents(spark, ["z", "z", None])).withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    quality.train(docs, labels, rows=30, total_bytes=3000)
    assert 5 < len(seen["texts"]) <= 30 and sum(map(len, seen["texts"])) <= 3000 and all(len(t) % 10 == 0 for t in seen["texts"])
    quality.train(docs, labels)
    assert len(seen["texts"]) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(60))
    quality.train(docs, labels.limit(0))
    assert seen["texts"] == []
    assert quality.score(docs.limit(0), quality.Network(np.zeros((6, 256, 16), np.float32), np.zeros(16, np.float32), np.zeros(17), 0.0)).count() == 0


def test_quality_of_one_class_and_held_out_rows(spark):
    docs = documents(spark, [f"text {i}" for i in range(40)])
    labels = spark.createDataFrame([(i, 1, None) for i in range(40)] + [(None, 0, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    net = quality.train(docs, labels)
    assert (net.score(["a", None]) > 0.7).all()
    flags = {r.doc_id: r.h for r in docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()}
    assert flags == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(40)}


def test_mixing_meets_the_weights(spark):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 else "cold" if i % 2 else None, 2) for i in range(6000)] + [(None, None, None, "cold", None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("copy", F.lit("clash"))
    mixed = mixing.mix(docs, {"hot": 0.5, "cold": 0.4, None: 0.1}, total=9000)
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    for source, share in {"hot": 0.5, "cold": 0.4, None: 0.1}.items():
        assert abs(got[source] - 9000 * share) < 5 * (9000 * share) ** 0.5
    assert mixed.columns == [*docs.columns, "copy_"] and mixed.collect() == mixing.mix(docs, {"hot": 0.5, "cold": 0.4, None: 0.1}, total=9000).collect()
    assert mixing.mix(docs, {"absent": 1.0}).count() == 0 and mixing.mix(documents(spark, [])).count() == 0


def test_poisson_distributions_are_whole(spark):
    import math

    rows = mixing.distributions(spark.createDataFrame([("a", 30.0), (None, 0.4), ("b", 2500.0)], "source string, rate double")).collect()
    assert len(rows) == 3
    for rate, row in ((rate, r) for r in rows for source, rate in {"a": 30.0, None: 0.4, "b": 2500.0}.items() if r.source == source):
        exact = list(itertools.accumulate(math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) for k in range(len(row.distribution))))
        assert max(abs(a - b) for a, b in zip(row.distribution, exact)) < 1e-9 and abs(row.distribution[-1] - 1) < 1e-9


def test_mixing_of_a_rare_source_and_repeated_rows(spark, monkeypatch):
    rows = [(i, "t", "en", "common", 1) for i in range(3000)] + [(9000 + i % 5, "r", "en", "rare", 1) for i in range(10)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix(docs, {"common": 0.25, "rare": 0.75}, total=8000).groupBy("doc_id", "source", "copy").count().collect()
    copies = {}
    for r in mixed:
        copies.setdefault((r.source, r.doc_id), []).append(r.copy)
        assert r["count"] == (2 if r.source == "rare" else 1)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values())
    rare = [len(c) for (s, _), c in copies.items() if s == "rare"]
    assert len(rare) == 5 and all(abs(n - 600) < 6 * 600**0.5 for n in rare)
    monkeypatch.setattr(mixing, "BROADCAST_STEPS", 10)
    again = mixing.mix(docs, {"common": 0.25, "rare": 0.75}, total=8000).groupBy("doc_id", "source", "copy").count().collect()
    assert sorted(again) == sorted(mixed)


def word_shingles(text):
    """The rule itself, without hashes."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts, percent=75):
    sets = [word_shingles(t) for t in texts]
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(texts))]


def near_texts(seed=5):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = [r.choice(words) for _ in range(60)]
    texts = [None, "", " \t", "one two", "one two", "ONE two", "a b c d e", "a b c d e f"]
    for _ in range(60):  # near copies of one text, many below the threshold among themselves
        copy = list(base)
        for _ in range(r.randint(0, 3)):
            copy[r.randrange(len(copy))] = r.choice(words)
        texts.append(" ".join(copy))
    for _ in range(25):  # chains: each text a change of the one before
        base = list(base)
        base[r.randrange(len(base))] = "new"
        texts.append(" ".join(base))
    texts += [" ".join(r.choice(words) for _ in range(r.randint(3, 90))) for _ in range(30)]
    texts += ["Ä ÉcOLE\x1cx\u2003y b c\x0bd e\xa0f", "ä école\x1cx\u2003y b c\x0bd e\xa0f", "long " + " ".join(r.choice(words) for _ in range(30_000))]
    return texts + texts[-5:] + texts[-40:-39] * 9


@pytest.mark.parametrize(("wide", "block"), [(32, 2048), (2, 8), (10**6, 8)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, wide, block):
    monkeypatch.setattr(minhash, "WIDE", wide)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 40 * block)
    monkeypatch.setattr(minhash, "HEAVY", 40)
    texts = near_texts()
    sets, component = brute_components(texts)
    rows = minhash.near_duplicates(documents(spark, texts).withColumn("node", F.lit(0))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), component[r.doc_id], component[r.doc_id] == r.doc_id)


@pytest.mark.parametrize(("percent", "wide"), [(75, 32), (75, 2), (50, 4), (100, 32)])
def test_exact_near_duplicates_equal_brute_force(spark, monkeypatch, percent, wide):
    monkeypatch.setattr(minhash, "WIDE", wide)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    texts = near_texts(12)
    sets, component = brute_components(texts, percent)
    rows = minhash.near_duplicates(documents(spark, texts), percent=percent, exact=True).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == {(i, len(s), c) for i, (s, c) in enumerate(zip(sets, component))}
    assert minhash.near_duplicates(documents(spark, []), exact=True).count() == 0


def test_recall_of_pairs_just_above_the_threshold(spark):
    """Pairs of similarity 0.75 to 0.80: the exact way has all, the bands have all but a few in a hundred thousand."""
    r = random.Random(21)
    texts = []
    while len(texts) < 1200:
        words = [f"v{r.randrange(10**9)}" for _ in range(r.randint(40, 200))]
        changed = list(words)
        for at in r.sample(range(len(words)), max(1, len(words) // 45)):
            changed[at] = f"v{r.randrange(10**9)}"
        a, b = word_shingles(" ".join(words)), word_shingles(" ".join(changed))
        if 75 * len(a | b) <= 100 * len(a & b) <= 80 * len(a | b):
            texts += [" ".join(words), " ".join(changed)]
    docs = documents(spark, texts)
    for exact, least in ((True, 600), (False, 599)):
        found = minhash.near_duplicates(docs, exact=exact).collect()
        assert sum(row.component_id == row.doc_id - 1 for row in found if row.doc_id % 2) >= least
        assert all(row.component_id == row.doc_id for row in found if row.doc_id % 2 == 0)


def test_deduplicated_keeps_one_row_of_a_group(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (2, "a b c d e f", 2), (None, "a b c d e f", 3), (4, None, 4), (5, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    kept = minhash.deduplicated(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 4), (False, 5), (True, 0)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_sketch_fills_every_coordinate_and_tells_similarity():
    small = minhash.sketch([np.array([7], np.uint64), np.arange(500, dtype=np.uint64)])
    assert (small != np.iinfo(np.uint64).max).all()
    r = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        a = r.integers(0, 2**63, 400, dtype=np.uint64)
        one, two = a[:350], a[50:]
        s = minhash.sketch([one, two])
        errors.append((s[0] == s[1]).mean() - 300 / 400)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 100), (100, 200), (300, 300), (None, 7), (8, None)]
    labels = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert labels == {**{i: 0 for i in range(31)}, 100: 100, 200: 100, 300: 300}


def test_spotsigs_of_neighbours(spark):
    texts = [f"the lake of {w} and the hills in {w} were {w}s for a {w} of note" for w in ("red", "blue", "green", "dark", "light")]
    texts += [None, "", "x", texts[0], "ONLY CONTENT WORDS STAND HERE WITHOUT OTHERS AMONG THEM EVER"]
    docs = documents(spark, texts).withColumn("range", F.lit(1))
    rows = {r.doc_id: r for r in spotsigs.against_next(docs, rows_per_range=3).collect()}
    assert len(rows) == len(texts)
    for i in range(len(texts)):
        text, following = texts[i] or "", texts[i - 1 if i else len(texts) - 1] or ""
        changed = spotsigs.edited(text, following)
        assert rows[i].n_chars == len(text) and rows[i].edited_text == changed
        assert rows[i].fingerprint == spotsigs.as_string(spotsigs.signatures(text))
        assert rows[i].near_next == spotsigs.jaccard(spotsigs.signatures(text), spotsigs.signatures(following))
    assert rows[0].fingerprint == rows[8].fingerprint and rows[5].fingerprint == ""
    assert list(spotsigs.from_string(rows[0].fingerprint)) == list(spotsigs.signatures(texts[0]))
    shared = spark.createDataFrame([(7, t) for t in "aabc"] + [(None, "d"), (9, None), (9, "x" * 200_000)], "doc_id long, text string")
    assert [r.doc_id for r in spotsigs.against_next(shared, rows_per_range=2).orderBy("doc_id").collect()] == [None, 7, 7, 7, 7, 9, 9]
    assert spotsigs.against_next(docs.limit(0)).count() == 0 and spotsigs.against_next(docs.limit(1)).first().near_next == 1.0


def plain_spots(text, common):
    """The signature rule by itself: an anchor and the next two words that are not common."""
    words = re.findall(r"\w+", (text or "").lower())
    spots, since = set(), 0
    for k, w in enumerate(words):
        since = 0 if w in common else since + 1
        if w in common or since > 8:
            chain = [v for v in words[k + 1 :] if v not in common][:2]
            if len(chain) == 2:
                spots.add(" ".join([w, *chain]))
    return spots or set(words)


def test_signatures_follow_their_rule():
    import xxhash

    r = random.Random(2)
    words = ["the", "of", "and", "der", "lake", "hill", "Tree", "stone", "river", "cloud", "Ähre"]
    texts = ["", "x", "the", "the lake", "the lake hill", "The LAKE, hill; of stone"] + [" ".join(r.choice(words[(k % 4) :]) for _ in range(r.randint(1, 60))) for k in range(80)]
    for t in texts:
        assert list(spotsigs.signatures(t)) == sorted({xxhash.xxh32_intdigest(s) for s in plain_spots(t, set(spotsigs.COMMON))}), t


def test_spotsigs_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "WIDE", 6)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    texts = near_texts(9)
    texts = [None if t is None else t.replace("w1", "the ").replace("w2", "of ") for t in texts]
    spots = [frozenset(spotsigs.signatures(t).tolist()) for t in texts]
    for percent in (75, 40):
        first = {s: min(i for i in range(len(texts)) if spots[i] == s) for s in spots}
        label = {i: i for i in first.values()}
        pairs = [(a, b) for (s, a), (t, b) in itertools.combinations(first.items(), 2) if s and t and 100 * len(s & t) >= percent * len(s | t)]
        for _ in texts:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        got = {(r.doc_id, r.class_id, r.component_id) for r in spotsigs.near_duplicates(documents(spark, texts), percent=percent).collect()}
        assert got == {(i, first[s], label[first[s]]) for i, s in enumerate(spots)} and len(pairs) > 20
    assert spotsigs.near_duplicates(documents(spark, [])).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    texts = odd_texts() + ["<|endoftext|> x<|endoftext|>", "　a\xa0 b"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = documents(spark, texts).union(spark.createDataFrame([(None, "no id", "en", "s", 5)], DOCS)).repartition(3).withColumn("ids", F.lit("clash")).withColumn("file", F.lit(1))
    manifest = token_store.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), folder=str(tmp_path / "t"), frame_ids=200)
    rows = token_store.read_tokens(manifest).orderBy("start").collect()
    ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for t in ["no id", *texts]]
    assert [r.doc_id for r in rows] == [None, *range(len(texts))]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == ids
    assert [r.start for r in rows] == [0, *np.cumsum([len(x) for x in ids])[:-1]]
    some = token_store.read_documents(manifest, spark.createDataFrame([(4,), (9,), (9,), (10**9,), (None,)], "doc_id long")).collect()
    assert {(r.doc_id, r.start) for r in some} == {(r.doc_id, r.start) for r in rows if r.doc_id in (4, 9)}
    assert token_store.read_tokens(token_store.write_tokens(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_a_broken_frame_is_told(spark, tmp_path):
    import zstandard

    manifest = token_store.write_tokens(documents(spark, ["some text here"]), public_tokenizers.path("byte_bpe_50k.json"), folder=str(tmp_path / "t"))
    path = manifest.first().path
    with open(path, "rb") as f:
        data = bytearray(f.read())
    assert np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(data)), "<u2").tolist()[-1] == 0
    with old_file(path) as f:
        reader = token_store.Reader(f, 2)
        reader.sums = reader.sums + 1
        with pytest.raises(ValueError, match="checksum"):
            reader.frame(0)


def test_licences_by_sentences(spark):
    s = licenses.SENTENCES
    mit = f"{s['mit-grant']}:\n\n{s['mit-notice']}.\n\n{s['mit-as-is']}.  {s['mit-liability']}."
    wrapped = "# " + s["bsd-grant"].replace(" ", "\n# ", 3).replace("# ", "") + ":\n1. " + s["bsd-source"] + ".\n2. " + s["bsd-binary"] + "."
    texts = [None, "", "plain words", mit, wrapped, "x.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "SPDX-License-Identifier: GPL-2.0-only",
             "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", s["bsd-grant"] + ":", "Plain words of a licence.\n" * 20_000 + mit + "\nmore words " * 20_000, mit]
    docs = documents(spark, texts).withColumn("licences", F.lit("clash"))
    got = {r.doc_id: r.licences for r in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == ["", "", "", "MIT", "BSD-2-Clause", "Apache-2.0,MIT", "GPL-2.0", "CC-BY-NC-4.0", "", "MIT", "MIT"]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_published_licence_files(spark):
    import textwrap

    s, copyright = licenses.SENTENCES, "Copyright (c) 2020 Jane Doe"
    more = {
        "Zlib": f"{copyright}\n\n{s['zlib-as-is']}. {s['zlib-liability']}.\n\n{s['zlib-grant']}:\n\n1. The origin of this software must not be misrepresented.",
        "0BSD": f"{copyright}\n\n{s['0bsd-grant']}.\n\n{s['isc-as-is']}.", "BSL-1.0": f"Boost Software License - Version 1.0\n\n{s['bsl-grant']}:", "EPL-2.0": f"{s['epl-2']}/\n",
        "MPL-2.0": f"{s['mpl-head']}. 2.0. {s['mpl-copy']}.", "LGPL-3.0-or-later": f"This library is free software: {s['lgpl-or-later-3']}.", "LGPL-2.1-or-later": f"This library is free software; {s['lgpl-or-later-21']}.",
    }
    wrapped = [textwrap.fill(t, 60) if "\n\n" not in t else "\n\n".join(textwrap.fill(p, 60) for p in t.split("\n\n")) for t in more.values()]
    got = {r.doc_id: r.licences for r in licenses.scan(documents(spark, [*more.values(), *wrapped])).collect()}
    assert [got[i] for i in range(2 * len(more))] == [*more] * 2
    wrapped = lambda *parts: "\n\n".join(textwrap.fill(p, 72) for p in parts) + "\n"
    mit = wrapped("MIT License", copyright, s["mit-grant"] + ":", s["mit-notice"] + ".", f"{s['mit-as-is']}. {s['mit-liability']}.")
    isc = wrapped("ISC License", copyright, s["isc-grant"] + ".", s["isc-as-is"] + ".")
    bsd = [copyright + "\nAll rights reserved.\n\n", s["bsd-grant"] + ":", "1. " + s["bsd-source"] + ".", "2. " + s["bsd-binary"] + "."]
    bsd_2, bsd_3 = (bsd[0] + wrapped("BSD License", *bsd[1:], *more, s["bsd-as-is"] + ".") for more in ([], ["3. " + s["bsd-names"] + "."]))
    apache = wrapped("Copyright 2020 Jane Doe", f"{s['apache-head']}; {s['apache-grant']}. {s['apache-copy']}") + "\n    http://www.apache.org/licenses/LICENSE-2.0\n\n" + wrapped(f"{s['apache-as-is']}. {s['apache-see']}.")
    commented = "".join(f"# {line}\n" for line in apache.splitlines())
    texts = [mit, isc, bsd_2, bsd_3, apache, commented, mit.replace("\n", "\r\n"), mit.replace("\n\n", "\n"), mit + "\nLicensed under CC0 1.0\nthe rest"]
    rows = sorted(licenses.scan(documents(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert [r.licences for r in rows] == ["MIT", "ISC", "BSD-2-Clause,all-rights-reserved", "BSD-3-Clause,all-rights-reserved", "Apache-2.0", "Apache-2.0", "MIT", "MIT", "MIT,CC0-1.0"]
    assert rows[0].sentence_ids == rows[6].sentence_ids == rows[7].sentence_ids == "mit-grant,mit-notice,mit-as-is,mit-liability"


def test_every_licence_sentence_is_found_however_its_lines_break(spark):
    """Broken at every blank, with several blanks, and with signs at the breaks; by the query and by its SQL."""
    import duckdb

    sentences = {i: s + "." for i, s in licenses.SENTENCES.items()}
    breaks = ["\n", "  ", "\r\n * ", "\n\n# "]
    rows = [(k, i, s.replace(" ", b)) for k, (b, (i, s)) in enumerate(itertools.product(breaks, sentences.items()))]
    rows += [(len(rows) + k, i, "A heading\n" + s.replace(" ", "\n", 3) + "\nlast line") for k, (i, s) in enumerate(sentences.items())]
    df = spark.createDataFrame([(k, s) for k, _, s in rows], "doc_id long, text string")
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in licenses.scan(df).collect()}
    assert [(k, i) for k, i, _ in rows if got[k][0] != i] == []
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert {r[0]: (r[1], r[2]) for r in con.execute(licenses.oracle_sql()).fetchall()} == got


def test_every_licence_sentence_is_one_sentence_with_a_hint():
    import re

    assert len({licenses.normalised(s) for s in licenses.SENTENCES.values()}) == len(licenses.SENTENCES)
    for s in licenses.SENTENCES.values():
        assert re.search(licenses.HINT, s) and re.search(licenses.HINT, s.replace(" ", "\n")) and not re.search(licenses.AFTER_STOP, s)
    for _, rule in licenses.RULES:
        for name in re.split(r"[ /]", rule):
            assert name.strip("()") in licenses.SENTENCES


def test_digest_of_ids(spark):
    row = spark.sql("select array(1, 258) as ids").select(bpe.ids_sha256("ids").alias("d")).first()
    assert row.d == hashlib.sha256(bytes([1, 0, 0, 0, 2, 1, 0, 0])).hexdigest()
