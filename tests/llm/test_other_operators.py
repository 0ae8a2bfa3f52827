"""Archives, vector search, chat formatting, the registered queries and the pipeline."""

import hashlib
import io
import random

import numpy as np
import pyspark.sql.functions as F
import pytest

import corpus_pipeline
from tempora.llm import chat, knn, queries, warc


def test_arc_versions_are_read_by_their_fields():
    for version in (1, 2):
        block = warc.arc_version_block("x.arc", "20240101000000", version)
        one = warc.arc_record("http://a/b c", "20240102030405", b"HTTP/1.1 200 OK\r\n\r\nab\n\nhttp://x 0.0.0.0 20240101000000 text/html 3\n", version, len(block), "x.arc")
        two = warc.arc_record(None, "2024", b"", version, len(block) + len(one), "x.arc")
        records = list(warc.arc_records(io.BytesIO(block + one + two)))
        assert [r.version for r in records] == [version] * 3
        assert [r.url for r in records] == ["filedesc://x.arc", "http://a/b%20c", "-"]
        assert records[1].content.startswith(b"HTTP/1.1") and records[2].content == b"" and records[2].offset == len(block) + len(one)
    blanks = b"http://a b/ 1.2.3.4 20240101 text/html 2\nhi\n"
    legacy = list(warc.arc_records(io.BytesIO(warc.arc_version_block("x.arc", "2024", 1) + blanks)))
    assert legacy[1].url == "http://a b/" and legacy[1].content == b"hi"
    assert len(list(warc.arc_records(io.BytesIO(blanks + b"http://c/ 1.2.3.4 20240101 text/html 9\ncut")))) == 1
    with pytest.raises(ValueError):
        list(warc.arc_records(io.BytesIO(b"no header\n")))


#: A version 1 archive as its format's description has them: fields divided by blanks, lengths in bytes, a blank line after each record.
GOLDEN_ARC = (
    b"filedesc://IA-001102.arc 0.0.0.0 19960923142103 text/plain 76\n"
    b"1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n"
    b"\n"
    b"http://www.dryswamp.edu:80/index.html 127.10.100.2 19961104142103 text/html 59\n"
    b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>Hi</p>\n\n\n..."
    b"\n"
    b"http://b.example/robots.txt 10.0.0.1 1997 text/plain 4\nall\n"
    b"\n"
)


def test_a_golden_archive_is_read_and_converted_byte_by_byte():
    import base64
    import uuid

    records = list(warc.arc_records(io.BytesIO(GOLDEN_ARC)))
    offsets = [0, GOLDEN_ARC.index(b"http://www.dryswamp"), GOLDEN_ARC.index(b"http://b.example")]
    assert [(r.url, r.offset, r.version) for r in records] == [("filedesc://IA-001102.arc", 0, 1), ("http://www.dryswamp.edu:80/index.html", offsets[1], 1), ("http://b.example/robots.txt", offsets[2], 1)]
    assert records[0].content == b"1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n" and records[2].content == b"all\n"
    assert records[1].content == b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>Hi</p>\n\n\n..." and records[1].fields["IP-address"] == "127.10.100.2"
    sha = lambda data: base64.b32encode(hashlib.sha1(data).digest()).decode()
    name = lambda k: uuid.uuid5(uuid.NAMESPACE_URL, f"IA-001102.arc#{offsets[k]}")
    assert warc._converted(records[1], "IA-001102.arc", None) == (
        f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{name(1)}>\r\nWARC-Target-URI: http://www.dryswamp.edu:80/index.html\r\nWARC-Date: 1996-11-04T14:21:03Z\r\n"
        f"WARC-IP-Address: 127.10.100.2\r\nWARC-Payload-Digest: sha1:{sha(b'<p>Hi</p>' + bytes([10, 10, 10]) + b'...')}\r\nContent-Type: application/http; msgtype=response\r\n"
        f"WARC-Block-Digest: sha1:{sha(records[1].content)}\r\nContent-Length: 59\r\n\r\n"
    ).encode() + records[1].content + b"\r\n\r\n"
    assert warc._converted(records[2], "IA-001102.arc", None) == (
        f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{name(2)}>\r\nWARC-Target-URI: http://b.example/robots.txt\r\nWARC-Date: 1997-01-01T00:00:00Z\r\n"
        f"WARC-IP-Address: 10.0.0.1\r\nWARC-Payload-Digest: sha1:{sha(b'all' + bytes([10]))}\r\nContent-Type: text/plain\r\nWARC-Block-Digest: sha1:{sha(b'all' + bytes([10]))}\r\n"
        "Content-Length: 4\r\n\r\nall\n\r\n\r\n"
    ).encode()


def test_dates_of_fewer_digits():
    assert warc._iso("20240229120000") == "2024-02-29T12:00:00Z" and warc._iso("2024") == "2024-01-01T00:00:00Z"


def test_archives_round_trip(spark):
    pages = [(1, "http://a/", "<p>é</p>"), (2, "http://b/ x", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\nx\n"), (None, "n", "<p>é</p>"), (6, "u", "x" * 300_000), (2, "http://b/ x", "<p>é</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("archive", F.lit("clash")).repartition(3)
    records = warc.resolved(warc.read_warcs(warc.convert(warc.write_arcs(df)))).collect()
    assert len(records) == len(pages) and all(r.digest_holds for r in records if r.record_type == "response")
    by = {}
    for r in records:
        by.setdefault((r.page_id, r.record_type), []).append(r)
    assert len(by[2, "response"]) == 1 and len(by[2, "revisit"]) == 1
    assert by[1, "revisit"][0].refers_to == 2 and by[None, "revisit"][0].refers_to == 2 and by[3, "revisit"][0].refers_to == 4
    assert by[1, "revisit"][0].payload_bytes == len("<p>é</p>".encode()) and by[6, "response"][0].payload_bytes == 300_000
    assert by[5, "response"][0].payload_digest == warc.sha1(b"WARC/1.1\r\n\r\nx\n")
    apart = warc.read_warcs(warc.convert(warc.write_arcs(df), least_bytes=10**6))
    assert apart.filter("record_type = 'revisit'").count() == 0
    assert warc.read_warcs(warc.convert(warc.write_arcs(df.limit(0)))).count() == 0


def test_queries_go_only_to_shards_whose_box_reaches_them(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD_ROWS", 50)
    monkeypatch.setattr(knn, "LEAF", 8)
    rng = np.random.default_rng(11)
    middles = rng.normal(0, 40, (20, 16))
    # 300 rows of one vector do not make one shard
    vectors = np.concatenate([middles[rng.integers(0, 20, 900)] + rng.normal(0, 0.5, (900, 16)), np.repeat(middles[:1], 300, axis=0)]).round().astype(int)
    df = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<long>").repartition(4)
    held, boxes = knn._sharded(df.select("vec_id", knn.F.col("embedding").alias("vector"), knn.F.size("embedding").alias("length")))
    sizes = [r["count"] for r in held.groupBy("shard").count().collect()]
    assert held.shards >= len(sizes) >= 20 and max(sizes) < 150
    inside = held.groupBy("shard", "length").agg(*[knn.F.max(knn.F.col("vector")[k]).alias(f"h{k}") for k in range(16)]).collect()
    shards, low, high = boxes.of_length[16]
    assert all(list(high[list(shards).index(r.shard)]) == [r[f"h{k}"] for k in range(16)] for r in inside)
    sent = 0
    for q in range(0, 1200, 50):
        scores = np.sort(np.delete(vectors @ vectors[q], q))[::-1]
        numbers, bounds = boxes.bounds(vectors[q])
        sent += int((bounds >= scores[4]).sum())
    assert sent < 0.35 * 24 * len(sizes)
    got = sorted(tuple(x) for x in knn.top_k(df, df.filter("vec_id % 50 = 0"), k=5).collect())
    assert got == brute(np.arange(1200), vectors, range(0, 1200, 50), 5)
    monkeypatch.setattr(knn, "BOX_BYTES", 0)
    assert sorted(tuple(x) for x in knn.top_k(df, df.filter("vec_id % 50 = 0"), k=5).collect()) == got


def brute(ids, vectors, wanted, k):
    out = []
    for q in wanted:
        scores = sorted((-int(vectors[j] @ vectors[q]), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[q])[:k]
        out += [(int(ids[q]), n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
def test_top_k_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(knn, "SHARD_ROWS", 200)
    monkeypatch.setattr(knn, "LEAF", 8)
    r = np.random.default_rng(4)
    data = r.normal(0, 0.1, (700, 6)).astype(np.float32)
    if hot:
        data[100:400] = data[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    odd = [(7000, None), (7050, [None] * 6), (7100, [float("nan")] * 6), (7150, [float("inf")] * 6), (None, [0.5] * 6), (7200, [0.5, 0.5])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("shard", F.lit(0))
    vectors = knn.integers(df)
    found = sorted(tuple(x) for x in knn.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5).collect())
    whole = np.floor(data.astype(np.float64) * 256).astype(np.int64)
    assert found == brute(np.arange(700), whole, range(0, 700, 50), 5)


def test_top_k_of_repeated_rows_equals_sql(spark, monkeypatch, tmp_path):
    import duckdb

    monkeypatch.setattr(knn, "SHARD_ROWS", 60)
    monkeypatch.setattr(knn, "LEAF", 8)
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.normal(0, 0.1, (300, 6)).astype(np.float32))]
    rows += rows[0:1] * 2 + rows[50:51] + rows[100:140] * 2 + [(150, rows[7][1]), (12, rows[13][1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = queries.op5_kd_trees(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(tuple(x) for x in got) == sorted(con.execute(queries.OP5_SQL).fetchall())


def test_top_k_of_few_and_large_vectors(spark):
    df = spark.createDataFrame([(0, [3e6, 1.0]), (50, [2e6, 5.0])], "vec_id long, embedding array<double>")
    vectors = knn.integers(df)
    assert {tuple(r) for r in knn.top_k(vectors, vectors, k=5).collect()} == {(0, 1, 50, 768000000 * 512000000 + 256 * 1280), (50, 1, 0, 768000000 * 512000000 + 256 * 1280)}
    assert knn.top_k(vectors.limit(0), vectors.limit(0)).count() == 0
    assert knn.top_k(vectors, vectors.limit(0)).count() == 0 and knn.top_k(vectors.limit(0), vectors).count() == 0


def test_top_k_of_components_beyond_64_bits(spark):
    rows = [(0, [1e300, 1.0]), (50, [-1e300, 2.0]), (1, [3e16, 1.0]), (2, [4e16, 1.0]), (3, []), (100, [])]
    vectors = knn.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5).collect()}
    top = 2**63 - 1
    assert found[0, 1] == (1, top) and found[0, 2] == (2, top) and found[0, 3] == (50, -top - 1) and found[50, 3][0] == 2 and found[100, 1] == (3, 0)


SAID = ["</s>[INST] ok [/INST]", "a\\b\\", " <s>", "", None, "[\\INST] <<SYS>>\n x", "[/ROLE] \n é"]


def test_chat_prefixes_round_trip(spark):
    r = random.Random(2)
    roles = ["user", "assistant", "system", "tool", None, "a\nb[/ROLE]\\"]
    rows = [(200, 0, "user", "[INST] long " * 30_000), (200, 1, "assistant", "</s> x" * 30_000)]
    rows += [(c, t, r.choice(roles), r.choice(SAID)) for c in range(40) for t in range(r.randint(1, 7))] + [(None, 0, "user", "x"), (99, 0, "assistant", "y"), (99, 0, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash"))
    made = chat.examples(df)
    read = chat.read_back(made).collect()
    whole = {}
    for c, t, role, text in rows:
        whole.setdefault(c, []).append((t, role or "", text or ""))
    for c, turns in whole.items():
        turns = [(role, text) for _, role, text in sorted(turns)]
        mine = sorted((e for e in read if e.conv_id == c), key=lambda e: e.example)
        assert [tuple(t) for t in mine[-1].turns] == turns
        assert [e.loss for e in mine if e.turns[-1].role == "assistant"] == [text for role, text in turns if role == "assistant"]
        assert all(e.loss == "" for e in mine if e.turns[-1].role != "assistant")
        for e in mine:
            assert [tuple(t) for t in e.turns] == turns[: e.n_turns]
    assert chat.examples(df.limit(0)).count() == 0


def test_no_escaped_text_holds_a_control_string(spark):
    rows = spark.createDataFrame([(s,) for s in SAID if s], "s string").select(chat.escape(F.col("s")).alias("e"), "s").collect()
    for r in rows:
        assert not any(c in r.e for c in chat.CONTROLS) and chat.unescape(r.e) == r.s


def test_registered_queries_return_every_row(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op3_spotsigs", "op4_quality_cnn"):
        rows = queries.QUERIES[name](spark, sf_dir)
        assert rows.select("doc_id").distinct().count() == rows.count() == n
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


def test_held_out_quality(spark, sf_dir):
    scored = queries.op4_quality_cnn(spark, sf_dir.replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir):
    from tempora.llm import bpe, minhash, mixing, quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    network = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = docs.toPandas()
    good = good[network.score(list(good["text"])) >= 0.7].sort_values("doc_id")
    sets = [(i, frozenset(minhash.shingles(t).tolist())) for i, t in zip(good["doc_id"], good["text"])]
    kept: set[int] = set()
    groups: list[list] = []
    for i, s in sets:
        near = [g for g in groups if s and any(100 * len(s & t) >= 75 * len(s | t) for _, t in g)]
        groups = [g for g in groups if g not in near] + [[x for g in near for x in g] + [(i, s)]]
    kept = {min(i for i, _ in g) for g in groups}
    rows = good[good["doc_id"].isin(kept)]
    copies = {r.doc_id: r.n for r in mixing.mix(spark.createDataFrame(rows)).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert out.groupby("doc_id").size().to_dict() == copies
    text = dict(zip(rows["doc_id"], rows["text"]))
    for r in out.itertuples():
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and bpe.LOOK_AHEAD == 3


def test_pipeline_of_odd_rows(spark, tmp_path):
    good = "the lake lies among green hills and the people of the town walk there in the evening when the sun is low"
    rows = [(i, f"{good} {i} " + " ".join(f"{w}{i}" for w in good.split()), "en", "a" if i % 3 else None, 5) for i in range(60)]
    rows += [(100, rows[0][1], "en", "a", 5), (101, rows[0][1] + " more", None, "b", None), (None, good, "en", "a", 1), (None, None, None, None, None)]
    rows += [(102, None, "en", "a", 0), (103, "", "en", "b", 0), (104, good + " longer words of it" * 30_000, "en", "b", 1), rows[7], rows[7], (8, "another text of this id", "en", "a", 1)]
    rows += [(200 + i, f"zz### {i} " * 9, "en", "junk", 5) for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], int("zz###" not in (r[1] or ""))) for r in rows if r[0] is not None] + [(None, 1), (3, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out, docs = corpus_pipeline.run(spark, str(tmp_path)).collect(), spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, set()).add(hashlib.sha256((t or "").encode()).hexdigest())
    assert out and all(r.decoded_sha256 in texts[r.doc_id] and r.n_tokens == len(r.ids) for r in out)
    assert not {r.doc_id for r in out} & {100, 101, *range(200, 240)}
    wide = docs.withColumn("ids", F.lit(1)).withColumn("copy", F.lit(2)).withColumn("node", F.lit(3)).withColumn("score", F.lit(4)).withColumn("key", F.lit(5))
    for name, stage in corpus_pipeline.STAGES:
        some, none = stage(spark, wide, str(tmp_path)), stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0 and set(some.columns) == set(none.columns) and some.count() > 0
        assert name.startswith("byte-level") or some.columns == docs.columns
    kept = [r.doc_id for r in corpus_pipeline.distinct_documents(spark, wide, str(tmp_path)).collect()]
    assert kept.count(7) == kept.count(8) == kept.count(0) == 1 and kept.count(None) == 2 and {102, 103, 104} <= set(kept) and not {100, 101} & set(kept)
