"""The ``opN_*`` queries over this package's operators, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tempora.llm import bpe, chat, clusters, divergence, knn, licenses, minhash, mixing, quality, spotsigs, token_store, variants, warc
from tempora.llm.shared import table, written


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages go to ARC files, these to WARC files, and the rows are read back from the WARC files."""
    archives = warc.convert(warc.write_arcs(table(spark, sf_dir, "pages")))
    records = warc.resolved(written(warc.read_warcs(archives), "warc-records"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_sha256("ids").alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = spotsigs.against_next(table(spark, sf_dir, "documents"))
    return compared.withColumn("edited_sha256", F.sha2("edited_text", 256)).drop("edited_text")


def op4_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), network)
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


def op5_kd_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = knn.integers(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return knn.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


OP5_SQL = """
WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, n, pow(n::DOUBLE, 0.5) / sum(pow(n::DOUBLE, 0.5)) OVER () * sum(n) OVER () / n AS rate FROM sizes),
probabilities AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k FROM rates)),
below AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM probabilities),
units AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':11'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
copies AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) AS copies
  FROM units d JOIN below b ON d.source IS NOT DISTINCT FROM b.source AND b.below <= d.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::INTEGER AS copy FROM copies
"""


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = token_store.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_chat_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are expanded and written; the digests are of what is read back."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    made = chat.examples(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))
    read = chat.read_back(written(made, "chat-examples"))
    whole = F.expr("array_join(transform(max_by(turns, n_turns), t -> concat(t.role, '\n', t.text, '\n')), '')")
    loss = F.expr("array_join(transform(array_sort(collect_list(struct(example, loss))), e -> e.loss), '')")
    grouped = read.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), whole.alias("turns"), loss.alias("loss"), F.sum("formatted_chars").alias("formatted_chars"))
    return grouped.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


def _op10_sql() -> str:
    safe = "replace({}, chr(92), chr(92) || chr(92))"
    for c in chat.CONTROLS:
        safe = f"replace({safe}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return f"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(k)),
sized AS (SELECT *, length({safe.format("text")}) + CASE role WHEN 'user' THEN {len("".join(chat.USER))} WHEN 'assistant' THEN {len("".join(chat.ASSISTANT))}
    WHEN 'system' THEN {len("".join(chat.SYSTEM))} ELSE {len("".join(chat.OTHER)) + 1} + length(replace({safe.format("role")}, chr(10), chr(92) || chr(10))) END AS size,
  row_number() OVER turns AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM said WINDOW turns AS (PARTITION BY conv_id ORDER BY turn, role, text)),
upto AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM sized)
SELECT conv_id, max(n) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM upto GROUP BY conv_id
"""


def op11_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3, scale=1024, length=64)


def _op11_sql(k: int = 8, rounds: int = 10) -> str:
    """Plain rounds: components in long form, all distances."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""far{r} AS MATERIALIZED (SELECT row_id, cluster, sum((v.x - c.x) * (v.x - c.x)) AS far FROM parts v JOIN c{r} c USING (i) GROUP BY row_id, cluster),
near{r} AS MATERIALIZED (SELECT row_id, cluster, far FROM far{r} QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY far, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT cluster, i, sum(x) AS s, count(*)::HUGEINT AS n FROM parts JOIN near{r} USING (row_id) GROUP BY cluster, i),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, c.i, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n + n) % n)) // n END AS x FROM c{r} c LEFT JOIN m{r} m USING (cluster, i))""")
    return f"""
WITH kept AS (SELECT vec_id, row_number() OVER () AS row_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row_id, unnest(range(64)) AS i, unnest(v)::HUGEINT AS x FROM kept),
firsts AS (SELECT row_id, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v)::INTEGER - 1 AS cluster FROM kept QUALIFY cluster < {k}),
c0 AS MATERIALIZED (SELECT cluster, i, x FROM parts JOIN firsts USING (row_id)),
{", ".join(steps)},
told AS (SELECT cluster, sum(far)::BIGINT AS cluster_inertia FROM near{rounds} GROUP BY cluster),
digests AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, cluster, far::BIGINT AS distance, cluster_inertia, (SELECT sum(cluster_inertia) FROM told)::BIGINT AS inertia, centroid_sha256
FROM near{rounds} JOIN kept USING (row_id) JOIN told USING (cluster) JOIN digests USING (cluster)
"""


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(divergence.measured(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).drop("text"), "measured")
    judged = divergence.verdicts(rows, written(divergence.references(rows), "references"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op12_sql() -> str:
    d = divergence
    left, counts = "text", []
    for _, pattern in d.CLASSES:
        rest = f"regexp_replace({left}, '{pattern.replace("'", "''")}', '', 'g')"
        counts.append(f"length({left}) - length({rest})")
        left = rest
    counts.append(f"length({left})")
    gain = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({1} + {2}) / 2)) ELSE 0 END"
    apart = f"sqrt(greatest(sum(({gain.format('p', 'p', 'q')} + {gain.format('q', 'p', 'q')}) / 2), 0))"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, [{", ".join(counts)}] AS chars FROM docs),
windows AS (SELECT r, i, words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] AS w FROM (SELECT r, words, unnest(range(len(words) - 2)) AS i FROM words WHERE len(words) > 2)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(3) t(k) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
tokens AS (SELECT r, lang, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM docs),
short AS (SELECT r, lang, word, count(*) AS n FROM tokens WHERE length(word) <= {d.LETTERS} GROUP BY ALL),
languages AS (SELECT lang, sum(len(words)) AS n FROM words WHERE lang IS NOT NULL GROUP BY lang HAVING sum(len(words)) >= {d.LEAST_OF_LANGUAGE}),
common AS (SELECT lang, word, sum(short.n) AS times FROM short JOIN languages USING (lang) GROUP BY lang, word, languages.n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY times DESC, word) <= {d.COMMON}),
listed AS (SELECT lang, greatest(any_value(l.n), sum(times)) AS total, greatest(any_value(l.n) - sum(times), 0) AS rest FROM common JOIN languages l USING (lang) GROUP BY lang),
bins AS (SELECT lang, word, times / total AS q FROM common JOIN listed USING (lang) UNION ALL SELECT lang, NULL, rest / total FROM listed),
chars AS (SELECT r, lang, unnest(range({len(d.CLASSES) + 1})) AS k, unnest(chars) AS n FROM words),
char_bins AS (SELECT lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM chars JOIN listed USING (lang) GROUP BY lang, k),
char_apart AS (SELECT r, {apart} AS d FROM (SELECT r, n / sum(n) OVER (PARTITION BY r) AS p, q, sum(n) OVER (PARTITION BY r) AS total FROM chars JOIN char_bins USING (lang, k)) WHERE total >= {d.LEAST_CHARACTERS} GROUP BY r),
held AS (SELECT w.r, b.word, b.q, len(w.words) AS n_words, coalesce(s.n, 0) AS n FROM words w JOIN bins b USING (lang) LEFT JOIN short s ON s.r = w.r AND s.word = b.word WHERE len(w.words) >= {d.LEAST_WORDS}),
filled AS (SELECT r, q, CASE WHEN word IS NULL THEN greatest(n_words - sum(n) OVER (PARTITION BY r), 0) ELSE n END AS n FROM held),
word_apart AS (SELECT r, {apart} AS d FROM (SELECT r, q, n / sum(n) OVER (PARTITION BY r) AS p FROM filled) GROUP BY r),
based AS (SELECT d.r, d.doc_id, len(words)::BIGINT AS n_words, list_sum(list_transform(words, lambda x: length(x)))::BIGINT AS word_chars, (chars[3])::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM docs d JOIN words USING (r) LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM based)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(c.d < {d.CHARACTERS_APART}, true) AND coalesce(w.d < {d.WORDS_APART}, true) AS kept
FROM failed LEFT JOIN char_apart c USING (r) LEFT JOIN word_apart w USING (r)
"""


def op13_deletion_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), least_letters=7, times=2, factor=10, damage=31)


OP13_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS of_byte),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+'), lambda r: translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT *, hex((coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
summed AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda c, b: xor(c >> 8, of_byte[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
hurt AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM hurt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
rests AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n FROM rests a JOIN rests b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM rests a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM rests a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS most, first(other ORDER BY n DESC, other) AS other FROM pairs GROUP BY word),
formed AS MATERIALIZED (SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN other END AS form, CASE WHEN most >= 10 * w.n THEN most END AS form_n FROM words w LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT up.word, up.next, f.form FROM up JOIN formed f ON f.word = up.next)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM up WHERE next IS NULL) USING (word)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_arc_to_warc": op1_arc_to_warc,
    "op2_bpe_chunks": op2_bpe_chunks,
    "op3_spotsigs": op3_spotsigs,
    "op4_quality_cnn": op4_quality_cnn,
    "op5_kd_trees": op5_kd_trees,
    "op6_poisson_mix": op6_poisson_mix,
    "op7_minhash": op7_minhash,
    "op8_token_files": op8_token_files,
    "op9_license_rules": op9_license_rules,
    "op10_chat_prefixes": op10_chat_prefixes,
    "op11_dual_tree_lloyd": op11_dual_tree_lloyd,
    "op12_divergence": op12_divergence,
    "op13_deletion_keys": op13_deletion_keys,
}

ORACLE_SQL: dict[str, str] = {
    "op5_kd_trees": OP5_SQL,
    "op6_poisson_mix": OP6_SQL,
    "op9_license_rules": licenses.oracle_sql(),
    "op10_chat_prefixes": _op10_sql(),
    "op11_dual_tree_lloyd": _op11_sql(),
    "op12_divergence": _op12_sql(),
    "op13_deletion_keys": OP13_SQL,
}
