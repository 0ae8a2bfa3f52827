"""Byte-level BPE: overlapping chunk encoding and decoding.

A long text is cut into overlapping chunks that are pre-tokenised in parallel.
The split pattern looks only forward from a token's start, so once two
neighbouring chunks agree on one boundary they agree on all that follow.  Each
pair of neighbours is stitched at the first boundary that both have inside
their overlap and that stands after a sign other than white space: the pattern
splits white space by what follows it, so a piece that ended with white space
would be split otherwise than the whole text.  A stitch counts only if all
stitches before it do, as only then the chunk on its left is known to have the
boundaries of the whole text (with a pattern that counts, such as one of digits
by threes, two chunks can agree on a wrong phase).  From the first pair without
such a boundary on (one token or run of white space longer than the overlap)
the text stays one piece, so none is split where its tokens are not.  The
pieces between stitches are then encoded in parallel and their ids joined in
order.  Decoding joins the raw bytes of the ids.

Defined cases: null text counts as empty and has no ids; a table without rows
gives none; very long texts are pieces of many tasks, and of equal ones one is
encoded; every repeated row is returned; columns named like an output column
are replaced, and all others kept whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

#: A boundary counts only if so many characters follow it in its chunk: the longest contraction.
LOOK_AHEAD = 3
_loaded: dict[tuple[int, str], tiktoken.Encoding] = {}


class Vocabulary:
    """The bytes of a rank file (about 1 MB), read on the driver and broadcast once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = spark.sparkContext.broadcast(f.read())
        self.pattern = pattern

    def encoding(self) -> tiktoken.Encoding:
        key = (hash(self.ranks.value), self.pattern)
        if key not in _loaded:
            lines = (line.split() for line in self.ranks.value.splitlines() if line)
            ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
            _loaded[key] = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return _loaded[key]


def boundaries(text: str, pattern: str, last: bool) -> list[int]:
    """Ends of the tokens of ``text`` that hold whatever may follow it; all ends if it is ``last``."""
    limit = len(text) if last else len(text) - LOOK_AHEAD
    return [m.end() for m in regex.finditer(pattern, text) if m.end() <= limit]


def _ids_of(texts: list[str | None], encoding: tiktoken.Encoding) -> pa.ListArray:
    ids = [encoding.encode_ordinary(t or "") for t in texts]
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _encoded(df: DataFrame, vocabulary: Vocabulary, text: str, ids: str) -> DataFrame:
    """``df`` without its text and with the ids of it."""
    kept = [f for f in df.schema.fields if f.name != text]
    schema = StructType([*kept, StructField(ids, ArrayType(IntegerType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary.encoding()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                columns = [rows.column(f.name) for f in kept]
                columns.append(_ids_of(rows.column(text).to_pylist(), encoding))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(encode, schema)


def _long_ids(texts: DataFrame, vocabulary: Vocabulary, chunk: int, overlap: int) -> DataFrame:
    """``(key, ids)`` of the long ``texts(key, text)``, each encoded in pieces over many tasks; of equal texts each piece once."""
    pattern = vocabulary.pattern
    chunks = (
        texts.withColumn("n", F.length("text"))
        .withColumn("k", F.explode(F.expr(f"sequence(0L, (n - 1) div {chunk})")))
        .select("key", "k", "n", F.expr(f"substring(text, cast(k * {chunk} + 1 as int), {chunk + overlap})").alias("text"))
        .groupBy("key", "k", "n")
        .agg(F.first("text").alias("text"))
    )
    schema = StructType([
        StructField("key", StringType()), StructField("k", LongType()),
        StructField("head", ArrayType(LongType())), StructField("tail", ArrayType(LongType())),
    ])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, k, n, text in zip(batch["key"], batch["k"], batch["n"], batch["text"]):
                start = k * chunk
                ends = [start, *(start + e for e in boundaries(text, pattern, start + len(text) >= n))]
                # the chunk before knows what stands before the first sign of this one
                after_sign = [e for e in ends if e > start and not text[e - start - 1].isspace()]
                rows.append((key, k, [e for e in ends if e < start + overlap], [e for e in after_sign if e >= start + chunk]))
            yield pd.DataFrame(rows, columns=schema.names)

    in_order = Window.partitionBy("key").orderBy("k")
    stitch = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(in_order))))
    stitches = chunks.mapInPandas(cut, schema).select("key", "k", stitch.alias("at"))
    anchored = stitches.withColumn("anchored", F.min(F.col("at").isNotNull()).over(in_order))
    cuts = anchored.filter("anchored").groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("cuts"))
    pieces = (
        texts.join(cuts, "key")
        .select("key", "text", "cuts", F.posexplode("cuts").alias("piece", "at"))
        .withColumn("to", F.coalesce(F.expr("try_element_at(cuts, piece + 2)"), F.length("text").cast("long")))
        .select("key", "piece", F.expr("substring(text, cast(at + 1 as int), cast(`to` - at as int))").alias("text"))
        .groupBy("key", "piece")
        .agg(F.first("text").alias("text"))
    )
    parts = _encoded(pieces, vocabulary, "text", "ids")
    return parts.groupBy("key").agg(F.expr("flatten(transform(array_sort(collect_list(struct(piece, ids))), x -> x.ids))").alias("ids"))


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", chunk: int = 16384, overlap: int = 2048
) -> DataFrame:
    """``docs`` without its text column and with the array ``ids`` of every whole text.

    ``chunk`` and ``overlap`` count characters.  Texts of up to ``chunk`` are
    one piece and are encoded where they are read, without a shuffle.
    """
    if not LOOK_AHEAD < overlap <= chunk:
        raise ValueError("overlap must exceed the look-ahead and not the chunk")
    vocabulary = Vocabulary(docs.sparkSession, ranks_path, pattern)
    docs = docs.drop(ids) if ids != text else docs
    # inner names no column of docs can clash with
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    short = _encoded(rows.filter(F.length("text") <= chunk), vocabulary, "text", "ids")
    long = rows.filter(F.length("text") > chunk).withColumn("key", F.sha2("text", 256))
    done = _long_ids(long.select("key", "text"), vocabulary, chunk, overlap)
    long = long.drop("text").join(done, "key").drop("key").select(short.columns)
    both = short.union(long)
    return both.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("ids").alias(ids))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", to: str = "bytes") -> DataFrame:
    """``df`` with the raw bytes of its ids; null ids give null."""
    vocabulary = Vocabulary(df.sparkSession, ranks_path, pattern)

    @F.pandas_udf(BinaryType())
    def joined(ids: pd.Series) -> pd.Series:
        encoding = vocabulary.encoding()
        return pd.Series([None if x is None else encoding.decode_bytes(x.tolist()) for x in ids], dtype=object)

    return df.withColumn(to, joined(F.col(ids)))


@F.pandas_udf(StringType())
def ids_sha256(ids: pd.Series) -> pd.Series:
    """Hex digest of ids as little-endian unsigned 32-bit integers."""
    import hashlib

    return pd.Series([None if x is None else hashlib.sha256(np.asarray(x).astype("<u4").tobytes()).hexdigest() for x in ids], dtype=object)
