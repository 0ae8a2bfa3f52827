"""A corpus pipeline: quality filter, near-dedup, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that ``run``
writes as Parquet and reads again as the next stage's input.  All stages take
tables without rows (and return such), count null texts as empty, read texts of
any length whole, and drop columns that documents do not have.
"""

from __future__ import annotations

import public_tokenizers
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tempora.llm import bpe, minhash, mixing, quality
from tempora.llm.shared import discard, table, written
from tempora.runtime import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose quality score is 0.7 or more.

    Null and empty texts are scored as one zero byte; equal texts are kept or
    dropped together; repeated rows stay repeated; rows without an id are
    scored, but not learnt from.
    """
    ship(spark)
    network = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, network, to="quality_score").filter("quality_score >= 0.7").select(*COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Texts without words are like nothing and all stay, and so do rows without
    an id; of rows that share an id the one with the smallest text stays, so of
    repeated rows one.
    """
    ship(spark)
    return minhash.deduplicated(docs).select(*COLUMNS)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that a source weighs the square root of its rows.

    A null source is a source of its own; rows that share an id, and rows
    without one, get equally many copies.
    """
    return mixing.mix(docs).select(*COLUMNS)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of their decoded bytes.

    Null and empty texts have no ids; every row is returned, repeated ones too.
    """
    ship(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, pattern), path, pattern)
    return encoded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        bpe.ids_sha256("ids").alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", good_documents),
    ("MinHash near-dedup", distinct_documents),
    ("mixing sources to target weights", mixed_documents),
    ("byte-level BPE encoding", encoded_documents),
]

#: A fitted network and a tokenizer have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(docs)  # a stage before this one; the documents themselves stay
        docs = made
    return docs
