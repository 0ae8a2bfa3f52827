"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document's set is its distinct shingles.  Its sketch has 128 coordinates that
are filled in rounds: in round i every element is thrown into a hashed bin with
a value from [i, i + 1), the smallest value of a bin stays, and rounds end once
all bins are filled.  After 128 rounds each further round fills one fixed bin,
so every coordinate is filled by round 256 at the latest.  32 bands of 4
coordinates make candidates: two sets of similarity 0.75 share none with
probability (1 - 0.75 ** 4) ** 32, about 5e-6.  Where none may be lost,
``exact`` takes each set's rarest shingles as keys in place of bands, so many
that two sets at the threshold always share one (it counts all shingles of all
documents, so it moves about twice the bytes of the texts).

Equal sets are one class from the start.  Within a bucket the classes are
compared with its smallest member only and confirmed links are drawn together.
Then whatever in a bucket is not of its largest component is compared with all
members of other components: pair by pair in narrow buckets, in blocks through
an index of shingles in wide ones.  So no pair of different components that
share a bucket goes untested, while pairs within a component are left out.
Links are confirmed on full sets.

Hot keys: a class that holds more than one row in HEAVY is heavy; there are
fewer than HEAVY of these, so they are broadcast and their rows not shuffled.

Defined cases: null text counts as empty; a text without words has the empty
set and is linked with nothing; fewer words than a shingle make one shingle of
all words; rows without an id stay alone and have no component; rows that
share an id are one document, so what is linked with one of their texts is
linked with all; repeated rows are returned as often; a very long text is one
set like any other, and tasks are bounded by shingles as well as by rows; a
table without rows gives none; columns with clashing names do no harm, as only
id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tempora.llm.graph import components, joined
from tempora.llm.shared import discard, written

COORDINATES, BANDS = 128, 32
ROWS = COORDINATES // BANDS
#: Members from which a bucket is wide, and about how many of them one task holds against as many others.
WIDE, BLOCK = 32, 512
#: Shingles of a wide bucket's members that one task holds at most, besides its last member's.
BLOCK_SHINGLES = 4_000_000
#: A class with more than one in so many rows is heavy.
HEAVY = 2000
#: Shingles that are sketched together.
TOGETHER = 250_000

_U = np.uint64
_rng = np.random.default_rng(20240229)
_WORD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_ROUND = _rng.integers(1, 2**63, 2 * COORDINATES, dtype=np.uint64) * _U(2) + _U(1)
_BAND = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * _U(2) + _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    x = x * _U(0xFF51AFD7ED558CCD)
    return x ^ (x >> _U(32))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a text.

    Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased.
    """
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), seed=words)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = len(h) - words + 1
    total = h[:n] * _WORD[0]
    for k in range(1, words):
        total += h[k : k + n] * _WORD[k]
    return np.unique(_mix(total))


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of COORDINATES values, one for each non-empty set."""
    t = COORDINATES
    values = np.full(len(sets) * t, np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    elements = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * t):
        if not len(elements):
            break
        h = _mix(elements * _ROUND[i] + _U(i))
        bins = (h >> _U(57)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(values, owner * t + bins, (_U(i) << _U(48)) | (h & _U(0xFFFFFFFFFFFF)))
        open_ = (values.reshape(len(sets), t) == np.iinfo(np.uint64).max).any(axis=1)
        more = open_[owner]
        if not more.all():
            elements, owner = elements[more], owner[more]
    return values.reshape(len(sets), t)


def bands(values: np.ndarray) -> np.ndarray:
    """BANDS keys for each sketch; a key also tells its band."""
    grouped = values.reshape(len(values), BANDS, ROWS)
    return _mix((_mix(grouped) * _BAND[None]).sum(axis=2, dtype=np.uint64)).view(np.int64)


def sketched(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, digest, bands)`` of every row; an empty set has null bands."""
    id_field = docs.select(F.col(doc_id).alias("doc_id")).schema[0]
    schema = StructType([id_field, StructField("n_shingles", LongType()), StructField("digest", BinaryType()), StructField("bands", ArrayType(LongType()))])

    def parts(sets: list[np.ndarray]) -> list:
        filled = [i for i, s in enumerate(sets) if len(s)]
        keys = bands(sketch([sets[i] for i in filled]))
        rows: list = [None] * len(sets)
        for i, k in zip(filled, keys):
            rows[i] = k
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(1), batch.column(0)
            start, sets, size = 0, [], 0
            for i in range(batch.num_rows):
                sets.append(shingles(texts[i].as_py(), words))
                size += len(sets[-1])
                if size >= TOGETHER or i == batch.num_rows - 1:
                    digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(start, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(parts(sets), pa.list_(pa.int64()))],
                        names=schema.names,
                    )
                    start, sets, size = i + 1, [], 0

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``(node, set)`` of the rows whose id is among ``nodes``."""
    schema = StructType([nodes.schema["node"], StructField("digest", BinaryType()), StructField("set", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                sets = [shingles(t, words) for t in rows.column(1).to_pylist()]
                digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), digests, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=schema.names)

    rows = docs.select(F.col("doc_id").alias("node"), "text").join(nodes, "node", "left_semi")
    sets = rows.mapInArrow(run, schema).groupBy("node", "digest").agg(F.first("set").alias("set"))
    return sets.select("node", "set")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among ``pairs(a, b)``: 100 * intersection >= percent * union of the full sets."""
    a, b = sets.select(F.col("node").alias("a"), F.col("set").alias("of_a")), sets.select(F.col("node").alias("b"), F.col("set").alias("of_b"))
    near = pairs.join(a, "a").join(b, "b").filter(100 * F.least(F.size("of_a"), F.size("of_b")) >= percent * F.greatest(F.size("of_a"), F.size("of_b")))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return near.filter(100 * both >= percent * (F.size("of_a") + F.size("of_b") - both)).select("a", "b").distinct()


def _mixed(entries: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of buckets with their labels, and ``(key, main, n, size, outside, outside_size)`` of buckets with several labels."""
    member = entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    member = written(member.select("key", "node", "label", "size"), "members")
    sizes = member.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "label", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    outside = [(F.col("n") - F.col("main.n")).alias("outside"), (F.col("size") - F.col("main.size")).alias("outside_size")]
    mixed = mixed.select("key", F.col("main.label").alias("main"), "n", "size", *outside)
    return member, written(mixed.filter("outside > 0"), "mixed")


def _narrow_pairs(member: DataFrame, mixed: DataFrame) -> DataFrame:
    """``(a, b)`` of different labels in buckets of less than WIDE members: at most WIDE pairs for a member."""
    held = member.join(mixed.filter(F.col("n") < WIDE), "key").select("key", "node", "label", "main")
    rest = held.filter("label <> main").select("key", F.col("node").alias("x"), F.col("label").alias("x_label"))
    # of two members outside the largest component the smaller one asks
    pairs = rest.join(held, "key").filter("x_label <> label and (label = main or x < node)")
    return pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def _wide_links(member: DataFrame, mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: one link of each member outside a wide bucket's largest component to each other component it is linked with.

    Both sides come in blocks with their sets, and a task counts what the sets
    share through an index of their shingles, so no pair is formed.
    """

    def tasks(rows: str, shingles: str) -> Column:
        return F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES))

    wide = mixed.filter(F.col("n") >= WIDE).select("key", "main", tasks("n", "size").alias("blocks"), tasks("outside", "outside_size").alias("asking"))
    held = member.join(wide, "key").join(sets, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    every = {n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).alias(n) for n, c in (("block", "blocks"), ("part", "asking"))}
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("asking")).alias("part")
    rest = held.filter("label <> main").select(F.col("key").alias("own_key"), part, F.col("node").alias("x"), F.col("label").alias("x_label"), F.col("set").alias("own"), every["block"])
    rest = rest.toDF("own_key", "own_part", "x", "x_label", "own", "own_block")
    here = held.select("key", "block", "node", "label", "set", every["part"])
    node = member.schema["node"]
    schema = StructType([StructField("a", node.dataType), StructField("b", node.dataType)])

    def linked(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asking) and len(there):
            sizes = there["set"].map(len).to_numpy()
            owner = np.repeat(np.arange(len(there)), sizes)
            words = np.concatenate(there["set"].to_list())
            order = np.argsort(words, kind="stable")
            words, owner = words[order], owner[order]
            label, nodes = there["label"].to_numpy(), there["node"].to_numpy()
            for x, of_x, own in zip(asking["x"], asking["x_label"], asking["own"]):
                starts, ends = np.searchsorted(words, own), np.searchsorted(words, own, "right")
                both = np.bincount(np.concatenate([owner[s:e] for s, e in zip(starts, ends)]), minlength=len(there))
                near = np.flatnonzero((100 * both >= percent * (sizes + len(own) - both)) & (label != of_x))
                for y in near[np.unique(label[near], return_index=True)[1]]:
                    out.append((min(x, nodes[y]), max(x, nodes[y])))
        return pd.DataFrame(out, columns=["a", "b"])

    asked = rest.groupBy("own_key", "own_part", "own_block")
    return asked.cogroup(here.groupBy("key", "part", "block")).applyInPandas(linked, schema).distinct()


def _meeting(rows: DataFrame) -> DataFrame:
    """``rows(key, node, size)`` of keys with several nodes, once each, with the least node of the key."""
    shared = rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    return written(rows.join(shared.select("key", "least"), "key").groupBy("key", "node", "least").agg(F.max("size").alias("size")), "entries")


def _drawn_together(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(node, label)`` of the nodes that links lead from: the smallest node of their component."""
    stars = entries.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    links = written(_confirmed(stars, sets, percent), "links")
    labels = components(links)
    members, mixed = _mixed(entries.select("key", "node", "size"), labels)
    narrow = _narrow_pairs(members, mixed).join(stars, ["a", "b"], "left_anti")
    more = written(_confirmed(narrow, sets, percent).union(_wide_links(members, mixed, sets, percent)), "links")
    if not more.isEmpty():
        labels = joined(labels, more)
    discard(links, members, mixed, more)
    return labels


def linked(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(node, label)`` of the nodes of ``rows(key, node, size)`` that links lead from, by ``sets(node, set)``.

    Nodes that share a key are compared as the module says, and no others.
    """
    entries = _meeting(rows)
    labels = _drawn_together(entries, sets, percent)
    discard(entries)
    return labels


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """``(node, key, size)``: the rarest shingles of ``sets(node, set)``.

    Of sets in one order of all shingles, two at the threshold share one among
    the first n - ceil(n * percent / 100) + 1 of each.  Shingles that only one
    set holds come first in that order and meet nothing, so they are only counted.
    """
    each = sets.select("node", F.size("set").alias("size"), F.explode("set").alias("key"))
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    of_set = Window.partitionBy("node", "size")
    ranked = each.join(often, "key").withColumn("shared", F.count(F.lit(1)).over(of_set)).withColumn("rank", F.row_number().over(of_set.orderBy("often", "key")))
    first = F.col("size") - F.expr(f"(size * {percent} + 99) div 100") + 1
    return ranked.filter(F.col("rank") <= first - (F.col("size") - F.col("shared"))).select("node", "key", "size")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75, exact: bool = False) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs``.

    component_id is the smallest id reachable over links; kept marks it.  With
    ``exact`` no link is lost at any ``percent``; else see the module for how few.
    """
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sketches = written(sketched(docs, words=words), "sketches")
    filled = sketches.filter("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size"))
    if exact:
        sets = written(_sets(docs, classes.select("node").distinct(), words), "sets")
        rows = written(rarest(sets, percent), "rarest")
    else:
        rows = classes.select("node", F.explode("bands").alias("key"), "size")
    entries = _meeting(rows)
    if exact:
        discard(rows)
    else:
        sets = written(_sets(docs, entries.select("node").distinct(), words), "sets")
    labels = _drawn_together(entries, sets, percent)
    scratch = [entries, sets, labels]

    members = filled.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"))
    members = written(members.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("component"), "n"), "classes")
    discard(*scratch)
    heavy = F.col("n") * HEAVY > sketches.count()
    rows = sketches.select("doc_id", "n_shingles", "digest")
    rows = rows.join(F.broadcast(members.filter(heavy).select("digest", F.col("component").alias("heavy"))), "digest", "left")  # fewer than HEAVY rows
    near = rows.filter("heavy is null").join(members.filter(~heavy).select("digest", "component"), "digest", "left")
    rows = rows.filter("heavy is not null").select("doc_id", "n_shingles", F.col("heavy").alias("component")).unionByName(near.select("doc_id", "n_shingles", "component"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component, and the rows without an id; of rows that share its id the one with the smallest text stays."""
    found = near_duplicates(docs, **options)
    rows = docs.filter("doc_id is not null").join(found.filter("kept and doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    repeated = docs.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    single = rows.join(repeated, "doc_id", "left_anti")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.struct("text", F.to_json(whole))).alias("row")).select("row.*")
    return single.unionByName(first).unionByName(docs.filter("doc_id is null")).select(docs.columns)
