"""Document fingerprints: SpotSigs.

A signature is a common word (an anchor) with the chain of the next content
words after it; in stretches without a common word (lists, menus, other
languages) content words are anchors too.  A text's fingerprint is the set of
its signatures.  Where no chain fits, its words are its signatures.

``likeness`` compares given pairs.  ``near_duplicates`` draws together what is
alike at or above a similarity: equal fingerprints are one class first; classes
are partitioned by set length such that only neighbouring partitions can hold
matches; within them a set is indexed by its rarest signatures only (two sets
at the threshold must share one of these), pairs whose lengths differ too much
are pruned, and the rest is confirmed on whole sets.  ``against_next`` is asked
for the likeness of given neighbours, whatever it is, so nothing can be pruned
there.

Defined cases: null text counts as empty and has the empty fingerprint; two
empty fingerprints are alike by 1 and linked with nothing; repeated rows and
equal texts have equal fingerprints; rows that share an id follow each other by
text; a very long text is held by one task, with the one before it; an empty
table gives an empty one, and the only row of a table is its own next one; only
id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tempora.llm import minhash
from tempora.llm.shared import discard, written

# Common words of English, German, French and Spanish.
COMMON = (
    "a an and are as at be by for from has have he in is it its of on or she that the they this to was were which who with you not "
    "als auf aus bei das dem den der des die ein eine einen für ich im ist mit nicht sich sie und von war zu zum "
    "au aux avec ce ces dans de des du elle en est et il la le les leur lui mais ne nous ou par pas plus pour qu que qui sa se ses son sur un une vous "
    "al como con del el ella era es ese esta está los las lo más no para pero por su sus también una uno y"
).split()
CHAIN = 2
#: Ranges of ids at most; the bounds of all (8 bytes each) are in every task.
MOST_RANGES = 20_000
#: Words without a common one after which every word stands in as an anchor.
GAP = 8

_WORD = re.compile(r"\w+")
_COMMON = frozenset(COMMON)


def signatures(text: str | None, chain: int = CHAIN, common: frozenset[str] = _COMMON) -> np.ndarray:
    """The sorted distinct 32-bit hashes of a text's signatures."""
    words = _WORD.findall((text or "").lower())
    spots: set[str] = set()
    content: list[str] = []
    anchors: list[tuple[str, int]] = []  # and how many content words were before it
    last = -1
    for place, w in enumerate(words):
        if w in common:
            anchors.append((w, len(content)))
            last = place
        else:
            content.append(w)
            if place - last > GAP:
                anchors.append((w, len(content)))
    for w, at in anchors:
        if at + chain <= len(content):
            spots.add(f"{w} {' '.join(content[at : at + chain])}")
    if not spots:
        spots.update(words)
    return np.array(sorted({xxhash.xxh32_intdigest(s) for s in spots}), np.uint32)


def as_string(spots: np.ndarray) -> str:
    """A fingerprint as text: eight hex digits for each signature, in order."""
    return spots.astype(">u4").tobytes().hex()


def from_string(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


@F.pandas_udf(ArrayType(LongType()))
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The fingerprint of a text as a sorted array."""
    for batch in texts:
        yield pd.Series([signatures(t).astype(np.int64) for t in batch], dtype=object)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprint arrays; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - both
    return F.when(whole == 0, F.lit(1.0)).otherwise(both / whole)


# ---------------------------------------------------------------- neighbours in the order of ids


COMPARED = StructType([
    StructField("doc_id", LongType()), StructField("n_chars", LongType()), StructField("edited_text", StringType()), StructField("fingerprint", StringType()),
    StructField("edited_fingerprint", StringType()), StructField("near_edited", DoubleType()), StructField("near_next", DoubleType()),
])


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    share = len(text) // 3
    return text[: len(text) - share] + following[:share]


def against_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_per_range: int = 2000) -> DataFrame:
    """Each document compared with its edited text and with the next document by falling id (after the last: the first).

    Ids are cut into ranges at quantiles, at most MOST_RANGES, and the first row
    of a range is also sent to the range before it, so each row meets its next
    one in its own task; a range is sorted, with spilling, and streams through
    its task, which holds two documents at a time.  Rows without an id come last;
    rows that share an id follow each other by text.
    """
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    wanted = min(MOST_RANGES, max(1, math.ceil(rows.count() / rows_per_range)))
    quantiles = rows.approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], 0.25 / wanted) if wanted > 1 else []
    bounds = np.unique(np.array(quantiles, np.int64))

    def own_range(ids: pd.Series) -> np.ndarray:
        return len(bounds) - np.searchsorted(bounds, ids.to_numpy(), "left")  # falling ids: range 0 holds the largest

    @F.pandas_udf(IntegerType())
    def ranged(ids: pd.Series) -> pd.Series:
        return pd.Series(own_range(ids).astype(np.int32))

    tops = rows.groupBy(ranged("doc_id").alias("range")).agg(F.max("doc_id").alias("top")).orderBy("range").collect()  # a row a range
    before = {r.top: tops[i - 1].range for i, r in enumerate(tops)}

    @F.pandas_udf(ArrayType(IntegerType()))
    def places(ids: pd.Series) -> pd.Series:
        return pd.Series([[r, before[i]] if i in before else [r] for r, i in zip(own_range(ids).tolist(), ids)], dtype=object)

    placed = rows.withColumn("ranges", places("doc_id")).select(F.posexplode("ranges").alias("place", "range"), "doc_id", "text")
    ordered = placed.select("range", (F.col("place") == 1).alias("guest"), "doc_id", "text").repartition("range").sortWithinPartitions("range", "guest", F.desc("doc_id"), "text")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        done: list[tuple] = []
        for batch in batches:
            for place, guest, i, t in zip(batch["range"], batch["guest"], batch["doc_id"], batch["text"]):
                spots = signatures(t)
                # only the first of the guests follows; a held row's next is the first row after it
                if held is not None and held[0] == place:
                    changed = edited(held[2], t)
                    of_changed = signatures(changed)
                    done.append((
                        held[1], len(held[2]), changed, as_string(held[3]), as_string(of_changed),
                        jaccard(held[3], of_changed), jaccard(held[3], spots),
                    ))
                held = None if guest else (place, i, t, spots)
                if len(done) >= 200:
                    yield pd.DataFrame(done, columns=COMPARED.names)
                    done = []
        if done:
            yield pd.DataFrame(done, columns=COMPARED.names)

    compared = ordered.mapInPandas(compare, COMPARED)
    return compared.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))


# ---------------------------------------------------------------- all near pairs


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """``(doc_id, class_id, component_id)`` of every row with an id: the smallest id of equal fingerprints, and the smallest that links lead to.

    Empty fingerprints are linked with nothing.  Links are confirmed on whole
    sets, and no more of them are made than draw components together.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), fingerprint(F.col(f"`{text}`")).alias("spots"))
    rows = written(rows.filter("doc_id is not null").withColumn("digest", F.sha2(F.to_json(F.struct("spots")), 256)), "spots")
    heads = rows.groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    classes = rows.select("doc_id", "digest").join(heads, "digest").select("doc_id", "class_id")
    sets = rows.join(heads.withColumnRenamed("class_id", "doc_id"), ["digest", "doc_id"], "left_semi").dropDuplicates(["digest"])
    sets = written(sets.filter(F.size("spots") > 0).select(F.col("doc_id").alias("node"), F.col("spots").alias("set")), "spot-sets")
    first = minhash.rarest(sets, percent)
    share = percent / 100
    part = F.floor(F.log(F.col("size").cast("double")) / math.log(1 / share)).cast("int") if percent < 100 else F.col("size")
    # a match is at most 1 / share times as long, so it lies in the same or the next partition
    parts = first.withColumn("part", F.explode(F.array(part, part + 1)))
    entries = parts.select(F.xxhash64("key", "part").alias("key"), "node", "size")
    labels = minhash.linked(entries, sets, percent)
    found = classes.join(labels.select(F.col("node").alias("class_id"), "label"), "class_id", "left")
    made = written(found.select("doc_id", "class_id", F.coalesce("label", "class_id").alias("component_id")), "near")
    discard(rows, sets, labels)
    return made
