"""Spelling variants of words by rolling-hash deletions.

A word is a run of the letters A-Z, a-z and U+00C0 to U+00FF with A-Z in lower
case.  Two words are near if one inserted, deleted or replaced letter makes one
of them the other.  Then either one letter less makes the longer one the
shorter one, or both lose the letter at the same place and become the same.

The hash of a word without its i-th letter is put together from the polynomial
hashes of what stands before and behind it; running sums over the letters of
many words give all of them at once, as integers.  Words and their deletions
are dealt out by the upper bits of their hashes and sorted by hash, so near
words stand beside each other.  Only rows that share a hash get their strings,
on which every near pair is confirmed.  A group of words that become the same
by losing the letter at one place holds a word for each letter at most, and it
tells each member how many there are and which of the others is commonest, so
no pair is ever formed.

A word's form is its commonest near word (of equally common ones the first in
the order of code points), if it is ``factor`` times as common; forms are
followed to the last by doubling, as counts grow by the factor with each.

Defined cases: null texts have no words, and rows without an id are those of
the empty id; repeated rows count as often as they are there; a run of any
length is one word, as only hashes and places travel for each of its letters; a
word that a third of all rows hold is counted where it is read; a table without
words gives none; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from tempora.llm.shared import discard, written

_RUN = re.compile(rb"(?:[a-z]++|\xc3[\x80-\xbf])++")  # U+00C0 to U+00FF are C3 80 to C3 BF
#: Words that are counted before they are sent on, and letters that are hashed together.
COUNTED, LETTERS = 200_000, 500_000
#: Upper bits of a hash that deal it out.
RADIX_BITS = 16

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_OF_LENGTH = _U(0xD1B54A32D192ED03)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def damaged(run: bytes, of_id: int, one_in: int) -> bytes:
    """``run`` without one of its letters, if its checksum, begun with ``of_id``, says so."""
    h = zlib.crc32(run, of_id)
    if h % one_in:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = 7, damage: int = 0) -> DataFrame:
    """``(word, n)`` of all words of at least so many letters.

    With ``damage``, a run whose CRC-32 of ``<id>:<run>`` it divides first loses
    the letter at the checksum modulo its length.
    """

    def sent(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for name, data in zip(batch.column(0), batch.column(1)):
                runs = Counter(r for r in _RUN.findall((data.as_py() or b"").lower()) if len(r) >= least_letters)
                of_id = zlib.crc32(f"{name.as_py() or ''}:".encode())
                for run, n in runs.items():
                    word = damaged(run, of_id, damage) if damage else run
                    if len(word) - word.count(b"\xc3") >= least_letters:
                        counts[word] += n
                if len(counts) >= COUNTED:
                    yield sent(counts)
                    counts = Counter()
            yield sent(counts)

    rows = docs.select(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`").cast("binary"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word, at, key)``: the hash of each word (at -1) and of it without the letter at each place."""
    sizes = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    owner, start = np.repeat(np.arange(len(words)), sizes), np.repeat(ends - sizes, sizes)
    at = np.arange(len(letters)) - start
    power = np.concatenate([[_U(1)], np.cumprod(np.full(max(int(sizes.max(initial=1)) - 1, 0), _BASE))])
    value = _mixed(letters + _U(1)) * power[at]
    upto = np.concatenate([[_U(0)], np.cumsum(value)])
    whole = upto[ends] - upto[ends - sizes]
    before = upto[:-1] - upto[start]
    without = before + (whole[owner] - before - value) * _BACK
    of_word = _mixed(whole + sizes.astype(np.uint64) * _OF_LENGTH)
    of_rest = _mixed(without + (sizes[owner] - 1).astype(np.uint64) * _OF_LENGTH)
    return (
        np.concatenate([np.arange(len(words)), owner]),
        np.concatenate([np.full(len(words), -1), at]).astype(np.int32),
        np.concatenate([of_word, of_rest]).view(np.int64),
    )


def _keyed(vocabulary: DataFrame) -> DataFrame:
    """``(key, at, id)`` of all words and their deletions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            part = np.cumsum([len(w) for w in words]) // LETTERS
            for p in np.unique(part):
                first, last = np.searchsorted(part, [p, p + 1])
                owner, at, key = deletion_keys(words[first:last])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(at), pa.array(ids[first:last][owner])], names=["key", "at", "id"])

    return vocabulary.select("id", "word").mapInArrow(run, "key long, at int, id long")


def _in_order(rows: DataFrame) -> DataFrame:
    """Dealt out by the upper bits of the hash, and sorted by hash and place."""
    radix = F.shiftrightunsigned("key", 64 - RADIX_BITS)
    return rows.withColumn("radix", radix).repartition("radix").drop("radix").sortWithinPartitions("key", "at")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order those that share hash and place with another one, or a hash with a whole word."""
    held = None

    def kept(key: np.ndarray, at: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        same_key = key[1:] == key[:-1]
        same = same_key & (at[1:] == at[:-1])
        starts = np.flatnonzero(np.concatenate([[True], ~same_key])) if len(key) else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, len(key)))
        keep = np.repeat((at[starts] == -1) & (sizes > 1), sizes)
        keep[1:] |= same
        keep[:-1] |= same
        return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(at[keep]), pa.array(ids[keep])], names=["key", "at", "id"])

    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if held:
            rows = [np.concatenate([a, b]) for a, b in zip(held, rows)]
        cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
        held = [r[cut:] for r in rows]
        yield kept(*[r[:cut] for r in rows])
    if held:
        yield kept(*held)


def _told(words: dict[int, tuple[str, int]], own: list[int], places: dict[int, list[int]]) -> list[tuple[int, int, int, str]]:
    """``(id, near, n, word)``: how many near words the members of one group have in it, and the commonest of them."""
    told = []

    def tell(asking: int, others: list[int]) -> None:
        word, n = min((words[i] for i in others), key=lambda x: (-x[1], x[0]))
        told.append((asking, len(others), n, word))

    for members in places.values():
        if len(members) > 1:
            first, second = sorted(members, key=lambda i: (-words[i][1], words[i][0]))[:2]
            told.extend((i, len(members) - 1, words[o][1], words[o][0]) for i in members for o in [second if i == first else first])
    longer = sorted({i for members in places.values() for i in members})
    for i in own:
        if longer:
            tell(i, longer)
    for i in longer:
        if own:
            tell(i, own)
    return told


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Near words by their strings, group by group of rows in order."""
    held = None
    for batch in batches:
        rows = pd.concat([held, batch]) if held is not None else batch
        last = rows["key"].to_numpy() == rows["key"].iloc[-1] if len(rows) else np.empty(0, bool)
        held = rows[last]
        yield _links_of(rows[~last])
    if held is not None:
        yield _links_of(held)


def _links_of(rows: pd.DataFrame) -> pd.DataFrame:
    told: list[tuple[int, int, int, str]] = []
    groups: dict[str, tuple[dict, list, dict]] = {}
    before = None
    for key, at, i, word, n in zip(rows["key"], rows["at"], rows["id"], rows["word"], rows["n"]):
        if key != before:
            for group in groups.values():
                told += _told(*group)
            groups, before = {}, key
        # words of one hash that are not the same string are groups of their own
        words, own, places = groups.setdefault(word if at < 0 else word[:at] + word[at + 1 :], ({}, [], {}))
        words[i] = (word, n)
        own.append(i) if at < 0 else places.setdefault(at, []).append(i)
    for group in groups.values():
        told += _told(*group)
    return pd.DataFrame(told, columns=["id", "near", "near_n", "near_word"]).astype({"id": "int64", "near": "int64", "near_n": "int64"})


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``(id, n_near, near_word, near_n)`` of the words of ``vocabulary(id, word, n)`` that have near words: how many, and the commonest."""
    shared = _in_order(_keyed(vocabulary)).mapInArrow(_shared, "key long, at int, id long")
    rows = shared.join(vocabulary.select("id", "word", "n"), "id").select("key", "at", "id", "word", "n")
    told = _in_order(rows).mapInPandas(_linked, "id long, near long, near_n long, near_word string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near_word").alias("word"))).alias("best")
    found = told.groupBy("id").agg(F.sum("near").alias("n_near"), best)
    return found.select("id", "n_near", F.col("best.word").alias("near_word"), (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``: where one arrives from form to form; each round doubles the way."""
    held = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(held.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(held)
        held = step
        if step.filter("moved").isEmpty():
            return step


def grouped(counts: DataFrame, times: int = 2, factor: int = 10) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of the words of ``counts(word, n)`` that occur ``times`` times."""
    vocabulary = written(counts.filter(F.col("n") >= times).withColumn("id", F.monotonically_increasing_id()).select("id", "word", "n"), "words")
    rows = vocabulary.join(near_words(vocabulary), "id", "left")
    common = F.col("near_n") >= factor * F.col("n")
    formed = written(
        rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("near_word")).alias("form"), F.when(common, F.col("near_n")).alias("form_n")), "forms"
    )
    ends = roots(formed.filter("form is not null").select("word", "form"))
    ended = formed.join(ends.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
    made = written(ended.select("word", "form", "root", "n", "n_near", "form_n"), "variants")
    discard(vocabulary, formed, ends)
    return made


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = 7, times: int = 2, factor: int = 10, damage: int = 0) -> DataFrame:
    """The words of ``docs`` with their forms and roots."""
    return grouped(word_counts(docs, doc_id, text, least_letters, damage), times, factor)
