"""Token ids in binary files: independent zstandard frames with a trailing seek table.

A file holds whole documents in ascending order of id.  Layout:

* data frames: the ids of some documents as little-endian unsigned integers of
  2 bytes, or 4 where the vocabulary needs it; a frame ends with the document
  that brings it to ``frame_ids`` ids;
* one skippable frame (magic 0x184D2A50) with the zstandard-compressed document
  index: the number of documents as 8 bytes, then their ids (8 bytes, the
  smallest number for no id), numbers of tokens and frames (4 bytes each);
* the seek table of the public seekable format: a skippable frame (0x184D2A5E)
  with compressed size, decompressed size and XXH64 checksum of every frame
  before it, then the number of frames, a descriptor byte and 0x8F92EAB1.

Plain zstandard decompresses such a file to the ids of all its documents;
``read_documents`` decompresses only frames that hold wanted documents.

The text is encoded with the tokenizers library.  It never joins a character
that is not white space with white space after it, so a text without rare white
space is encoded run by run and equal runs once.

Defined cases: null text counts as empty and has the end id only; rows without
an id come first; rows that share an id are ordered by text and all written; an
empty table gives no file; a very long text is one document of a frame of its
own size; only id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import itertools
import os
import posixpath
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from tempora.llm.shared import new_file, of_attempt, old_file, shared_dir, written

SKIPPABLE, SEEK_TABLE, SEEK_FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
NO_ID = -(2**63)
#: Runs of each of the two generations that a worker remembers (about 90 MB each).
REMEMBERED = 400_000
#: New runs that are encoded as the lines of one text.
LINES = 2000

_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_LINE = re.compile(r" ?[^ \t\n\r]+")
# a word before anything that surely is no letter; other runs with the white space before them
_RUN = re.compile(
    rf" ?[{_LETTERS}]+(?=[ -@\[-`{{-~\t\n\r]|\Z)| ?[^ \t\n\r]+|[\t\n\r](?=[^ \t\n\r])|[ \t\n\r]+[^ \t\n\r]+|[ \t\n\r]+"
)
_RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, with equal runs encoded once."""

    def __init__(self, definition: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_buffer(definition)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 2**16 else 4
        self.kind = f"<u{self.width}"
        (self.line_end,) = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        units = []
        for text in texts:
            text = text or ""
            units.append([text] if _RARE_SPACE.search(text) else _RUN.findall(text))
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        new = set().union(*units) - self.known.keys()
        again = new & self.older.keys()
        self.known.update((u, self.older[u]) for u in again)
        self._learn(list(new - again))
        find = self.known.__getitem__
        return [np.frombuffer(b"".join(map(find, of_text)), self.kind) for of_text in units]

    def _learn(self, new: list[str]) -> None:
        lines = [u for u in new if _LINE.fullmatch(u)]
        others = [u for u in new if not _LINE.fullmatch(u)]
        groups = [lines[at : at + LINES] for at in range(0, len(lines), LINES)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False)):
            # the split pattern keeps the ends of such lines apart, and no run in them holds their id
            ids = np.array(e.ids, self.kind)
            ends = np.append(np.flatnonzero(ids == self.line_end), len(ids))
            if len(ends) != len(group):
                raise ValueError("this tokenizer does not keep lines apart")
            raw, start = ids.tobytes(), 0
            for u, end in zip(group, ends.tolist()):
                self.known[u] = raw[self.width * start : self.width * end]
                start = end + 1
        for u, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            self.known[u] = np.array(e.ids, self.kind).tobytes()


_encoders: dict[int, Encoder] = {}


def _encoder(definition: bytes) -> Encoder:
    """The encoder of this worker process, which a later task finds with what it has learnt."""
    key = hash(definition)
    if key not in _encoders:
        _encoders[key] = Encoder(definition)
    return _encoders[key]


class _Writer:
    """One file; documents go in by ascending id."""

    def __init__(self, out, width: int, frame_ids: int, level: int):
        self.out, self.width, self.frame_ids = out, width, frame_ids
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.open: list[np.ndarray] = []
        self.in_open, self.frames, self.index = 0, [], []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((NO_ID if doc_id is None else doc_id, len(ids), len(self.frames)))
        self.open.append(ids)
        self.in_open += len(ids)
        self.n_ids += len(ids)
        if self.in_open >= self.frame_ids:
            self.flush()

    def flush(self) -> None:
        if self.open:
            raw = np.concatenate(self.open).astype(f"<u{self.width}").tobytes()
            self._frame(self.zstd.compress(raw), raw)
            self.open, self.in_open = [], 0

    def _frame(self, packed: bytes, raw: bytes) -> None:
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        self.flush()
        ids, sizes, frames = (np.array(x) for x in zip(*self.index))
        raw = struct.pack("<Q", len(ids)) + ids.astype("<i8").tobytes() + sizes.astype("<u4").tobytes() + frames.astype("<u4").tobytes()
        packed = self.zstd.compress(raw)
        self._frame(struct.pack("<II", SKIPPABLE, len(packed)) + packed, b"")
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_FOOTER)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(table)) + table)


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, file, width: int):
        self.file, self.width = file, width
        size = file.size()
        count, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_FOOTER or not descriptor & CHECKSUMS:
            raise ValueError("no seek table with checksums")
        table = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.packed, self.raw, self.sums = table.T
        self.starts = np.concatenate([[0], np.cumsum(self.packed)])
        body = self._at(int(self.starts[count - 1]) + 8, int(self.packed[count - 1]) - 8)
        index = zstandard.ZstdDecompressor().decompress(body)
        n = struct.unpack_from("<Q", index)[0]
        self.doc_ids = np.frombuffer(index, "<i8", n, 8)
        self.sizes = np.frombuffer(index, "<u4", n, 8 + 8 * n).astype(np.int64)
        self.frames = np.frombuffer(index, "<u4", n, 8 + 12 * n).astype(np.int64)

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def frame(self, k: int) -> np.ndarray:
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), int(self.packed[k])), max_output_size=int(self.raw[k]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} does not match its checksum")
        return np.frombuffer(raw, f"<u{self.width}")

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """``(position, id, ids)`` of all or the wanted documents, with one frame in memory."""
        chosen = np.arange(len(self.doc_ids)) if wanted is None else np.flatnonzero(np.isin(self.doc_ids, list(wanted)))
        for k in np.unique(self.frames[chosen]):
            first = np.searchsorted(self.frames, k)
            here = chosen[self.frames[chosen] == k]
            ends = np.cumsum(self.sizes[first : np.searchsorted(self.frames, k, "right")])
            ids = self.frame(int(k))
            for i in here:
                end = ends[i - first]
                yield int(i), int(self.doc_ids[i]), ids[end - self.sizes[i] : end]


MANIFEST = StructType([
    StructField("file", IntegerType()), StructField("path", StringType()), StructField("width", IntegerType()),
    StructField("first_id", LongType()), StructField("last_id", LongType()), StructField("n_docs", LongType()), StructField("n_ids", LongType()),
])


def write_tokens(
    docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int | None = 0, doc_id: str = "doc_id", text: str = "text",
    frame_ids: int = 65536, level: int = 3,
) -> DataFrame:
    """Write the files of ``docs`` and return their manifest, with the ids before each file as ``start``.

    Files are dealt out by ranges of id, so their order is that of the ids.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    with open(tokenizer_path, "rb") as f:
        definition = spark.sparkContext.broadcast(f.read())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        number = TaskContext.get().partitionId()
        path = of_attempt(posixpath.join(folder, f"tokens-{number:06d}.zst"))
        encoder = _encoder(definition.value)
        end = np.array([] if end_id is None else [end_id], f"<u{encoder.width}")
        with new_file(path) as out:
            writer = _Writer(out, encoder.width, frame_ids, level)
            for batch in itertools.chain([first], batches):
                for at in range(0, batch.num_rows, 256):
                    rows = batch.slice(at, 256)
                    for i, ids in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1).to_pylist())):
                        writer.add(i, np.concatenate([ids, end]))
            writer.close()
        known = [i for i, _, _ in writer.index if i != NO_ID]  # in order
        of = (known[0], known[-1]) if known else (None, None)
        row = {"file": number, "path": path, "width": encoder.width, "first_id": of[0], "last_id": of[1], "n_docs": len(writer.index), "n_ids": writer.n_ids}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("file", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(ordered.mapInArrow(write, MANIFEST), "token-files")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def _rows(path: str, width: int, start: int, wanted: set[int] | None) -> Iterator[pd.DataFrame]:
    with old_file(path) as f:
        reader = Reader(f, int(width))
        starts = int(start) + np.concatenate([[0], np.cumsum(reader.sizes)])
        documents = reader.documents(wanted)
        while some := list(itertools.islice(documents, 1024)):
            yield pd.DataFrame({
                "doc_id": pd.array([None if i == NO_ID else i for _, i, _ in some], "Int64"), "start": [starts[p] for p, _, _ in some],
                "n_tokens": [len(ids) for _, _, ids in some], "ids": [ids.astype("<u4").tobytes() for _, _, ids in some],
            })


def _spread(df: DataFrame) -> DataFrame:
    """A file to a task, or few."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, F.xxhash64("file"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of all documents; ids are little-endian unsigned 32-bit integers."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, width, start in zip(batch["path"], batch["width"], batch["start"]):
                yield from _rows(path, width, start, None)

    return _spread(manifest).mapInPandas(read, DOCUMENTS)


def read_documents(manifest: DataFrame, wanted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The wanted documents only; of each file just their frames are decompressed.

    The files' indexes are joined with the wanted ids, and the ids wanted of one
    file (at most its documents) come to one task.
    """
    asked = wanted.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    of_file = ["file", "path", "width", "start"]

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one in batch.itertuples(index=False):
                with old_file(one.path) as f:
                    ids = np.unique(Reader(f, int(one.width)).doc_ids)
                for at in range(0, len(ids), 100_000):
                    yield pd.DataFrame({c: getattr(one, c) for c in of_file} | {"doc_id": ids[at : at + 100_000]})

    held = _spread(manifest.select(of_file)).mapInPandas(listed, "file int, path string, width int, start long, doc_id long").join(asked, "doc_id")
    files = held.groupBy(*of_file).agg(F.collect_list("doc_id").alias("wanted"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, width, start, ids in zip(batch["path"], batch["width"], batch["start"], batch["wanted"]):
                yield from _rows(path, width, start, set(ids))

    return _spread(files).mapInPandas(read, DOCUMENTS)
