"""FLAC recordings (RFC 9639): files are split into frames, and frames are decoded on their own, wherever Spark deals them.

A file's frames are found by their headers' check sums and by the check sum over
a frame's whole length, so they need no decoding to be told apart, and a long
recording is the work of many tasks.  A broken header or check sum, a gap between
frames and a missing end are errors that name the file.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tempora.operators.sound import resampled
from tempora.sources.labels import wav

FRAMES = "path string, sr int, bits int, channels int, first long, frame binary"
BLOCKS = "path string, sr int, first long, samples array<float>"
#: Frames that are sent on together.
TOGETHER = 64

# What the codes of a frame's header stand for; 0 is as the stream says.
SAMPLE_RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10


def _crc_table(polynomial: int, bits: int) -> list[int]:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    table = []
    for value in range(256):
        crc = value << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ (polynomial if crc & top else 0)) & mask
        table.append(crc)
    return table


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8[crc ^ b]
    return crc


def crc16(data: bytes, crc: int = 0) -> int:
    for b in data:
        crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ b]
    return crc


class Stream(NamedTuple):
    least_block: int
    sr: int
    channels: int
    bits: int
    samples: int


class Header(NamedTuple):
    block: int
    sr: int
    bits: int
    assignment: int
    first: int
    size: int

    @property
    def channels(self) -> int:
        return 2 if self.assignment >= LEFT_SIDE else self.assignment + 1


def stream_of(content: bytes) -> tuple[Stream, int]:
    """What the stream says of itself, and where its frames begin."""
    if content[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, last = 4, None, False
    while not last:
        kind, length = content[at] & 0x7F, int.from_bytes(content[at + 1 : at + 4], "big")
        last = content[at] >= 0x80
        if kind == 0:
            body = content[at + 4 : at + 38]
            packed = int.from_bytes(body[10:18], "big")
            info = Stream(int.from_bytes(body[:2], "big"), packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1)
        at += 4 + length
    if info is None:
        raise ValueError("a FLAC stream without its information")
    return info, at


def header_at(content: bytes, at: int, info: Stream) -> Header | None:
    """The header of a frame that begins at ``at``, if one does."""
    head = content[at : at + 16]
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8 or head[3] & 1:
        return None
    size_code, rate_code, assignment, bits_code = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    if not size_code or rate_code == 15 or assignment > MID_SIDE or bits_code == 3:
        return None
    more = 0 if head[4] < 0x80 else 8 - (head[4] ^ 0xFF).bit_length()  # leading ones of the number's first byte
    if more == 1 or more > 7:
        return None
    rest = max(more - 1, 0)
    number = head[4] & (0x7F if not more else 0x7F >> more)
    for b in head[5 : 5 + rest]:
        number = number << 6 | b & 0x3F
    end = 5 + rest
    if size_code in (6, 7):
        block = int.from_bytes(head[end : end + size_code - 5], "big") + 1
        end += size_code - 5
    else:
        block = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else 256 << (size_code - 8)
    sr = SAMPLE_RATES.get(rate_code, info.sr)
    if rate_code >= 12:
        width = 1 if rate_code == 12 else 2
        sr = int.from_bytes(head[end : end + width], "big") * {12: 1000, 13: 1, 14: 10}[rate_code]
        end += width
    if len(head) <= end or crc8(head[:end]) != head[end]:
        return None
    return Header(block, sr, SAMPLE_BITS.get(bits_code, info.bits), assignment, number if head[1] & 1 else number * info.least_block, end + 1)


def frames_of(content: bytes) -> Iterator[tuple[Stream, Header, bytes]]:
    """The frames of a stream, in order."""
    info, at = stream_of(content)
    expected = 0
    while at < len(content):
        head = header_at(content, at, info)
        if head is None or head.first != expected:
            raise ValueError(f"no frame with sample {expected} at byte {at}")
        expected += head.block
        # the check sum over a whole frame with its own at the end is 0
        crc, done, end = 0, at, None
        while end is None:
            near = content.find(b"\xff", max(done, at + 2)) if done < len(content) else -1
            near = len(content) if near < 0 else near
            crc, done = crc16(content[done:near], crc), near
            following = header_at(content, near, info) if near < len(content) else None
            if crc == 0 and (near == len(content) or following and following.first == expected):
                end = near
            elif near == len(content):
                raise ValueError(f"a frame with a broken check sum at byte {at}")
            else:
                crc, done = crc16(content[near : near + 1], crc), near + 1
        yield info, head, content[at:end]
        at = end
    if info.samples and expected != info.samples:
        raise ValueError(f"{expected} samples of {info.samples}")


class _Bits:
    """Bits of a frame; a number of zeros before each one is looked up, not counted."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        ones = np.where(self.bits == 1, np.arange(len(self.bits)), len(self.bits))
        self.next_one = np.minimum.accumulate(ones[::-1])[::-1].tolist() if len(ones) else []
        self.at = 0

    def number(self, width: int) -> int:
        if not width:
            return 0
        piece = self.bits[self.at : self.at + width]
        self.at += width
        return int("".join(map(str, piece.tolist())), 2)

    def signed(self, width: int) -> int:
        value = self.number(width)
        return value - (1 << width) if width and value >> (width - 1) else value

    def zeros(self) -> int:
        n = self.next_one[self.at] - self.at
        self.at += n + 1
        return n

    def numbers(self, starts: np.ndarray, width: int) -> np.ndarray:
        if not width:
            return np.zeros(len(starts), np.int64)
        return self.bits[starts[:, None] + np.arange(width)].astype(np.int64) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))

    def many_signed(self, n: int, width: int) -> np.ndarray:
        value = self.numbers(self.at + width * np.arange(n), width)
        self.at += n * width
        return value - ((value >> (width - 1) << width) if width else 0)

    def rice(self, n: int, width: int) -> np.ndarray:
        high, starts, at, following = [], [], self.at, self.next_one
        for _ in range(n):
            one = following[at]
            high.append(one - at)
            starts.append(one + 1)
            at = one + 1 + width
        self.at = at
        value = (np.array(high, np.int64) << width) + self.numbers(np.array(starts, np.int64), width)
        return (value >> 1) ^ -(value & 1)


def _residual(bits: _Bits, block: int, order: int) -> np.ndarray:
    width = 4 + bits.number(2)
    if width > 5:
        raise ValueError("an unknown way of coding")
    parts = bits.number(4)
    out = []
    for k in range(1 << parts):
        n = (block >> parts) - (order if k == 0 else 0)
        parameter = bits.number(width)
        out.append(bits.many_signed(n, bits.number(5)) if parameter == (1 << width) - 1 else bits.rice(n, parameter))
    return np.concatenate(out)


def _subframe(bits: _Bits, block: int, width: int) -> np.ndarray:
    if bits.number(1):
        raise ValueError("a broken subframe")
    kind = bits.number(6)
    wasted = bits.zeros() + 1 if bits.number(1) else 0
    width -= wasted
    if kind == 0:
        x = np.full(block, bits.signed(width), np.int64)
    elif kind == 1:
        x = bits.many_signed(block, width)
    elif 8 <= kind <= 12:
        order = kind - 8
        first = bits.many_signed(order, width)
        x = _residual(bits, block, order)
        for k in range(order - 1, -1, -1):  # the residual is a difference of this order, which running sums take back
            x = np.cumsum(np.concatenate([np.diff(first, k)[:1], x]))
    elif kind >= 32:
        order = kind - 31
        first = bits.many_signed(order, width)
        precision, shift = bits.number(4) + 1, bits.signed(5)
        if precision > 15 or shift < 0:
            raise ValueError("a broken predictor")
        weights = bits.many_signed(order, precision)[::-1].tolist()
        held = first.tolist()
        for r in _residual(bits, block, order).tolist():
            held.append(r + (sum(map(int.__mul__, weights, held[-order:])) >> shift))
        x = np.array(held, np.int64)
    else:
        raise ValueError("an unknown kind of subframe")
    return x << wasted


def decoded(frame: bytes, head: Header) -> np.ndarray:
    """``(channels, block)``: the samples of a frame as whole numbers."""
    if crc16(frame):
        raise ValueError("a frame with a broken check sum")
    bits = _Bits(frame[head.size : -2])
    wider = {LEFT_SIDE: 1, SIDE_RIGHT: 0, MID_SIDE: 1}.get(head.assignment)
    parts = [_subframe(bits, head.block, head.bits + (k == wider)) for k in range(head.channels)]
    if head.assignment == LEFT_SIDE:
        parts[1] = parts[0] - parts[1]
    elif head.assignment == SIDE_RIGHT:
        parts[0] = parts[0] + parts[1]
    elif head.assignment == MID_SIDE:
        whole = (parts[0] << 1) | (parts[1] & 1)
        parts = [(whole + parts[1]) >> 1, (whole - parts[1]) >> 1]
    return np.stack(parts)


def flac_frames(spark: SparkSession, path: str, pattern: str = "*.flac") -> DataFrame:
    """``(path, sr, bits, channels, first, frame)`` of the frames of all files, undecoded; ``first`` numbers a frame's first sample."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows: list[tuple] = []
                try:
                    for info, head, frame in frames_of(content):
                        rows.append((name, head.sr, head.bits, head.channels, head.first, frame))
                        if len(rows) == TOGETHER:
                            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FRAMES.split(", ")])
                            rows = []
                except (ValueError, IndexError) as e:
                    raise ValueError(f"{name}: {e}") from e
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in FRAMES.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(split, FRAMES)


def flac_blocks(frames: DataFrame) -> DataFrame:
    """``(path, sr, first, samples)``: mono samples from -1 to 1 of each frame, each decoded on its own."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for row in batch.itertuples(index=False):
                info = Stream(1, row.sr, row.channels, row.bits, 0)
                head = header_at(row.frame, 0, info)
                made.append((decoded(row.frame, head).mean(axis=0) / 2.0 ** (row.bits - 1)).astype(np.float32))
            yield batch[["path", "sr", "first"]].assign(samples=made)

    return frames.mapInPandas(decode, BLOCKS)


def flac(spark: SparkSession, path: str, pattern: str = "*.flac") -> DataFrame:
    """``(path, sr, samples)`` of every file, as ``labels.wav`` gives them; frames are dealt out evenly and joined a recording at a time."""
    blocks = flac_blocks(flac_frames(spark, path, pattern).repartition("path", "first"))
    held = blocks.groupBy("path").agg(F.first("sr").alias("sr"), F.array_sort(F.collect_list(F.struct("first", "samples"))).alias("blocks"))  # a recording
    return held.select("path", "sr", F.flatten(F.transform("blocks", lambda b: b["samples"])).alias("samples"))


def recordings(spark: SparkSession, path: str, rate: int | None = None) -> DataFrame:
    """``(path, sr, samples)`` of the WAV and FLAC files at ``path``, all at ``rate``, if one is given."""
    both = wav(spark, path).unionByName(flac(spark, path))
    return resampled(both, rate) if rate else both
