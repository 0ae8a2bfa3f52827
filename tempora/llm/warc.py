"""Legacy archives: ARC files converted to WARC 1.1.

An ARC file starts with a version block (``filedesc://``) whose second line
gives the version and whose third line names the fields of every header line
that follows.  Version 1 has five fields and version 2 has ten.  A header line
is split from its right end, so blanks inside a URL do no harm, and the record
is read by its declared length.

The conversion synthesises what ARC lacks: record ids (UUID 5 of the archive's
name and the record's offset, so a repeated task writes the same ids), dates in
ISO form from 14 digits, record types, block and payload digests (SHA-1, base
32).  Of records with equal payloads the one whose ``X-Page-Id`` header is
largest is the response and the others become revisits of it.

Payloads are never shuffled: one pass over the archives yields digests, these
decide which records are revisits, and a second pass takes the (bounded) list
of an archive's revisits along with the archive.  Each archive is read and
written by one task record by record, with one gzip member a record.

Defined cases: null html is an empty payload; null URLs are written as ``-``;
white space and control characters of a URL are percent-encoded; a page without
an id has no ``X-Page-Id`` and gives way to any with one; of equal ids the later
record wins, so of repeated rows one is the response; an empty table gives no
archive; a very long page is one record, held by one task at a time; a file cut
short ends at its last whole record; only id, URL and html are read, so other
columns may have any names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tempora.llm.shared import discard, new_file, of_attempt, old_file, shared_dir, written

# The field lists of the two published ARC versions.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 4
#: Uncompressed bytes after which a writer begins another archive.
ARCHIVE_BYTES = 256 << 20
#: Records after which it does so as well, so that an archive's list of revisits is bounded.
ARCHIVE_RECORDS = 50_000


def sha1(data: bytes) -> str:
    """Bare upper-case base 32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _safe_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


# ---------------------------------------------------------------- ARC


@dataclass
class ArcRecord:
    fields: dict[str, str]
    content: bytes
    offset: int
    version: int

    @property
    def url(self) -> str:
        return self.fields["URL"]


def arc_version_block(name: str, date: str, version: int, origin: str = "tempora") -> bytes:
    body = f"{version} 0 {origin}\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    middle = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    return f"{middle} {'' if version == 1 else f'200 - - 0 {name} '}{len(body)}\n".encode() + body


def arc_record(url: str | None, date: str, content: bytes, version: int, offset: int, name: str, kind: str = "text/html") -> bytes:
    middle = "" if version == 1 else f"200 {hashlib.md5(content).hexdigest()} - {offset} {name} "
    return f"{_safe_url(url)} 0.0.0.0 {date} {kind} {middle}{len(content)}\n".encode() + content + b"\n"


def arc_records(stream: io.BufferedIOBase) -> Iterator[ArcRecord]:
    """The records of an uncompressed ARC stream, the version block first; offsets are uncompressed."""
    names, version, offset = ARC_FIELDS[1], 1, 0
    while line := stream.readline():
        start, offset = offset, offset + len(line)
        text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
        if not text:
            continue
        first = text.startswith("filedesc://")
        # the version block's own line tells its version by its number of fields
        parts = text.rsplit(" ", len(names) - 1)
        if first:
            names = ARC_FIELDS[2 if len(text.split(" ")) >= len(ARC_FIELDS[2]) else 1]
            parts = text.rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"no ARC header at {start}: {text[:80]!r}")
        fields = dict(zip(names, parts))
        length = int(fields["Archive-length"])
        content = stream.read(length)
        offset += len(content)
        if len(content) < length:
            return
        if first:
            lines = content.decode("utf-8", "replace").split("\n")
            version = int(lines[0].split(" ")[0])
            names = lines[1].split()
        yield ArcRecord(fields, content, start, version)


def write_arcs(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "20240229120000") -> DataFrame:
    """Write ``pages`` as gzipped ARC files of both versions by turns; ``(archive, path)`` of each."""
    folder = folder or shared_dir(pages.sparkSession, "arc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        rows = (row for b in batches for at in range(0, b.num_rows, 256) for row in b.slice(at, 256).to_pylist())
        row = next(rows, None)
        while row is not None:
            version = 1 + (task + number) % 2
            name = f"pages-{task:06d}-{number:04d}.arc.gz"
            path = of_attempt(posixpath.join(folder, name))
            with new_file(path) as out:
                head = arc_version_block(name, date, version)
                out.write(_member(head))
                size = len(head)
                records = 0
                while row is not None and size < ARCHIVE_BYTES and records < ARCHIVE_RECORDS:
                    records += 1
                    body = (row["html"] or "").encode("utf-8", "replace")
                    own = b"" if row["page_id"] is None else f"X-Page-Id: {row['page_id']}\r\n".encode()
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + f"Content-Length: {len(body)}\r\n\r\n".encode()
                    record = arc_record(row["url"], date, http + body, version, size, name)
                    out.write(_member(record))
                    size += len(record)
                    row = next(rows, None)
            number += 1
            yield pa.RecordBatch.from_pylist([{"archive": name, "path": path}])

    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    return written(rows.mapInArrow(write, "archive string, path string"), "arc-files")


# ---------------------------------------------------------------- conversion


def _http(content: bytes) -> tuple[bytes, bytes]:
    """Header block (with its blank line) and payload of an HTTP response; other content is all payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    end = content.find(b"\r\n\r\n")
    return (content, b"") if end < 0 else (content[: end + 4], content[end + 4 :])


def _page_id(head: bytes) -> int | None:
    found = re.search(rb"(?im)^x-page-id:[ \t]*(-?\d+)[ \t]*\r?$", head)
    return int(found[1]) if found else None


def _record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def _iso(date: str) -> str:
    """ISO form of up to 14 digits; a shorter date means its first moment."""
    low = "00000101000000"
    digits = re.sub(r"\D", "", date)[:14]
    d = digits + low[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*headers, ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def _converted(record: ArcRecord, archive: str, refers: dict | None) -> bytes:
    """The WARC record that is equivalent to an ARC record; a revisit if ``refers`` tells of what."""
    date, own_id = _iso(record.fields["Archive-date"]), _record_id(archive, record.offset)
    if record.url.startswith("filedesc://"):
        headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", own_id), ("WARC-Date", date), ("WARC-Filename", archive.replace(".arc", ".warc")), ("Content-Type", "application/warc-fields")]
        return warc_record(headers, f"format: WARC File Format 1.1\r\ndescription: converted from ARC version {record.version} file {archive}\r\n".encode())
    head, payload = _http(record.content)
    kind = "revisit" if refers else "response" if head else "resource"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Target-URI", record.url), ("WARC-Date", date)]
    if record.fields["IP-address"] not in ("0.0.0.0", "-"):
        headers.append(("WARC-IP-Address", record.fields["IP-address"]))
    headers.append(("WARC-Payload-Digest", f"sha1:{sha1(payload)}"))
    if refers:
        headers += [
            ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers["record_id"]), ("WARC-Refers-To-Target-URI", refers["url"]),
            ("WARC-Refers-To-Date", _iso(refers["date"])), ("WARC-Truncated", "length"),
        ]
    headers.append(("Content-Type", "application/http; msgtype=response" if head else record.fields["Content-type"]))
    return warc_record(headers, head if refers else head + payload)


DIGESTS = "archive string, offset long, record_id string, url string, date string, page_id long, digest string, payload_bytes long"


def _spread(df: DataFrame) -> DataFrame:
    """An archive to a task, or few."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, F.xxhash64("archive"))  # kept apart from a join on the archive, whose few bytes would be put in one task


def _each(path: str, parse) -> Iterator:
    with old_file(path) as f, gzip.GzipFile(fileobj=f) as stream:
        yield from parse(io.BufferedReader(stream, 1 << 18))


def _frames(rows: Iterator[dict], size: int = 1000) -> Iterator[pd.DataFrame]:
    some: list[dict] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pd.DataFrame(some)
            some = []
    if some:
        yield pd.DataFrame(some)


def arc_digests(archives: DataFrame) -> DataFrame:
    """One row for each record of ``archives(archive, path)``, without its content."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for archive, path in zip(batch["archive"], batch["path"]):
                    for r in _each(path, arc_records):
                        if not r.url.startswith("filedesc://"):
                            head, payload = _http(r.content)
                            yield {
                                "archive": archive, "offset": r.offset, "record_id": _record_id(archive, r.offset), "url": r.url.encode("utf-8", "replace").decode(),
                                "date": r.fields["Archive-date"], "page_id": _page_id(head), "digest": sha1(payload), "payload_bytes": len(payload),
                            }

        for frame in _frames(rows()):
            yield frame.astype({"page_id": "Int64"})

    return _spread(archives).mapInPandas(read, DIGESTS)


def convert(archives: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Convert ARC to WARC files; ``(archive, path, n_records)`` of each.

    Equal payloads of ``least_bytes`` or more are stored once.
    """
    folder = folder or shared_dir(archives.sparkSession, "warc")
    found = written(arc_digests(archives), "digests")
    rank = F.struct("page_id", "archive", "offset")
    one = F.max_by(F.struct("record_id", "url", "date"), rank).alias("one")
    groups = found.filter(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(one, F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "one")
    revisits = found.filter(F.col("payload_bytes") >= least_bytes).join(groups, "digest").filter("record_id <> one.record_id")
    # at most the records of one archive, which are bounded
    lists = revisits.groupBy("archive").agg(F.collect_list(F.struct("offset", "one.record_id", "one.url", "one.date")).alias("revisits"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, path, revisits in zip(batch["archive"], batch["path"], batch["revisits"]):
                refers = {} if revisits is None else {r["offset"]: r for r in revisits}
                name, n = archive.replace(".arc", ".warc"), 0
                to = of_attempt(posixpath.join(folder, name))
                with new_file(to) as out:
                    for record in _each(path, arc_records):
                        out.write(_member(_converted(record, archive, refers.get(record.offset))))
                        n += 1
                yield pd.DataFrame({"archive": [name], "path": [to], "n_records": [n]})

    with_lists = archives.select("archive", "path").join(lists, "archive", "left")
    made = written(_spread(with_lists).mapInPandas(write, "archive string, path string, n_records long"), "warc-files")
    discard(found)
    return made


# ---------------------------------------------------------------- WARC


@dataclass
class WarcRecord:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


def warc_records(stream: io.BufferedIOBase) -> Iterator[WarcRecord]:
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"no WARC record: {line[:80]!r}")
            continue
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) < length:
            return
        yield WarcRecord(headers, block)


RECORDS = "record_id string, record_type string, url string, date string, page_id long, payload_digest string, digest_holds boolean, payload_bytes long, refers_to_id string"


def read_warcs(archives: DataFrame) -> DataFrame:
    """One row for each record but warcinfo of ``archives(archive, path)``.

    ``payload_bytes`` counts what the record holds, none for a revisit;
    ``digest_holds`` tells whether a stored payload has the digest that its
    header tells.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for path in batch["path"]:
                    for r in _each(path, warc_records):
                        kind = r.headers["warc-type"]
                        if kind == "warcinfo":
                            continue
                        head, payload = _http(r.block)
                        told = r.headers.get("warc-payload-digest", "").removeprefix("sha1:")
                        stored = kind != "revisit"
                        yield {
                            "record_id": r.headers["warc-record-id"], "record_type": kind, "url": r.headers.get("warc-target-uri"), "date": r.headers["warc-date"],
                            "page_id": _page_id(head), "payload_digest": told, "digest_holds": sha1(payload) == told if stored else None,
                            "payload_bytes": len(payload) if stored else None, "refers_to_id": r.headers.get("warc-refers-to"),
                        }

        for frame in _frames(rows()):
            yield frame.astype({"page_id": "Int64", "payload_bytes": "Int64", "digest_holds": "boolean"})

    return _spread(archives).mapInPandas(read, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with the page and the payload's bytes of what a revisit refers to."""
    stored = records.filter("record_type <> 'revisit'")
    whole = stored.withColumn("refers_to", F.lit(None).cast("long"))
    target = stored.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("whole_bytes"))
    again = records.filter("record_type = 'revisit'").join(target, "refers_to_id", "left")
    again = again.withColumn("payload_bytes", F.col("whole_bytes")).drop("whole_bytes")
    return whole.unionByName(again)
