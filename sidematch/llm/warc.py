"""WARC archives: written record by record, read back from byte ranges.

Every record is a gzip member of its own.  A reading task gets a range of a file, looks
for the magic bytes of a member, takes a candidate only if it decodes to a record
header, and owns the records that start inside its range, reading past its end where
the last of them needs it.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidematch.session import materialize
from .common import create_file, map_batches, open_file, shared_folder

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
RANGE_BYTES = 8 << 20
STEP_BYTES = 1 << 20
FILE_ROWS = 20_000
# Repeated payloads are sent to every task up to this number (80 bytes each), beyond it joined.
BROADCAST_HEADS = 1 << 17
DATE = "1970-01-01T00:00:00Z"

RECORDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, uri string, payload binary")


def _record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id_of(value: str | None):
    number = (value or "")[len("<urn:page:"):-1]
    return int(number) if number else None


def record(page_id, url, html, head) -> bytes:
    """One gzip member; ``head`` is the page that a revisit refers to, else None."""
    payload = (html or "").encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = [
        ("WARC-Type", "response" if head is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", urllib.parse.quote(url, safe="".join(map(chr, range(33, 127))).replace("%", ""))))
    if head is not None:
        fields += [("WARC-Refers-To", _record_id(head)),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        payload = b""
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    text = VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress(text + payload + b"\r\n\r\n") + member.flush()


def write(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) and return ``path, length, records`` of
    the files that were committed; files of failed attempts are not among them.

    Of records with equal payloads of at least ``least_bytes``, that with the largest
    id is a response and the others revisit it.  A null html is an empty payload; a
    null id sorts below all others; repeated rows with the largest id are all responses.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keys = pages.select("page_id", F.sha2(payload, 256).alias("_key"), F.octet_length(payload).alias("_bytes"))
    heads = (
        keys.where(F.col("_bytes") >= least_bytes).groupBy("_key")
        .agg(F.max("page_id").alias("_head"), F.count("*").alias("_n")).where("_n > 1 AND _head IS NOT NULL")
        .select("_key", "_head")
    )
    # the texts meet short rows that name only repeated payloads
    heads = materialize(heads)
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_HEADS else heads
    marked = pages.withColumn("_key", F.sha2(payload, 256)).join(heads, "_key", "left").select(
        "page_id", "url", "html",
        F.when(F.col("page_id").eqNullSafe(F.col("_head")), None).otherwise(F.col("_head")).alias("_head"))
    rows = pages.count()
    marked = marked.repartition(max(1, -(-rows // FILE_ROWS), spark.sparkContext.defaultParallelism), F.xxhash64("page_id", "url"))

    def run(batches):
        import uuid

        path, out, length, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                out = out or create_file(path)
                member = record(*row)
                out.write(member)
                length, count = length + len(member), count + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([length], pa.int64()), pa.array([count], pa.int64())],
                names=["path", "length", "records"])

    return materialize(map_batches(marked, run, "path string, length long, records long"))


class Window:
    """Bytes of a file from one place on, read in steps and dropped when passed."""

    def __init__(self, file, start: int):
        self.file, self.base, self.data = file, start, b""
        file.seek(start)

    def at(self, place: int, size: int = 1) -> bytes:
        """Up to ``size`` bytes or more from ``place``, fewer only at the end."""
        while self.base + len(self.data) < place + size:
            more = self.file.read(STEP_BYTES)
            if not more:
                break
            self.data += more
        return self.data[place - self.base:]

    def drop(self, place: int) -> None:
        self.data, self.base = self.data[place - self.base:], place


def member_at(window: Window, place: int) -> tuple[bytes, int] | None:
    """The decoded member that starts at ``place`` and where it ends, or None if no
    WARC record starts there."""
    decoder, parts, seen, at = zlib.decompressobj(31), [], 0, place
    try:
        while not decoder.eof:
            raw = window.at(at, 1)[:STEP_BYTES]
            if not raw:
                return None
            parts.append(decoder.decompress(raw))
            seen += len(parts[-1])
            at += len(raw) - len(decoder.unused_data)
            if seen >= len(VERSION) and not b"".join(parts[:2]).startswith(VERSION) and not parts[0].startswith(VERSION):
                return None
    except zlib.error:
        return None
    text = b"".join(parts)
    return (text, at) if text.startswith(VERSION) else None


def records_in(file, start: int, stop: int):
    """Decoded records whose members start in ``[start, stop)``."""
    window, place = Window(file, start), start
    while place < stop:
        data = window.at(place, len(MAGIC))
        found = data.find(MAGIC)
        if found < 0:
            if len(data) < len(MAGIC):
                return
            place += len(data) - len(MAGIC) + 1
            window.drop(place)
            continue
        place += found
        if place >= stop:
            return
        window.drop(place)
        member = member_at(window, place)
        if member is None:
            place += 1
        else:
            yield member[0]
            place = member[1]
            window.drop(place)


def parse(text: bytes) -> tuple:
    head, _, body = text.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head[len(VERSION):].decode().split("\r\n"))
    payload = body[:int(fields["Content-Length"])]
    kind, length = fields["WARC-Type"], int(fields["WARC-Payload-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (
            len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    uri = fields.get("WARC-Target-URI")
    return (_id_of(fields["WARC-Record-ID"]), length, digest, kind, _id_of(fields.get("WARC-Refers-To")),
            None if uri is None else urllib.parse.unquote(uri), payload)


def read(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """All records of ``files`` (``path, length``), ranges of ``range_bytes`` dealt out
    to tasks.  ``payloads`` false leaves the payload column null."""
    ranges = files.select(
        "path", F.explode(F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes))).alias("_start"),
        "length",
    ).select("path", "_start", F.least(F.col("_start") + range_bytes, "length").alias("_stop"))
    ranges = ranges.repartition(max(spark.sparkContext.defaultParallelism, 1), "path", "_start")

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "payload"]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for path, start, stop in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows, size = [], 0
                with open_file(path) as file:
                    for text in records_in(file, start, stop):
                        row = parse(text)
                        row = row if payloads else (*row[:-1], None)
                        rows.append(row)
                        size += len(row[-1] or b"") + 200
                        if size > STEP_BYTES * 4:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return map_batches(ranges, run, RECORDS)
