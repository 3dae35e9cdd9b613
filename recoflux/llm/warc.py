"""WARC archives in Zstandard: one frame for each record, a dictionary in the leading skippable frame.

Archives travel as rows (archive, content): bytes that Spark writes to and reads from any store; `read_files` reads archive files.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = 0x184D2A5D  # the skippable frame that holds a dictionary
ARCHIVE_BYTES = 8 << 20  # of records, before compression, that an archive holds at least
DICT_BYTES, DICT_SAMPLES = 16 << 10, 64  # the dictionary is trained on the first records of its own archive
LEAST = 100  # payload bytes from which a repeated payload is a revisit
DATE = "1970-01-01T00:00:00Z"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string"


def record(page_id, url: str | None, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """A WARC/1.1 record; payload None: a revisit, whose block holds the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in url))
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive; without a dictionary if the records are too few to train one."""
    lead, dictionary = b"", None
    if len(records) >= 8:
        samples = [r[:16384] for r in records[:DICT_SAMPLES]]
        try:
            dictionary = zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, samples)) // 4), samples, k=200, d=8)
        except zstandard.ZstdError:
            dictionary = None
    if dictionary is not None:
        body = zstandard.ZstdCompressor(level=3).compress(dictionary.as_bytes())
        lead = struct.pack("<II", MAGIC, len(body)) + body
    to = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
    return lead + b"".join(to.compress(r) for r in records)


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time; its dictionary comes from the leading skippable frame."""
    at, dictionary = 0, None
    while at + 8 <= len(content):
        magic, size = struct.unpack_from("<II", content, at)
        if magic & 0xFFFFFFF0 != 0x184D2A50:
            break
        if at + 8 + size > len(content):
            raise ValueError("a skippable frame is cut off")
        if magic == MAGIC:
            body = content[at + 8 : at + 8 + size]
            if body[:4] == b"\x28\xb5\x2f\xfd":
                body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 26)
            dictionary = zstandard.ZstdCompressionDict(body)
        at += 8 + size
    of, view = zstandard.ZstdDecompressor(dict_data=dictionary), memoryview(content)
    while at < len(content):
        frame = of.decompressobj()
        out, end = [], at
        while not frame.eof and end < len(content):
            out.append(frame.decompress(view[end : end + (1 << 16)]))
            end += 1 << 16
        if not frame.eof:
            raise ValueError("a frame is cut off")
        end = min(end, len(content)) - len(frame.unused_data)
        yield b"".join(out)
        at = end


def parse(data: bytes) -> dict:
    """A record's fields. Raises ValueError if its headers, lengths or digest don't hold."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            raise ValueError(f"no header field: {line[:60]}")
        fields[k.strip().lower()] = v.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"missing {sorted(missing)}")
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the block's length differs from its header")
    http, sep, payload = rest[:size].partition(b"\r\n\r\n")
    full = [line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    if not sep or not full:
        raise ValueError("no HTTP header")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    kind, number = fields["warc-type"], int(full[0])
    if kind == "response" and (number != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("not a revisit")
    name = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {"page_id": name(fields["warc-record-id"]), "payload_bytes": number, "payload_digest": digest, "record_type": kind, "refers_to": name(fields["warc-refers-to"]) if kind == "revisit" else None, "url": fields.get("warc-target-uri"), "payload": payload}


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        content = pack(held)
        return pa.RecordBatch.from_pydict({"archive": [hashlib.sha256(content).hexdigest()[:24] + ".warc.zst"], "content": pa.array([content], pa.binary())})

    for batch in batches:
        for i in range(0, len(batch), 256):
            for page_id, url, html, digest, n, refers in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                held.append(record(page_id, url, (html or "").encode() if refers is None else None, n, digest, refers))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield out()
                    held, size = [], 0
    if held:
        yield out()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ.split(", ")]
    for batch in batches:
        for archive, content in zip(batch.column(0), batch.column(1), strict=True):
            rows = [parse(x) for x in frames(content.as_py())]
            for r in rows:
                r["archive"] = archive.as_py()
            types = dict(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in names], names=names)


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive, content): archives with a record for each row of pages (page_id, url, html; other columns are ignored).

    Of rows with equal html of LEAST UTF-8 bytes or more, the one with the smallest page_id becomes a response, the others revisits of it;
    rows that repeat that page_id are responses too, as are all where every page_id is null. A null html is an empty payload.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("n"))
    slim = rows.filter(F.col("n") >= LEAST).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 AND first IS NOT NULL").drop("copies")
    # a payload may have a third of all copies: the join by digest carries ids alone, and the pages meet its result by their own id
    again = slim.distinct().join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("page"), F.col("digest").alias("same"), F.col("first").alias("refers_to"))
    both = rows.join(again, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("digest") == F.col("same")), "left")
    return both.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "digest", "n", "refers_to").mapInArrow(_write, "archive string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of (archive, content) rows; a malformed archive fails the read."""
    return archives.select("archive", "content").mapInArrow(_read, READ)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archive files under path, in any store that Spark reads."""
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content"))
