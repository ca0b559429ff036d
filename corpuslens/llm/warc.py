"""WARC archives as a chunked record table.

Writing: each record becomes rows (record, chunk number, bytes of the archive). A payload up to `chunk` bytes
stands in one row; a larger one is sent in HTTP chunked coding, one chunk a row, so that no row written and no buffer
grows with the record (the page's own row of the input is whole). The rows of a task are one archive file, written by Spark's text writer, so archives can
lie in any store that Spark writes to. Archives are gzip files, which are read from front to back.

Reading: the lines of a file are taken in order and records are followed through their headers and chunks; a
table of (record, chunk number, bytes so far, digest so far) comes out, with the SHA-1 carried from chunk to
chunk. A record's last row holds its whole payload's size and digest.

Of records with equal payloads the one with the smallest id is a response, the others are revisits that refer to
it and carry no payload of their own. Null html counts as an empty payload, null urls as an empty target. Rows
of one id with equal payloads are one record's copies and come back as often as they stand. Null ids are written
as `null` and come back as null.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.common import shared_folder

CHUNK = 64 * 1024
PREFIX = "urn:page:"
END = "\r\n"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: null where the record is a response.

    Only digests and ids are shuffled to find the smallest id of each payload; the digest has 160 bits, so a
    payload met by a third of all pages is one row after the partial aggregation.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    first = rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    keys = rows.select("page_id", "sha", F.octet_length("html").alias("size"))
    later = keys.join(first, "sha").where((F.col("first") < F.col("page_id")) & (F.col("size") >= least_bytes))
    later = later.select("page_id", "sha", F.col("first").alias("refers_to")).distinct()
    return rows.join(later, ["page_id", "sha"], "left").drop("sha")


def record_lines(page_id, url: str, html: str, refers_to, chunk: int) -> Iterator[str]:
    """The archive text of one record in pieces; each piece is followed by a line feed that the writer adds.

    The text is cut twice, first for its digest and sizes, then to be written; only one piece at a time is held.
    """
    sha, size, chunked = hashlib.sha1(), 0, 5
    for piece in cuts(html, chunk):
        sha.update(piece)
        size += len(piece)
        chunked += len(f"{len(piece):x}") + 4 + len(piece)
    name = "null" if page_id is None else page_id
    fields = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{PREFIX}{name}>",
        f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base32(sha.digest())}",
        f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response"]
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"]
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <{PREFIX}{refers_to}>",
                   "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = 0
    elif size <= chunk:
        head.append(f"Content-Length: {size}")
        body = size
    else:
        head.append("Transfer-Encoding: chunked")
        body = chunked
    text = END.join([*head, "", ""])
    start = END.join([*fields, f"Content-Length: {len(text) + body}", "", text])
    if refers_to is not None or size <= chunk:
        # the record's end, CR LF CR LF, without the last line feed
        yield start + ("" if refers_to is not None else html) + "\r\n\r"
        return
    yield start[:-1]
    for piece in cuts(html, chunk):
        yield f"{len(piece):x}\r"
        yield piece.decode("utf-8") + "\r"
    yield from ("0\r", "\r", "\r", "\r")


def cuts(text: str, chunk: int) -> Iterator[bytes]:
    """Pieces of at most `chunk` (four or more) bytes of UTF-8 that end between characters."""
    at = 0
    while at < len(text):
        piece = text[at : at + chunk].encode("utf-8")
        if len(piece) > chunk:
            end = chunk
            while piece[end] & 0xC0 == 0x80:
                end -= 1
            piece = piece[:end]
            at += len(piece.decode("utf-8"))
        else:
            at += chunk
        yield piece


def write_archives(records: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Write one gzip archive a task from page_id, url, html, refers_to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, held = [], 0
            for i in range(batch.num_rows):
                page_id, url, html, refers_to = (batch.column(c)[i].as_py() for c in range(4))
                clean = url.replace("\r", "%0D").replace("\n", "%0A")
                for line in record_lines(page_id, clean, html, refers_to, chunk):
                    lines.append(line)
                    held += len(line)
                    if held >= 16 * chunk:
                        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
                        lines, held = [], 0
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    rows = records.select("page_id", "url", "html", "refers_to").mapInArrow(run, "value string")
    rows.write.option("lineSep", "\n").option("compression", "gzip").text(path)


class Parser:
    """Follows the records of one archive, line by line, and reports every chunk of a payload."""

    def __init__(self):
        self.warc: dict[str, str] | None = None
        self.http: dict[str, str] | None = None
        self.left = 0       # bytes of the record's block still to come
        self.chunk_left = -1  # bytes of the present chunk still to come, -1: a size line is next

    def feed(self, line: bytes) -> Iterator[tuple]:
        """One line with its line feed; yields (record, type, refers_to, length, digest, chunk, bytes, sha1, last)."""
        if self.warc is None:
            if line.startswith(b"WARC/"):
                self.warc, self.http, self.left = {}, None, 0
                self.sha, self.size, self.unreported, self.number = hashlib.sha1(), 0, 0, 0
                self.chunk_left, self.in_head = -1, True
            return
        if self.in_head:
            if line.strip():
                name, _, value = line.decode("utf-8").strip().partition(":")
                self.warc[name.lower()] = value.strip()
            else:
                self.in_head, self.left, self.http = False, int(self.warc["content-length"]), {}
                self.in_http = True
            return
        if self.left > 0:
            part = line[: self.left]
            self.left -= len(part)
            if self.in_http:
                if part.strip():
                    name, _, value = part.decode("utf-8").strip().partition(":")
                    self.http[name.lower()] = value.strip()
                else:
                    self.in_http = False
            elif self.http.get("transfer-encoding") == "chunked":
                yield from self._chunked(part)
            else:
                self._take(part)
                if self.left > 0 and self.unreported >= CHUNK:
                    yield self._row(False)
        if self.left == 0:
            yield self._row(True)
            self.warc = None

    def _chunked(self, part: bytes) -> Iterator[tuple]:
        if self.chunk_left < 0:
            size = part.strip()
            self.chunk_left = int(size, 16) + 2 if size else -1
            return
        data = part[: max(0, self.chunk_left - 2)]
        self._take(data)
        self.chunk_left -= len(part)
        if self.chunk_left <= 0:
            self.chunk_left = -1
            if self.unreported:
                yield self._row(False)

    def _take(self, data: bytes) -> None:
        self.sha.update(data)
        self.size += len(data)
        self.unreported += len(data)

    def _row(self, last: bool) -> tuple:
        row = (self.warc["warc-record-id"], self.warc["warc-type"], self.warc.get("warc-refers-to"),
               int(self.warc.get("x-payload-length", self.size)), self.warc.get("warc-payload-digest", "").removeprefix("sha1:"),
               self.number, self.size, base32(self.sha.digest()), last)
        self.number += 1
        self.unreported = 0
        return row


CHUNK_SCHEMA = ("record string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, "
                "chunk int, bytes_so_far bigint, digest_so_far string, last boolean")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of all archives below a path."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parser = None, None
        names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            out = []
            for line, file in zip(batch.column(0), batch.column(1).to_pylist()):
                if file != at:
                    at, parser = file, Parser()
                out.extend(parser.feed((line.as_py() or "").encode("utf-8") + b"\n"))
            columns = list(zip(*out)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return lines.mapInArrow(run, CHUNK_SCHEMA)


def payloads(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: the last chunk row of every record.

    A response whose payload as read differs from its header's digest or length fails the job.
    """
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(PREFIX) + 2}, length({c}) - {len(PREFIX) + 2}) as bigint)")
    wrong = (F.col("record_type") == "response") & (
        (F.col("digest_so_far") != F.col("payload_digest")) | (F.col("bytes_so_far") != F.col("payload_bytes")))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("payload differs from its header: "), "record")))
    return chunks.where("last").select(
        number("record").alias("page_id"),
        F.coalesce(checked.cast("bigint"), "payload_bytes").alias("payload_bytes"), "payload_digest", "record_type",
        number("refers_to").alias("refers_to"))


def archive_round_trip(pages: DataFrame, chunk: int = CHUNK, least_bytes: int = 0) -> DataFrame:
    """Write archives of all pages to the shared folder, read them back, and give each page's record."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(mark_revisits(pages, least_bytes), path, chunk)
    return payloads(read_archives(spark, path))
